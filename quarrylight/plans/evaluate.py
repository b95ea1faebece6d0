"""Evaluate: rank once, cut at every budget, score golden items, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import evaluation, retrieval
from quarrylight.sources.shared import bounded, write_shared


def delivered(ranked: DataFrame, chunks: DataFrame, parents: DataFrame, budget: int) -> DataFrame:
    """item_id, unit, rank, source_id, text: what each query of a ranking is delivered, as children and as parents.

    chunks: chunk_id, parent_id, source_id, display_text, embed_text; parents: parent_id, parent_text. Both are read once: what
    follows reads only the ranked chunks and their parents, which are stored.
    """
    ranked = write_shared(ranked, "ranked")
    wanted = bounded(write_shared(ranked.select("chunk_id").distinct(), "ranked-chunks"))
    chunks = write_shared(chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", "parent_id", "source_id", "display_text", "embed_text"), "ranked-texts")
    owning = bounded(write_shared(chunks.select("parent_id").distinct(), "ranked-parents"))
    parents = write_shared(parents.join(owning, "parent_id", "left_semi"), "parent-texts")
    kids = retrieval.fill(retrieval.costed(ranked, chunks), budget).join(chunks.select("chunk_id", "source_id", F.col("display_text").alias("text")), "chunk_id")
    whole = retrieval.fill(retrieval.costed(ranked, chunks, parents, unit="parent"), budget).filter("cost > 0")
    whole = whole.join(chunks.select("chunk_id", "source_id", "parent_id", "display_text"), "chunk_id").join(parents, "parent_id", "left").withColumn("text", F.coalesce("parent_text", "display_text"))
    columns = [F.col("query_id").alias("item_id"), "unit", "rank", "source_id", "text"]
    return kids.withColumn("unit", F.lit("child")).select(*columns).unionByName(whole.withColumn("unit", F.lit("parent")).select(*columns))


def run(items: DataFrame, ranked: DataFrame, chunks: DataFrame, parents: DataFrame, budget: int = retrieval.HEADLINE_BUDGET) -> DataFrame:
    """Scored items at one budget, one row an item and unit; without delivery it fails. items: item_id, needle, accept."""
    asked = items.withColumn("unit", F.explode(F.array(F.lit("child"), F.lit("parent"))))
    return evaluation.score_items(asked, delivered(ranked, chunks, parents, budget))


def inspector(artifacts: dict[str, DataFrame], gate: DataFrame | None = None, gated: tuple[str, ...] = ()) -> DataFrame:
    """section and row (JSON) of every stored metric table, as an inspector shows them; nothing is computed anew.

    Sections named in ``gated`` are shown only where the one row of ``gate`` says may_emit.
    """
    out = None
    for name, df in artifacts.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        if name in gated:
            part = part.filter(F.lit(False) if gate is None else F.coalesce(gate.select("may_emit").scalar(), F.lit(False)))
        out = part if out is None else out.unionByName(part)
    return out
