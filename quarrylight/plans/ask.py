"""Ask: route, rank, fuse, fill, resolve, number, answer and verify a batch of questions as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.ids import format_source
from quarrylight.operators import answers, retrieval


def retrieve(queries: DataFrame, chunks: DataFrame, parents: DataFrame, index, *, mode: str = "dense", unit: str = "parent", budget: int = retrieval.BUDGET, basis: str = "delivered", sources: int = retrieval.MAX_SOURCES) -> DataFrame:
    """Delivered units of each query, at most ``sources``, with label from 1.

    queries: query_id, query_text, query_vec, caller; chunks: chunk_id, parent_id, owner, vec,
    display_text, embed_text; parents: parent_id, parent_text; index: postings, terms, corpus stats.
    """
    ranked = retrieval.ranked_ids(mode, queries, chunks, index)
    filled = retrieval.fill(retrieval.costed(ranked, chunks, parents, unit=unit, basis=basis), budget)
    return answers.numbered(retrieval.resolve_parents(filled), sources)


def prompts(delivered: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """key and prompt of each query: numbered source blocks, then the question.

    passages: target, source_id, page, page_end, heading_path, text_source, text_provenance, text.
    """
    rows = delivered.join(passages, "target")
    shown = format_source(F.col("label"), F.col("source_id"), F.col("page"), F.col("page_end"), F.col("heading_path"), F.col("text_source"), F.col("text_provenance"), F.col("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col("label"), shown.alias("s")))), lambda x: x["s"])
    blocks = rows.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("sources"))
    return questions.select("query_id", "query_text").join(blocks, "query_id").select(F.col("query_id").cast("string").alias("key"), F.concat("sources", F.lit("\n\nQuestion: "), "query_text").alias("prompt"))


def ask(queries: DataFrame, chunks: DataFrame, parents: DataFrame, passages: DataFrame, index, model: Callable[[str], str], **options) -> DataFrame:
    """Answers of an injected model over what retrieve() delivers: key, stage, text and token counts."""
    return answers.generated(prompts(retrieve(queries, chunks, parents, index, **options), passages, queries), model, "answer")
