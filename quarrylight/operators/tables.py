"""Table quality: headers, corrupt cells, matching of detected tables, tables that continue on the next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import corrupt_cells, first_filled_row, header_plausible, squash

#: Distances in points and lengths of probes.
BOTTOM, TOP, SAME_X, PROBE_CHARS, PROBES, SIGNALS = 80.0, 120.0, 6.0, 5, 2, 3


def detected(tables: DataFrame) -> DataFrame:
    """``tables`` (rows, page_text) with header_ok, first_row and the number of corrupt numeric cells."""
    return tables.withColumns({"header_ok": header_plausible(F.col("rows")), "first_row": first_filled_row(F.col("rows")), "n_corrupt": F.size(corrupt_cells(F.col("rows"), F.col("page_text")))})


def continuations(tables: DataFrame) -> DataFrame:
    """Pairs of tables on consecutive pages with their signals; ``suspect`` from three signals on.

    tables: source_id, page, table_no, n_cols, col_xs, bottom_gap, top_gap, header_ok. Only tables near the
    top of their page are looked at.
    """
    before = tables.select("source_id", (F.col("page") + 1).alias("page"), F.col("table_no").alias("previous_no"), F.col("n_cols").alias("p_cols"), F.col("col_xs").alias("p_xs"), F.col("bottom_gap").alias("p_gap"))
    pairs = tables.filter(F.col("top_gap") <= TOP).join(before, ["source_id", "page"])
    same_x = (F.size("col_xs") == F.size("p_xs")) & F.forall(F.zip_with("col_xs", "p_xs", lambda a, b: F.abs(a - b) <= SAME_X), lambda ok: F.coalesce(ok, F.lit(False)))
    signals = F.lit(1) + (F.col("n_cols") == F.col("p_cols")).cast("int") + same_x.cast("int") + (F.col("p_gap") <= BOTTOM).cast("int") + (~F.col("header_ok")).cast("int")
    return pairs.select("source_id", "page", "previous_no", "table_no", signals.alias("signals"), (signals >= SIGNALS).alias("suspect"))


def matched(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, page, ordinal, table_no: each table block takes the first free candidate of its page whose probes it holds.

    blocks: source_id, page, ordinal, text; candidates: source_id, page, table_no, first_row. A candidate is
    consumed by its first block, so a page is one row, in which its blocks are folded in order; pages are small.
    """
    probes = F.slice(F.filter(F.transform("first_row", squash), lambda c: F.length(c) >= PROBE_CHARS), 1, PROBES)
    kind = "struct<{0}:int,{1}>".format
    left = blocks.select("source_id", "page", F.struct(F.col("ordinal").cast("int").alias("ordinal"), squash(F.col("text")).alias("text")).alias("block"), F.lit(None).cast(kind("table_no", "probes:array<string>")).alias("offer"))
    right = candidates.select("source_id", "page", F.lit(None).cast(kind("ordinal", "text:string")).alias("block"), F.struct(F.col("table_no").cast("int").alias("table_no"), probes.alias("probes")).alias("offer")).filter(F.size("offer.probes") > 0)
    pages = left.unionByName(right).groupBy("source_id", "page").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.sort_array(F.collect_list("offer")).alias("offers")).filter((F.size("blocks") > 0) & (F.size("offers") > 0))

    def fold(state: Column, block: Column) -> Column:
        # Places of candidates that are still free, and for each block so far its candidate's place, or null.
        hit = F.get(F.filter(state["free"], lambda at: F.forall(F.get("offers", at)["probes"], lambda probe: F.contains(block["text"], probe))), F.lit(0))
        return F.get(F.transform(F.array(hit), lambda at: F.struct(F.filter(state["free"], lambda x: ~x.eqNullSafe(at)).alias("free"), F.concat(state["taken"], F.array(at)).alias("taken"))), F.lit(0))

    start = F.struct(F.sequence(F.lit(0), F.size("offers") - 1).alias("free"), F.array().cast("array<int>").alias("taken"))
    told = pages.select("source_id", "page", F.posexplode(F.aggregate("blocks", start, fold, lambda s: s["taken"])).alias("n", "at"), "blocks", "offers")
    return told.filter("at IS NOT NULL").select("source_id", "page", F.get("blocks", F.col("n"))["ordinal"].alias("ordinal"), F.get("offers", F.col("at"))["table_no"].alias("table_no"))


def provenance_propagation(files: DataFrame) -> DataFrame:
    """Per file whether repairs show in labels: (repaired > 0) exactly if (labelled > 0), and no fewer labels than repairs.

    files: source_id, repaired, labelled.
    """
    problem = F.when((F.col("repaired") > 0) & (F.col("labelled") == 0), "repairs without a label").when((F.col("repaired") == 0) & (F.col("labelled") > 0), "labels without a repair").when(F.col("labelled") < F.col("repaired"), "fewer labels than repairs")
    return files.select("source_id", "repaired", "labelled", problem.isNull().alias("ok"), problem.alias("problem"))
