"""Ruled tables from the line segments of pages: touching rules joined by grid cells, grouped into components, their positions clustered by gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.components import components
from quarrylight.sources.shared import write_shared

#: Points by which rules may miss each other, and within which positions are one; width of a grid cell.
TOUCH, CELL = 3.0, 48.0
PAGE = ("source_id", "page")
#: Rules of a page that is computed in one row; pages with more go through distributed joins. Pairs of rules compared at once.
PAGE_RULES, PAIRS = 512, 2_000_000


def rules(segments: DataFrame, touch: float = TOUCH) -> DataFrame:
    """Axis-parallel segments as rules: rule_id, flat (lies along x), at (its place across) and low to high (its extent).

    segments: source_id, page, x0, y0, x1, y1. Slanted segments, points and rows with a null are left out.
    """
    width, height = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    straight = (F.least(width, height) <= touch) & (F.greatest(width, height) > touch)
    flat = width >= height
    along = lambda pick: F.when(flat, pick("x0", "x1")).otherwise(pick("y0", "y1"))
    at = F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    return segments.filter(straight).select(F.monotonically_increasing_id().alias("rule_id"), *PAGE, flat.alias("flat"), at.alias("at"), along(F.least).alias("low"), along(F.greatest).alias("high"))


def touching(found: DataFrame, touch: float = TOUCH, cell: float = CELL) -> DataFrame:
    """a and b, the ids of rules that cross or touch: an interval join by page and grid cell.

    A rule along x lists the cells of its extent, widened by ``touch``; one along y has one cell, so that each pair meets
    once, and only rules near each other meet. Rules along one line touch if their extents do: sorted by their
    begin, one joins those before it if it begins within their reach.
    """
    cells = F.sequence(F.floor((F.col("low") - touch) / cell), F.floor((F.col("high") + touch) / cell))
    flat = found.filter("flat").select(*PAGE, F.col("rule_id").alias("a"), F.col("at").alias("y"), F.col("low").alias("left"), F.col("high").alias("right"), F.explode(cells).alias("cell"))
    upright = found.filter("NOT flat").select(*PAGE, F.col("rule_id").alias("b"), F.col("at").alias("x"), F.col("low").alias("top"), F.col("high").alias("bottom"), F.floor(F.col("at") / cell).alias("cell"))
    crossed = flat.join(upright, [*PAGE, "cell"]).filter(F.col("x").between(F.col("left") - touch, F.col("right") + touch) & F.col("y").between(F.col("top") - touch, F.col("bottom") + touch)).select("a", "b")
    line = Window.partitionBy(*PAGE, "flat", F.round("at", 1)).orderBy("low", "high", "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("high", "rule_id")).over(line)
    joined = found.withColumn("reach", reach).filter(F.col("low") <= F.col("reach.high") + touch).select(F.col("reach.rule_id").alias("a"), F.col("rule_id").alias("b"))
    return crossed.unionByName(joined)


def clustered(rows: DataFrame, keys: list[str], at: str, touch: float = TOUCH) -> DataFrame:
    """keys and positions: the least of each run of places of which neighbours lie within ``touch``, ascending."""
    order = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(at).over(order)
    firsts = rows.select(*keys, at).distinct().withColumn("first", before.isNull() | (F.col(at) - before > touch)).filter("first")
    return firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("positions"))


def crowded_grids(found: DataFrame, touch: float = TOUCH) -> DataFrame:
    """source_id, page, component, xs and ys of each component with two places or more both ways, by distributed joins and star contraction."""
    member = components(touching(found, touch)).select(F.col("vertex").alias("rule_id"), "component")
    grouped = write_shared(found.join(member, "rule_id", "left").withColumn("component", F.coalesce("component", "rule_id")), "components")
    keys = [*PAGE, "component"]
    across = lambda flat: clustered(grouped.filter(F.col("flat") == flat), keys, "at", touch).filter(F.size("positions") > 1)
    return across(False).withColumnRenamed("positions", "xs").join(across(True).withColumnRenamed("positions", "ys"), keys)


def page_grids(found: DataFrame, touch: float = TOUCH) -> DataFrame:
    """The same for pages of at most ``PAGE_RULES`` rules: they are shuffled once, by page, and many pages are computed at once in numpy."""
    lists = F.sort_array(F.collect_list(F.struct("rule_id", "flat", "at", F.round("at", 1).alias("line"), "low", "high")))
    packed = found.groupBy(*PAGE).agg(lists.alias("r")).select(*PAGE, *(F.col(f"r.{c}").alias(c) for c in ("rule_id", "flat", "at", "line", "low", "high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths(), np.int64)
            ids, flat, at, line, low, high = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 8))
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes * sizes) // PAIRS)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(sizes)]):
                if first == last:
                    continue
                own = slice(ends[first] - sizes[first], ends[last - 1])
                page = np.repeat(np.arange(first, last), sizes[first:last])
                at_page, part, xs, ys = _grids(page, flat[own].astype(bool), at[own], line[own], low[own], high[own], touch)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_page)), batch.column(1).take(pa.array(at_page)), pa.array(ids[own][part], pa.int64()), xs, ys], names=[*PAGE, "component", "xs", "ys"])

    kinds = [f"{c} {found.schema[c].dataType.simpleString()}" for c in PAGE]
    return packed.mapInArrow(run, f"{', '.join(kinds)}, component long, xs array<double>, ys array<double>")


def _linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of ``n`` vertices reaches by the edges."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return label


def _grids(page: np.ndarray, flat: np.ndarray, at: np.ndarray, line: np.ndarray, low: np.ndarray, high: np.ndarray, touch: float) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Page, first rule, places of the uprights and of the flat rules of each component with two places or more both ways. Pages ascend."""
    n = len(page)
    across, up = np.flatnonzero(flat), np.flatnonzero(~flat)
    begin, end = np.searchsorted(page[up], page[across], "left"), np.searchsorted(page[up], page[across], "right")
    a = np.repeat(across, end - begin)
    b = up[np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(len(a))] if len(up) else up
    met = (at[b] >= low[a] - touch) & (at[b] <= high[a] + touch) & (at[a] >= low[b] - touch) & (at[a] <= high[b] + touch)
    order = np.lexsort((high, low, line, flat, page))
    new = np.ones(n, bool)
    new[1:] = (np.diff(page[order]) != 0) | (flat[order][1:] != flat[order][:-1]) | (line[order][1:] != line[order][:-1])
    by = np.argsort(high, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    reach = by[np.maximum.accumulate(np.cumsum(new) * n + rank[order]) % n] if n else by
    after = np.flatnonzero(~new)
    after = after[low[order[after]] <= high[reach[after - 1]] + touch]
    part = _linked(np.concatenate([a[met], order[after]]), np.concatenate([b[met], reach[after - 1]]), n)
    order = np.lexsort((at, flat, part))
    key = part[order] * 2 + flat[order]
    first = np.ones(n, bool)
    first[1:] = (np.diff(key) != 0) | (np.diff(at[order]) > touch)
    key, places = key[first], at[order][first]
    counts = np.bincount(key, minlength=2 * n).reshape(-1, 2)
    good = np.flatnonzero((counts > 1).all(axis=1))
    lists = []
    for way in (0, 1):
        mine = (key % 2 == way) & np.isin(key // 2, good)
        lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[good, way])]), pa.int32()), pa.array(places[mine], pa.float64())))
    return page[good], good, *lists


def ruled_tables(segments: DataFrame, pages: DataFrame, touch: float = TOUCH) -> DataFrame:
    """source_id, page, table_no, n_rows, n_cols, col_xs, bottom_gap and top_gap of every ruled table.

    A table is a component of touching rules with two places or more both ways. ``col_xs`` are the left edges of its
    columns, to a tenth; tables of a page are numbered from the top, then from the left. pages: source_id, page, height.
    """
    found = write_shared(rules(segments, touch), "rules")
    crowded = write_shared(found.groupBy(*PAGE).count().filter(F.col("count") > PAGE_RULES).select(*PAGE), "crowded")
    some = not crowded.isEmpty()
    grids = page_grids(found.join(crowded, list(PAGE), "left_anti") if some else found, touch)
    if some:
        grids = grids.unionByName(crowded_grids(found.join(crowded, list(PAGE), "left_semi"), touch))
    tables = grids.join(pages.select(*PAGE, "height"), list(PAGE))
    last = lambda places: F.element_at(places, -1)
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.get("ys", F.lit(0)), F.get("xs", F.lit(0)), "component"))
    lefts = F.transform(F.slice("xs", F.lit(1), F.size("xs") - 1), lambda x: F.round(x, 1))
    return tables.select(*PAGE, number.alias("table_no"), (F.size("ys") - 1).alias("n_rows"), (F.size("xs") - 1).alias("n_cols"), lefts.alias("col_xs"), F.round(F.col("height") - last(F.col("ys")), 1).alias("bottom_gap"), F.round(F.get("ys", F.lit(0)), 1).alias("top_gap"))
