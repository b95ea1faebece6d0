"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back; the table of edges is written to the shared
folder after every round, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.shared import drop_shared, write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    """The count and the order-free hash of an edge table."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component`` (the least vertex it reaches) of each vertex that has an edge to a smaller one.

    ``edges`` has two long columns a and b; loops and edges with a null end are ignored, repeated
    ones count once. Vertices that are the least of their component are not listed.
    """
    current = write_shared(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = _state(current)
    while True:
        # neither star makes more edges than it is given, so the count before bounds the count after
        last, current = current, write_shared(_small_star(_large_star(current)), "edges", rows=before[0])
        drop_shared(last)
        state = _state(current)
        if state == before:
            return current.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        before = state
