"""Global row numbers without one task: range partitions, counts by partition, offsets added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.sources.shared import write_shared

#: monotonically_increasing_id() holds the partition above, and the row within it in, this many bits.
ROW_BITS = 33


def dealt_in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` written in range partitions of ``order``, with ``__part`` and ``__row``: partitions ascend, and so do the rows of one.

    Rows that tie in every column of ``order`` stay in one partition, so ``order`` should end in columns that tell
    rows apart. ``df`` runs twice, once to sample the bounds: pass a stored table.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return write_shared(placed, "in-order").withColumns({"__part": F.shiftrightunsigned("__at", ROW_BITS), "__row": F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("__at")


def numbered(df: DataFrame, *order: Column | str, name: str = "number", within: str | None = None) -> DataFrame:
    """``df`` with a dense number from 1 in the given order, by group of the column ``within`` if one is named (it must lead ``order``).

    Every task numbers its own range. What is broadcast has a row for each partition, or for each partition's groups
    where ``within`` has few values.
    """
    placed = dealt_in_order(df, *order)
    keys = ["__part"] if within is None else [within, "__part"]
    parts = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*keys[:-1]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*(F.col(k).alias(f"{k}_") for k in keys), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    met = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return placed.join(F.broadcast(starts), met).withColumn(name, F.col("__start") + F.col("__row") + 1).drop("__part", "__row", "__start", *(f"{k}_" for k in keys))
