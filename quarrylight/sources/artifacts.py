"""Artifacts as tables: versioned directories behind a pointer, JSON lines, tolerant reads, append."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources import versions


def save_version(tables: dict[str, DataFrame], root: str, after: int | None = None) -> int:
    """Write all tables of one version, then publish it; readers see the old version or the new one, never a part.

    A failing task leaves the old version. ``after`` is the version that the writer began from, the newest by
    default: of two writers that began from the same, the second gets a Conflict.
    """
    spark = next(iter(tables.values())).sparkSession
    began = max(versions.numbers(spark, root), default=0) if after is None else after
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    return versions.publish(spark, root, began, {"folder": folder, "tables": sorted(tables)})


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest or a named version."""
    return spark.read.parquet(f"{root}/{versions.manifest(spark, root, version)[1]['folder']}/{name}")


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line."""
    df.write.mode(mode).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, and lines that are no object of the schema are dropped, not fatal."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row")).select("row.*")
    return parsed.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows to JSON lines, as feedback is kept."""
    write_lines(df, path, "append")


def stamped(df: DataFrame, *, fingerprint: str, parser: str, chunker: str, budget: int) -> DataFrame:
    """``df`` with the stamp that every evaluation output carries."""
    return df.withColumns({"fingerprint": F.lit(fingerprint), "parser": F.lit(parser), "chunker": F.lit(chunker), "token_budget": F.lit(budget)})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; other keys stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
