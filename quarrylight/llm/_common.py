"""Shared plumbing of the training-data operators: table reads, shared storage, Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.shared import drop_shared, shared_dir, write_shared

__all__ = ["BATCH_ROWS", "Scratch", "arrow_batches", "drop_shared", "shared_dir", "table", "write_shared"]

#: Rows per Arrow batch; with texts of some 100 KB a batch stays near 200 MB at worst.
BATCH_ROWS = 2000
#: Bytes of a table, as its rows lie in a broadcast, that may be broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, or only the given columns of it (so that the scan reads no others)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row of numbers and digests in a broadcast's hash table: 8 a field, 16 for a digest, and the row's own entry."""
    return 48 + sum(8 if f.dataType.typeName() != "binary" else 24 for f in df.schema.fields)


class Scratch:
    """Tables in the shared folder for the length of an operation."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``write_shared``, to be deleted by ``drop``."""
        self.held.append(written := write_shared(df, name, rows))
        return written

    def limited(self, rows: DataFrame, name: str) -> DataFrame:
        """A table of numbers and digests, marked for broadcast if it has at most ``BROADCAST_BYTES``.

        What is not stored yet is stored first, so that counting does not run its plan twice.
        """
        stored = rows if hasattr(rows, "shared_path") else self.write(rows, name)
        return F.broadcast(stored) if stored.count() * row_bytes(stored) <= BROADCAST_BYTES else stored

    def drop(self) -> None:
        """Delete all tables; no later plan may read them."""
        drop_shared(*self.held)
        self.held = []
