"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that one task writes as one file.
FILE_ROWS = 500_000
#: Rows of a few numbers and ids that are broadcast at most.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a
    new temporary folder (tests); any other master is an error, since its executors do not share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylight-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def write_shared(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing.

    ``rows`` bounds the rows of a narrow table where a count of its source does: it is then written by as many
    tasks as the bound needs, not by one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.shared_path = path
    return written


def bounded(written: DataFrame) -> DataFrame:
    """A stored narrow table, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows: wide tables that meet it are then not shuffled."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def drop_shared(*written: DataFrame) -> None:
    """Delete tables of ``write_shared`` that no later plan reads."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
