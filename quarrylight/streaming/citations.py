"""The citation index of a stream of turns: each batch replaces its conversations' parts whole, once, however often it is delivered."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.lifecycle import citation_index
from quarrylight.sources.versions import manifest, publish

ROWS = "source_id string, conversation_id long, turn_index long, pipeline_fingerprint string"
TOUCHED = "conversation_id long"
LEDGER = "citations"


def _read(spark: SparkSession, root: str, held: dict, table: str, schema: str) -> DataFrame:
    parts = [spark.read.schema(schema).parquet(f"{root}/{s['id']}/{table}").withColumn("seq", F.lit(s["seq"])) for s in held.get("segments", ())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, seq int")


def index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The index as published: of each conversation, the rows of the last batch that had it."""
    held = manifest(spark, root, version)[1]
    last = _read(spark, root, held, "touched", TOUCHED).groupBy("conversation_id").agg(F.max("seq").alias("seq"))
    return _read(spark, root, held, "rows", ROWS).join(last, ["conversation_id", "seq"]).drop("seq")


def apply_batch(spark: SparkSession, root: str, turns: DataFrame, batch_id: int, ledger: str = LEDGER) -> bool:
    """Bring a batch of turns into the index; False if the ledger has this batch already.

    turns: conversation_id, turn_index, sources (array of source_id), pipeline_fingerprint. A conversation's part becomes
    its old rows, but those of turns that the batch has anew, and the batch's. Rows and ledger entry are published
    by one rename: a batch that dies before it leaves the old index and is applied when it comes again. The sources
    of a turn that a batch has twice are joined, a conversation without an id is left out.
    """
    number, held = manifest(spark, root)
    if held.get("batches", {}).get(ledger, -1) >= batch_id:
        return False
    known = turns.filter("conversation_id IS NOT NULL").select(F.col("conversation_id").cast("long").alias("conversation_id"), F.col("turn_index").cast("long").alias("turn_index"), "sources", "pipeline_fingerprint").persist()
    try:
        conversations = known.select("conversation_id").distinct()
        old = index(spark, root).join(conversations, "conversation_id", "left_semi").join(known.select("conversation_id", "turn_index").distinct(), ["conversation_id", "turn_index"], "left_anti")
        name = uuid.uuid4().hex
        old.unionByName(citation_index(known)).write.parquet(f"{root}/{name}/rows")
        conversations.write.parquet(f"{root}/{name}/touched")
    finally:
        known.unpersist()
    segments = held.get("segments", [])
    seq = max((s["seq"] for s in segments), default=0) + 1
    publish(spark, root, number, {"segments": [*segments, {"id": name, "seq": seq}], "batches": held.get("batches", {}) | {ledger: batch_id}})
    return True


def merge(spark: SparkSession, root: str) -> int:
    """Rewrite the index as one segment; the ledger stays. The number of the new version."""
    number, held = manifest(spark, root)
    name = uuid.uuid4().hex
    index(spark, root, number or None).write.parquet(f"{root}/{name}/rows")
    _read(spark, root, held, "touched", TOUCHED).select("conversation_id").distinct().write.parquet(f"{root}/{name}/touched")
    seq = max((s["seq"] for s in held.get("segments", ())), default=0) + 1
    return publish(spark, root, number, {"segments": [{"id": name, "seq": seq}], "batches": held.get("batches", {})})


def start(turns: DataFrame, root: str, checkpoint: str, ledger: str = LEDGER):
    """Start a query that keeps the index in ``root`` up to date with a stream of turns."""
    return turns.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch.sparkSession, root, batch, batch_id, ledger) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
