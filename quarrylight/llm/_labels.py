"""Bounded samples of labelled texts, what classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a class: bytes of a text, bytes of all its texts.
MAX_BYTES, MAX_TOTAL = 1 << 20, 8 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, label and text of at most ``per_class`` labelled documents of each class, lowest hash first.

    Rows with a null label or id are left out, repeated label rows count once. Ids are chosen from
    the narrow label table; the at most 2 * ``per_class`` chosen ones are broadcast to the texts.
    """
    picked = None
    for value in (0, 1):
        ids = labels.filter((F.col(label) == value) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(value).alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = ids if picked is None else picked.unionByName(ids)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def bounded(sample: DataFrame, most_bytes: int = MAX_BYTES, most_total: int = MAX_TOTAL) -> DataFrame:
    """doc_id, label and text of a stored sample's distinct texts of at most ``most_bytes``, by hash, up to ``most_total`` bytes a class."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    sizes = sample.select("doc_id", "label", F.sha2("text", 256).alias("digest"), size.alias("size")).filter(F.col("size") <= most_bytes)
    running = F.sum("size").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("running", running).filter(F.col("running") <= most_total).select(F.col("doc_id").alias("id"), F.col("label").alias("of"), F.col("digest").alias("sha"))
    return sample.join(F.broadcast(kept), (F.col("doc_id") == F.col("id")) & (F.col("label") == F.col("of")) & F.sha2("text", 256).eqNullSafe(F.col("sha"))).select("doc_id", "label", "text")
