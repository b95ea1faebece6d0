"""Importance resampling towards a target distribution, by hashed n-grams.

Words are exploded with their positions; a window over each document's positions leads the
following words, so that every order's runs are columns of one row. Runs are hashed to ``buckets``
and grouped, for the documents and for the target texts: at most ``buckets`` counts each. A
bucket's gain is 1000 times the log ratio of its smoothed shares, floored; a document's weight the
floored mean of its runs' gains. Gumbel noise from the document's id is added, and the highest
scores are drawn: a sample without replacement that favours documents like the target.

Words are runs of digits, letters a-z and characters outside ASCII, A-Z lower-cased. A null or empty
text has no runs and weight 0; it takes no part in the draw, as any document of fewer than
``min_words`` words. A null id is hashed as the empty text and ranks last among ties. Repeated rows
and rows of one id each count, are weighed and may be drawn on their own; rows that tie in score
and id rank by their number of runs. Empty tables give no rows; an empty target makes every t 0.
Other columns than ``doc_id`` and ``text`` are not read. Texts of any length are exploded as a
stream of words; no document's words meet in one group but for orders above one, where the window
holds the words of one document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import write_shared
from quarrylight.operators.numbering import numbered

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDERS, BUCKETS, SEED, MIN_WORDS, PERCENT = (1, 1), 10_000, 2024, 20, 10


def positions(docs: DataFrame, *keys: str) -> DataFrame:
    """The position table: keys, pos and word of every word, and one null word at least for a text that begins or ends in a break or has no word."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(*keys, F.posexplode(F.split(lower, BREAKS)).alias("pos", "word")).withColumn("word", F.nullif("word", F.lit("")))


def runs(words: DataFrame, orders: tuple[int, int], *keys: str) -> DataFrame:
    """keys, first (the run is of one word), and run: every run of ``orders`` consecutive words, and a null run at least for a document without any."""
    low, high = orders
    if high == 1:
        return words.select(*keys, F.col("word").isNotNull().alias("first"), F.col("word").alias("run"))
    in_text = Window.partitionBy(*keys).orderBy("pos")
    led = words.select(*keys, "word", *(F.lead("word", k).over(in_text).alias(f"w{k}") for k in range(1, high)))
    following = [F.col("word"), *(F.col(f"w{k}") for k in range(1, high))]

    def run(order: int) -> Column:
        parts = following[:order]
        whole = parts[0].isNotNull()
        for p in parts[1:]:
            whole = whole & p.isNotNull()
        return F.struct((F.lit(order == 1) & parts[0].isNotNull()).alias("first"), F.when(whole, F.concat_ws(" ", *parts)).alias("run"))

    shorter = [] if low == 1 else [F.struct(F.col("word").isNotNull().alias("first"), F.lit(None).cast("string").alias("run"))]
    each = led.select(*keys, F.explode(F.array(*shorter, *(run(k) for k in range(low, high + 1)))).alias("r"))
    return each.select(*keys, "r.first", "r.run")


def bucket_of(run: Column, buckets: int) -> Column:
    """The bucket of a run: CRC-32 of its UTF-8 bytes."""
    return F.crc32(run) % buckets


def bucket_counts(docs: DataFrame, *, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, its runs in all texts; each task sums its own before the shuffle."""
    rows = docs.select("text").withColumn("__row", F.monotonically_increasing_id())
    found = runs(positions(rows, "__row"), orders, "__row").filter(F.col("run").isNotNull())
    return found.groupBy(bucket_of(F.col("run"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket that the documents use: floor(1000 ln of the smoothed target share over the smoothed share)."""
    own = bucket_counts(docs, orders=orders, buckets=buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, orders=orders, buckets=buckets).withColumnRenamed("n", "t")
    counts = write_shared(own.join(wanted, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(total["s"] + buckets))) / ((s + 1) * F.lit(float(total["t"] + buckets)))
    return counts.filter("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, table: DataFrame, *, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row; ``table`` has a gain for each bucket, so at most ``buckets`` rows are broadcast."""
    rows = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    found = runs(positions(rows, "__row", "doc_id"), orders, "__row", "doc_id").withColumn("bucket", bucket_of(F.col("run"), buckets))
    met = found.join(F.broadcast(table), "bucket", "left")
    sums = met.groupBy("__row", "doc_id").agg(F.count_if("first").alias("n_words"), F.count("run").alias("n_features"), F.sum("gain").alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return sums.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate, floored, fixed by the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    ``percent`` of the documents with ``min_words`` words or more are drawn. The scores are sorted by
    range and numbered by partition, so no task holds all that are drawn.
    """
    weighed = weights(docs, gains(docs, target, orders=orders, buckets=buckets), orders=orders, buckets=buckets)
    scored = write_shared(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("may", F.col("n_words") >= min_words), "scores")
    drawn = scored.filter("may").count() * percent // 100
    placed = numbered(scored, F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "n_words", name="at")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("may") & (F.col("at") <= drawn), F.col("at")).alias("rank"))
