"""A stored BM25 index of immutable segments: added, removed and merged without reading indexed texts again, searched by blocks with bounds.

A segment holds postings by (term, block of ``BLOCK`` chunks of like length), each row with the largest tf
and the smallest length of its chunks, from which a bound on any score in the block follows under
any corpus statistics. A frequent term has many rows, so no term is one task's work. Beside them stand the
chunks with their terms and tfs (what a removal needs to take counts back, and a merge to post anew) and signed document frequencies.

A version is a manifest of segments; readers of a version are not disturbed by later ones, and of two writers
one fails. A chunk removed at a sequence number is hidden in all segments of smaller numbers; adding it
again makes it visible anew. A merge rewrites the live postings as one segment.

A search finds each query's k most promising blocks, scores those, takes the k-th score as threshold, and scores only
blocks whose bound reaches it: the same rows as scoring everything.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.lexical import counted_texts
from quarrylight.operators.numbering import numbered
from quarrylight.operators.retrieval import B, DIGITS, K1, POOL, query_terms, top_k, visible
from quarrylight.sources.shared import bounded, drop_shared, write_shared
from quarrylight.sources.versions import manifest, numbers, publish

#: Chunks of a block; hash buckets of terms, each a folder that a reader of few terms prunes by.
BLOCK, BUCKETS = 256, 32
#: Query terms that are broadcast at most (some 60 bytes each), and ids of removed chunks (likewise), which spare a shuffle of all chunks.
BROADCAST_ROWS, REMOVED_ROWS = 200_000, 1_000_000
#: Parts that a term's rows are dealt to where the queries' terms are not broadcast.
SALTS = 16
SLACK = 1e-7

POSTED = "term string, block long, max_tf long, min_dl int, entries array<struct<chunk_id: {key}, tf: long, dl: int>>, bucket int"
CHUNKS = "chunk_id {key}, owner string, dl int, terms array<string>, tfs array<int>"
TERMS = "term string, df long"


@dataclass(frozen=True)
class Index:
    """One version: ``segments`` (id, seq, kind), live counts, the type of chunk ids (that of the first added), and its folder.

    As ``part`` of something that publishes its own versions, which name the index's, an index may be changed from
    any of its versions: what follows takes the next free number, and versions that nothing names are never read.
    """

    spark: SparkSession
    root: str
    version: int
    segments: tuple[dict, ...]
    n: int
    tokens: int
    key: str = "bigint"
    part: bool = False

    @property
    def avgdl(self) -> float:
        return self.tokens / self.n if self.n else 0.0

    @property
    def seq(self) -> int:
        return max((s["seq"] for s in self.segments), default=0)

    def read(self, table: str, schema: str, kinds: tuple[str, ...]) -> DataFrame:
        """A table of all segments of these kinds, with their ``seq``."""
        schema = schema.format(key=self.key)
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s['id']}/{table}").withColumn("seq", F.lit(s["seq"])) for s in self.segments if s["kind"] in kinds]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, seq int")

    def removed(self) -> DataFrame | None:
        """chunk_id and the number below which it is hidden; None if nothing was removed."""
        if not any(s["kind"] == "removed" for s in self.segments):
            return None
        gone = self.read("removed", "chunk_id {key}", ("removed",)).groupBy("chunk_id").agg(F.max("seq").alias("until"))
        return F.broadcast(gone) if sum(s["n"] for s in self.segments if s["kind"] == "removed") <= REMOVED_ROWS else gone

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (chunk_id, seq) whose chunk is not removed since."""
        gone = self.removed()
        if gone is None:
            return rows
        return rows.join(gone, "chunk_id", "left").filter("until IS NULL OR until <= seq").drop("until")

    def chunks(self) -> DataFrame:
        """Live chunks: chunk_id, owner, dl, terms, tfs, seq."""
        return self.live(self.read("chunks", CHUNKS, ("added",)))

    def terms(self, only: DataFrame | None = None) -> DataFrame:
        """term, df and idf of the terms that live chunks have; ``only`` (term) keeps some of them."""
        rows = self.read("terms", TERMS, ("added", "removed"))
        if only is not None:
            rows = rows.join(only.select("term").distinct(), "term", "left_semi")
        df = rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df.select("term", "df", F.greatest(F.lit(0.0), F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


def load(spark: SparkSession, root: str, version: int | None = None, *, part: bool = False) -> Index:
    """The newest or a named version of the index in ``root``; an empty one for a new folder, or for version 0."""
    number, held = manifest(spark, root, version)
    return Index(spark, root, number, tuple(held.get("segments", ())), held.get("n", 0), held.get("tokens", 0), held.get("key", "bigint"), part)


def _next(index: Index, segments: list[dict], n: int, tokens: int) -> Index:
    after = max(numbers(index.spark, index.root), default=0) if index.part else index.version
    number = publish(index.spark, index.root, after, {"segments": segments, "n": n, "tokens": tokens, "key": index.key})
    return Index(index.spark, index.root, number, tuple(segments), n, tokens, index.key, index.part)


def _write_segment(index: Index, rows: DataFrame, name: str) -> tuple[int, int]:
    """Write chunks, signed terms and blocked postings of rows (chunk_id, owner, dl, terms, tfs), one a chunk; counts of chunks and tokens.

    ``rows`` runs once, into the chunks. These are shuffled once: each finds its block among the blocks' first chunks, and a task makes
    a row of each of a block's terms and writes it to its folder.
    """
    path = f"{index.root}/{name}"
    rows.select("chunk_id", "owner", "dl", "terms", "tfs").write.parquet(f"{path}/chunks")
    rows = index.spark.read.schema(CHUNKS.format(key=index.key)).parquet(f"{path}/chunks")
    firsts = numbered(rows.select("chunk_id", "dl"), "dl", "chunk_id").filter((F.col("number") - 1) % BLOCK == 0).select("dl", "chunk_id").toArrow()
    shared = index.spark.sparkContext.broadcast(sorted(zip(firsts["dl"].to_pylist(), firsts["chunk_id"].to_pylist())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("dl").to_pylist(), batch.column("chunk_id").to_pylist())
            yield batch.append_column("block", pa.array([bisect_right(shared.value, key) - 1 for key in keys], pa.int64()))

    # Chunks without terms have no postings.
    kept = rows.filter(F.size("terms") > 0).select("chunk_id", "dl", "terms", "tfs")
    placed = kept.mapInArrow(place, f"chunk_id {index.key}, dl int, terms array<string>, tfs array<int>, block long")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    blocked = placed.groupBy("block").applyInArrow(_postings, POSTED.format(key=index.key).rsplit(",", 1)[0]).withColumn("bucket", bucket)
    blocked.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    return told["n"], told["tokens"]


def _postings(chunks: pa.Table) -> pa.Table:
    """The rows of postings of one block, of its chunks (chunk_id, dl, terms, tfs, block)."""
    chunks = chunks.sort_by("chunk_id").combine_chunks()
    lists, counts = chunks["terms"].combine_chunks(), chunks["tfs"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    code, row = np.asarray(coded.indices, np.int64), np.repeat(np.arange(chunks.num_rows), np.asarray(lists.value_lengths(), np.int64))
    order = np.argsort(code, kind="stable")
    code, row, tf = code[order], row[order], np.asarray(counts.flatten(), np.int64)[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    dl = np.asarray(chunks["dl"].combine_chunks(), np.int32)[row]
    each = pa.StructArray.from_arrays([chunks["chunk_id"].combine_chunks().take(pa.array(row)), pa.array(tf), pa.array(dl)], ["chunk_id", "tf", "dl"])
    entries = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)], pa.int32()), each)
    block = pa.array(np.full(len(starts), chunks["block"][0].as_py(), np.int64))
    most, least = pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts))
    return pa.table([coded.dictionary.take(pa.array(code[starts])), block, most, least, entries], names=["term", "block", "max_tf", "min_dl", "entries"])


def remove(index: Index, ids: DataFrame) -> Index:
    """The next version without the chunks of ``ids`` (chunk_id); unknown ids change nothing. Reads the stored chunks, no texts."""
    return _next(index, *_removal(index, ids))


def _removal(index: Index, ids: DataFrame) -> tuple[list[dict], int, int]:
    name, seq = uuid.uuid4().hex, index.seq + 1
    path = f"{index.root}/{name}"
    every = index.read("chunks", CHUNKS, ("added",))
    wanted = ids.select(F.col("chunk_id").cast(index.key).alias("chunk_id")).distinct()
    gone = write_shared(index.live(every.select("chunk_id", "seq")).join(wanted, "chunk_id", "left_semi"), "removed-chunks")
    n = gone.count()
    # The stored chunks are not shuffled, nor stored again, to find the terms of those that go.
    rows = every.join(F.broadcast(gone) if n <= REMOVED_ROWS else gone, ["chunk_id", "seq"], "left_semi")
    gone.select("chunk_id").write.parquet(f"{path}/removed")
    rows.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(f"{path}/terms")
    tokens = rows.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()["tokens"]
    drop_shared(gone)
    segments = [*index.segments, {"id": name, "seq": seq, "kind": "removed", "n": n}] if n else list(index.segments)
    return segments, index.n - n, index.tokens - tokens


def add(index: Index, texts: DataFrame) -> Index:
    """The next version with ``texts`` (chunk_id, owner, text) in it; chunks of the same ids are replaced, in one version.

    Only the added texts are tokenized. Rows without a chunk_id are left out; ids must not repeat.
    """
    if not index.segments:
        index = replace(index, key=texts.schema["chunk_id"].dataType.simpleString())
    known = texts.filter("chunk_id IS NOT NULL").withColumn("chunk_id", F.col("chunk_id").cast(index.key))
    segments, n, tokens = _removal(index, known) if index.n else (list(index.segments), 0, 0)
    seq = max((s["seq"] for s in segments), default=0) + 1
    name = uuid.uuid4().hex
    added, own = _write_segment(index, counted_texts(known, carried=("owner",)), name)
    return _next(index, [*segments, {"id": name, "seq": seq, "kind": "added", "n": added}], n + added, tokens + own)


def merge(index: Index) -> Index:
    """The next version with all live chunks in one segment. Reads stored chunks, no texts."""
    name = uuid.uuid4().hex
    n, tokens = _write_segment(index, index.chunks(), name)
    return _next(index, [{"id": name, "seq": index.seq + 1, "kind": "added", "n": n}], n, tokens)


def gain(idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    """What one occurrence of a query's term adds to a chunk's score; grows with tf, falls with the length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(avgdl))))


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """Stored rows query_id, caller, term, qtf, idf and bucket of the queries' known terms."""
    terms = query_terms(queries)
    known = index.terms(terms).select("term", "idf")
    return write_shared(terms.join(known, "term").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), "query-terms")


def _met(index: Index, asked: DataFrame, few: bool, *columns: str) -> DataFrame:
    """Each asked term with its rows of postings. Few terms are broadcast; many meet the rows in parts, so that a frequent term is dealt out."""
    posted = index.read("postings", POSTED, ("added",)).select("bucket", "term", "seq", "block", *columns)
    if few:
        return posted.join(F.broadcast(asked), ["bucket", "term"])
    copies = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return posted.withColumn("salt", F.pmod(F.xxhash64("seq", "block"), F.lit(SALTS)).cast("int")).join(copies, ["bucket", "term", "salt"]).drop("salt")


def bounds(index: Index, asked: DataFrame, few: bool = True) -> DataFrame:
    """query_id, seq, block and bound: no chunk of the block scores more. Lists of postings are not read."""
    most = F.col("qtf") * gain(F.col("idf"), F.col("max_tf"), F.col("min_dl"), index.avgdl)
    return _met(index, asked, few, "max_tf", "min_dl").groupBy("query_id", "seq", "block").agg(F.sum(most).alias("bound"))


def _scored(index: Index, cells: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """query_id, chunk_id, score and matched of every visible live chunk in the cells (query_id, seq, block and least) that scores ``least`` or more, if that is not null."""
    wanted = bounded(write_shared(cells.join(asked, "query_id"), "wanted"))
    posted = index.read("postings", POSTED, ("added",)).select("bucket", "term", "seq", "block", "entries")
    if few:
        posted = posted.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    hits = posted.join(wanted, ["bucket", "term", "seq", "block"]).select("query_id", "caller", "least", "seq", "qtf", "idf", F.explode("entries").alias("e"))
    each = F.col("qtf") * gain(F.col("idf"), F.col("e.tf"), F.col("e.dl"), index.avgdl)
    sums = hits.groupBy("query_id", "caller", "least", "seq", F.col("e.chunk_id").alias("chunk_id")).agg(F.round(F.sum(each), DIGITS).alias("score"), F.sum("qtf").alias("matched"))
    owners = index.read("chunks", CHUNKS, ("added",)).select("chunk_id", "owner", "seq")
    return index.live(sums.filter("score > 0 AND (least IS NULL OR score >= least)").join(owners, ["chunk_id", "seq"])).filter(visible(F.col("owner"), F.col("caller"))).select("query_id", "chunk_id", "score", "matched")


def cells(index: Index, asked: DataFrame, k: int, few: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, seq, block, whether it must be scored yet, and the k-th score so far; stored hits of the blocks scored first).

    A block is left out if its bound is under the k-th score so far. Bounds and scores differ by rounding alone,
    which ``SLACK`` covers.
    """
    known = write_shared(bounds(index, asked, few), "bounds")
    first = top_k(known.withColumnRenamed("bound", "score").withColumn("cell", F.struct("seq", "block")), k, "cell").select("query_id", "seq", "block", F.lit(True).alias("seed"))
    seeds = write_shared(first, "seeds")
    hits = write_shared(_scored(index, seeds.drop("seed").withColumn("least", F.lit(None).cast("double")), asked, few), "seed-hits")
    threshold = top_k(hits, k).filter(F.col("rank") == k - 1).select("query_id", F.col("score").alias("least"))
    marked = known.join(seeds, ["query_id", "seq", "block"], "left").join(threshold, "query_id", "left")
    reaches = F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))
    return marked.select("query_id", "seq", "block", F.coalesce("seed", F.lit(False)).alias("seed"), (F.col("seed").isNull() & reaches).alias("needed"), "least"), hits


def search(index: Index, queries: DataFrame, k: int = POOL) -> DataFrame:
    """BM25 top-k as ``retrieval.sparse`` gives it: query_id, chunk_id, score, matched, rank. queries: query_id, query_text, caller."""
    asked = _asked(index, queries)
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked, hits = cells(index, asked, k, few)
    rest = _scored(index, marked.filter("needed").select("query_id", "seq", "block", "least"), asked, few)
    return top_k(hits.unionByName(rest), k)
