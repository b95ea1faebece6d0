"""Ingest: plan, parse what changed, chunk, embed with a cache, build the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.ids import cache_key
from quarrylight.functions.text import count_tokens
from quarrylight.operators import index as indexing
from quarrylight.operators.answers import cached
from quarrylight.operators.chunking import chunk_documents
from quarrylight.operators.lifecycle import plan, to_reprocess

#: Components of the pipeline fingerprint's embedding part, input limit, texts a call.
MODEL, DIM, SCHEME, MAX_INPUT, BATCH = "stub", 64, "document", 8192, 16

Embed = Callable[[list[str]], list[list[float]]]


def child_keys(chunks: DataFrame, *, name: str = MODEL, dim: int = DIM, scheme: str = SCHEME) -> DataFrame:
    """The children with the ``cache_key`` of their vectors."""
    return chunks.filter("role = 'child'").withColumn("cache_key", cache_key(F.lit("1"), F.lit(name), F.lit(str(dim)), F.lit(scheme), F.sha2("embed_text", 256)))


def embed(chunks: DataFrame, cache: DataFrame, model: Embed, *, name: str = MODEL, dim: int = DIM, scheme: str = SCHEME) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, vec) of every child by an injected model, and the new cache rows.

    The key covers model, dimension, scheme and text. A text over the input limit is an error, never
    cut. A call that returns another number of vectors than texts is one too.
    """
    children = child_keys(chunks, name=name, dim=dim, scheme=scheme).select("chunk_id", "embed_text", "cache_key")
    fits = F.when(count_tokens(F.col("embed_text")) > MAX_INPUT, F.raise_error(F.lit("a text is over the input limit")).cast("boolean")).otherwise(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for k in range(0, len(texts), BATCH):
                made = model(texts[k : k + BATCH])
                if len(made) != len(texts[k : k + BATCH]):
                    raise ValueError("the embedder returned another number of vectors than texts")
                out += made
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["cache_key", "value"])

    def make(misses: DataFrame) -> DataFrame:
        return misses.select("cache_key", "embed_text").mapInArrow(run, "cache_key string, value array<double>")

    values, made = cached(children.filter(fits), cache, make)
    return values.select("chunk_id", indexing.truncate(F.col("value"), dim).alias("vec")), made


def ingest(docs: DataFrame, manifest: DataFrame, cache: DataFrame, model: Embed, *, fingerprint: str, **options) -> dict[str, DataFrame]:
    """plan, chunks, vectors, postings, terms, corpus stats, report and new cache rows of one snapshot.

    docs: owner, source_id, title, text, origin, content_hash. Documents that the plan skips are not read again.
    """
    planned = plan(docs.withColumn("fingerprint", F.lit(fingerprint)), manifest)
    chunks = chunk_documents(to_reprocess(docs, planned), fingerprint=fingerprint, **options)
    vectors, made = embed(chunks, cache, model)
    texts = chunks.filter("role = 'child'").select("chunk_id", F.col("embed_text").alias("text"))
    posted = indexing.postings(texts)
    stats = indexing.corpus_stats(texts, posted)
    parents = chunks.filter("role = 'parent'").select(F.col("chunk_id").alias("parent_id"))
    return {
        "plan": planned,
        "chunks": chunks,
        "vectors": indexing.usable_vectors(vectors),
        "postings": posted,
        "terms": indexing.term_stats(posted, stats),
        "stats": stats,
        "report": indexing.build_report(chunks.filter("role = 'child'"), vectors, parents),
        "cache": made,
    }
