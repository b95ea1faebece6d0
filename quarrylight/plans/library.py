"""A library of sources as one versioned set of tables: adding, replacing and removing sources, each in one plan and one publication.

Tables: manifest, chunks, vectors, cache, tombstones; beside them a stored text index and the citation index. A
version of the library names the version of its text index, so a reader sees tables and index of one moment. A
source is one by owner and source_id. Removing one leaves nothing of it in any table but its tombstone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import lifecycle, segments
from quarrylight.operators.chunking import chunk_documents
from quarrylight.operators.index import usable_vectors
from quarrylight.plans.ingest import Embed, child_keys, embed
from quarrylight.schemas import CHUNKS
from quarrylight.sources.corpus import parse
from quarrylight.sources.shared import write_shared
from quarrylight.sources.uploads import gated
from quarrylight.sources.versions import manifest as read_manifest
from quarrylight.sources.versions import publish
from quarrylight.streaming import citations

KEY = ["owner", "source_id"]
TABLES = {
    "manifest": "owner string, source_id string, title string, doc_type string, content_hash string, fingerprint string, chunk_ids array<string>, parent_ids array<string>, cache_keys array<string>, n_chunks long, n_uncontextualized long, contextual boolean",
    "chunks": CHUNKS,
    "vectors": "owner string, source_id string, chunk_id string, vec array<double>",
    "cache": "cache_key string, value array<double>",
    "tombstones": "owner string, source_id string, title string, doc_type string, chunk_ids array<string>, parent_ids array<string>, n_chunks int, deleted_at timestamp",
}


@dataclass(frozen=True)
class Library:
    """One version: its tables by name and its text index."""

    spark: SparkSession
    root: str
    version: int
    folders: dict[str, str]
    index: segments.Index

    def table(self, name: str) -> DataFrame:
        if name not in self.folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{self.folders[name]}")

    def cited(self) -> DataFrame:
        """The citation index, as the stream of turns keeps it."""
        return citations.index(self.spark, f"{self.root}/citations")


def load(spark: SparkSession, root: str, version: int | None = None) -> Library:
    """The newest or a named version; an empty library for a new folder."""
    number, held = read_manifest(spark, root, version)
    return Library(spark, root, number, held.get("folders", {}), segments.load(spark, f"{root}/index", held.get("index", 0), part=True))


def _published(library: Library, tables: dict[str, DataFrame], index: segments.Index) -> Library:
    """Write the changed tables, then publish them with the others and the index's version."""
    number = library.version + 1
    folders = dict(library.folders)
    for name, df in tables.items():
        folders[name] = f"{name}/{number}-{index.version}"
        df.select(*(c.split(" ")[0] for c in TABLES[name].split(", "))).write.mode("overwrite").parquet(f"{library.root}/{folders[name]}")
    publish(library.spark, library.root, library.version, {"folders": folders, "index": index.version})
    return load(library.spark, library.root, number)


def preview(library: Library, gone: DataFrame, current: str) -> DataFrame:
    """source_id, conversation_id, n_turns and n_stale of every conversation that was sent one of the sources: what a removal would touch."""
    return lifecycle.impact(library.cited().join(gone.select("source_id").distinct(), "source_id", "left_semi"), current)


def removed(library: Library, gone: DataFrame, deleted_at: Column) -> Library:
    """The next version without the sources of ``gone`` (owner, source_id): rows of every table, cached vectors that no other source uses, postings.

    A tombstone of each remains. Sources that the manifest does not know change nothing.
    """
    held = library.table("manifest")
    keys = held.join(gone.select(*KEY).distinct(), KEY, "left_semi").select(*KEY)
    left = lifecycle.purge({n: library.table(n) for n in ("manifest", "chunks", "vectors", "tombstones")}, keys)
    graves = lifecycle.tombstones(keys, held, deleted_at).withColumn("n_chunks", F.col("n_chunks").cast("int"))
    used = left["manifest"].select(F.explode("cache_keys").alias("cache_key")).distinct()
    dead = held.join(keys, KEY, "left_semi").select(F.explode("cache_keys").alias("cache_key")).distinct().join(used, "cache_key", "left_anti")
    gone_chunks = library.table("chunks").join(keys, KEY, "left_semi").select("chunk_id")
    index = segments.remove(library.index, gone_chunks) if library.index.n else library.index
    return _published(library, {"manifest": left["manifest"], "chunks": left["chunks"], "vectors": left["vectors"], "cache": library.table("cache").join(dead, "cache_key", "left_anti"), "tombstones": left["tombstones"].unionByName(graves)}, index)


def added(library: Library, docs: DataFrame, model: Embed, *, fingerprint: str, doc_type: str = "text", **options) -> Library:
    """The next version with ``docs`` in it: planned, chunked, embedded through the cache, checked, appended, recorded.

    docs: owner, source_id, title, text, origin, content_hash, already gated and parsed. Sources with an unchanged hash and
    fingerprint are skipped: their texts are not chunked again. Changed ones replace their rows everywhere; those
    that were removed lose their tombstone. An error if stored chunks have another fingerprint that is not replaced here.
    """
    held = library.table("manifest")
    planned = lifecycle.plan(docs.withColumn("fingerprint", F.lit(fingerprint)), held).filter("action = 'reprocess'").select(*KEY)
    fresh = docs.join(planned, KEY, "left_semi")
    chunks = write_shared(chunk_documents(fresh, fingerprint=fingerprint, **options), "chunks")
    vectors, made = embed(chunks, library.table("cache"), model)
    made = write_shared(made, "cache")
    vectors = usable_vectors(write_shared(vectors, "vectors"))
    left = lifecycle.purge({n: library.table(n) for n in ("manifest", "chunks", "vectors", "tombstones")}, planned)
    whole = lifecycle.appended(left["chunks"], chunks, fingerprint)

    child = F.col("role") == "child"
    own = chunks.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(child, F.col("chunk_id")))).alias("chunk_ids"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "parent", F.col("chunk_id")))).alias("parent_ids"),
        F.count_if(child).alias("n_chunks"),
        F.count_if(child & ~F.col("has_contextual_prefix")).alias("n_uncontextualized"),
    )
    keys = child_keys(chunks).groupBy(*KEY).agg(F.sort_array(F.collect_set("cache_key")).alias("cache_keys"))
    none = F.array().cast("array<string>")
    new = fresh.select(*KEY, "title", F.lit(doc_type).alias("doc_type"), "content_hash", F.lit(fingerprint).alias("fingerprint")).join(own, KEY, "left").join(keys, KEY, "left")
    new = new.withColumns({c: F.coalesce(c, none) for c in ("chunk_ids", "parent_ids", "cache_keys")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_uncontextualized")}).withColumn("contextual", F.lit(False))
    manifest, graves = lifecycle.record(left["manifest"], left["tombstones"], new)

    replaced = library.table("chunks").join(planned, KEY, "left_semi").select("chunk_id")
    index = segments.remove(library.index, replaced) if library.index.n else library.index
    index = segments.add(index, chunks.filter(child).select("chunk_id", "owner", F.col("embed_text").alias("text")))
    known = chunks.select(F.col("chunk_id"), *KEY)
    return _published(library, {"manifest": manifest, "chunks": whole, "vectors": left["vectors"].unionByName(vectors.join(known, "chunk_id").select(*KEY, "chunk_id", "vec")), "cache": library.table("cache").unionByName(made.select("cache_key", "value")), "tombstones": graves}, index)


def uploaded(library: Library, files: DataFrame, model: Embed, *, owner: str, fingerprint: str, **loaders) -> tuple[Library, DataFrame]:
    """(the next version with a visitor's files in it, verdict of each file): gated, parsed, then added as sources of ``owner``.

    files: path, content (binary). Refused files are not parsed. If none is accepted, or none has text, the library stays as it is.
    """
    verdicts = write_shared(gated(files), "verdicts")
    accepted = files.join(verdicts.filter("accepted").select("path"), "path", "left_semi").withColumn("content_hash", F.sha2("content", 256))
    blocks = write_shared(parse(accepted, **loaders)[0].select("source_id", "content_hash", "ordinal", "text"), "blocks")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda b: b["text"])
    docs = blocks.groupBy("source_id", "content_hash").agg(F.array_join(ordered, "\n\n").alias("text"))
    if docs.isEmpty():
        return library, verdicts
    docs = docs.withColumns({"owner": F.lit(owner), "title": F.col("source_id"), "origin": F.lit("upload")})
    return added(library, docs, model, fingerprint=fingerprint, doc_type="upload"), verdicts


def opened(library: Library, asked: DataFrame, caller: str | None) -> DataFrame:
    """The citations that a caller opens: status, source and text of each asked chunk_id; chunks of others are not found."""
    mine = library.table("chunks").filter((F.col("owner") == "") | F.col("owner").eqNullSafe(F.lit(caller)))
    graves = library.table("tombstones").filter((F.col("owner") == "") | F.col("owner").eqNullSafe(F.lit(caller)))
    return lifecycle.open_citation(asked, mine, graves)


def answered_feedback(library: Library, feedback: DataFrame) -> DataFrame:
    """Feedback as it is stored: with what the library holds of its chunk, looked up here and not taken from the caller."""
    return lifecycle.enrich_feedback(feedback, library.table("chunks"), library.table("tombstones"))
