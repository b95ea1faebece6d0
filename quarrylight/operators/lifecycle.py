"""Corpus lifecycle, conversations, feedback, spend and degradation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.ids import reingest_reason
from quarrylight.functions.rates import rate

#: Turns of history, drift rule, title length, session life, days of spend kept.
HISTORY, DRIFT_TURNS, DRIFT_RISE, TITLE, SESSION_SECONDS, SPEND_DAYS = 6, 6, 0.25, 60, 3600, 30


def plan(present: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_id, action (reprocess, skip, delete) and reason.

    present and manifest: owner, source_id, content_hash, fingerprint; documents are one by owner and id.
    """
    now = present.select("owner", "source_id", F.col("content_hash").alias("h"), F.col("fingerprint").alias("f"), F.lit(True).alias("here"))
    old = manifest.select("owner", "source_id", F.col("content_hash").alias("ph"), F.col("fingerprint").alias("pf"), F.lit(True).alias("there"))
    both = now.join(old, ["owner", "source_id"], "full_outer")
    reason = F.when(F.col("there").isNull(), "new document").otherwise(reingest_reason(F.col("ph"), F.col("h"), F.col("pf"), F.col("f")))
    action = F.when(F.col("here").isNull(), "delete").when(reason.isNull(), "skip").otherwise("reprocess")
    return both.select("owner", "source_id", action.alias("action"), F.when(F.col("here").isNotNull(), reason).alias("reason"))


def to_reprocess(present: DataFrame, planned: DataFrame) -> DataFrame:
    """The present rows that the plan does not skip."""
    return present.join(planned.filter("action = 'skip'").select("owner", "source_id"), ["owner", "source_id"], "left_anti")


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each derived table without the rows of the purged (owner, source_id)."""
    keys = gone.select("owner", "source_id").distinct()
    return {name: df.join(keys, ["owner", "source_id"], "left_anti") for name, df in tables.items()}


def tombstones(gone: DataFrame, manifest: DataFrame, deleted_at: Column) -> DataFrame:
    """What is kept of purged sources: title, chunk and parent ids, counts and time."""
    return manifest.join(gone.select("owner", "source_id").distinct(), ["owner", "source_id"], "left_semi").select("owner", "source_id", "title", "doc_type", "chunk_ids", "parent_ids", F.size("chunk_ids").alias("n_chunks"), deleted_at.alias("deleted_at"))


def tombstone_of(chunks: DataFrame, graves: DataFrame) -> DataFrame:
    """chunk_id and the purged source that held it, as a child or as a parent."""
    held = graves.select("source_id", "deleted_at", F.explode(F.array_union("chunk_ids", "parent_ids")).alias("chunk_id"))
    return chunks.select("chunk_id").join(held, "chunk_id")


def record(manifest: DataFrame, graves: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest with ``new`` rows in place of old ones, and tombstones without the ids that came back."""
    keys = new.select("owner", "source_id")
    return manifest.join(keys, ["owner", "source_id"], "left_anti").unionByName(new), graves.join(keys, ["owner", "source_id"], "left_anti")


def mixed_provenance(manifest: DataFrame) -> DataFrame:
    """One row: chunks, chunks without context, and whether only some lack it. manifest: n_chunks, n_uncontextualized."""
    sums = manifest.agg(F.coalesce(F.sum("n_uncontextualized"), F.lit(0)).alias("n_without"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"))
    return sums.withColumn("mixed", (F.col("n_without") > 0) & (F.col("n_without") < F.col("n_chunks")))


def expired(sessions: DataFrame, now: Column, seconds: int = SESSION_SECONDS) -> DataFrame:
    """Sessions older than their life at ``now``. Times count in whole seconds, each rounded to the nearest, halves to the even one."""
    whole = lambda at: F.rint(at.cast("timestamp").cast("double")).cast("long")
    return sessions.filter(whole(now) - whole(F.col("created_at")) > seconds)


def visible_documents(manifest: DataFrame, caller: str | None) -> DataFrame:
    """Public and own documents with READY or SEARCHABLE_INCOMPLETE. manifest: owner, n_uncontextualized, contextual."""
    state = F.when(F.col("contextual") & (F.col("n_uncontextualized") > 0), "SEARCHABLE_INCOMPLETE").otherwise("READY")
    mine = F.col("owner") == "" if caller is None else F.col("owner").isin("", caller)
    return manifest.filter(mine).withColumn("state", state)


def sources_of_turn(sources: Column) -> Column:
    """Distinct non-empty source ids that a turn sent, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(sources, lambda s: s["source_id"]), lambda s: s.isNotNull() & (s != ""))))


def citation_index(turns: DataFrame) -> DataFrame:
    """source_id, conversation_id, turn_index, pipeline_fingerprint: each source once a turn."""
    return turns.select(F.explode(sources_of_turn(F.col("sources"))).alias("source_id"), "conversation_id", "turn_index", "pipeline_fingerprint").distinct()


def impact(index: DataFrame, current: str) -> DataFrame:
    """Per source and conversation: turns that sent it and those under another fingerprint (an empty one is not stale)."""
    stale = (F.col("pipeline_fingerprint") != "") & (F.col("pipeline_fingerprint") != current) & F.lit(current != "")
    return index.groupBy("source_id", "conversation_id").agg(F.count("*").alias("n_turns"), F.sum(stale.cast("long")).alias("n_stale"))


def open_citation(asked: DataFrame, chunks: DataFrame, graves: DataFrame) -> DataFrame:
    """Status of each asked chunk: 200 with its text, 410 with the source that was removed, 404."""
    held = chunks.select("chunk_id", F.col("source_id").alias("live"), "display_text")
    removed = tombstone_of(asked, graves).select("chunk_id", F.col("source_id").alias("dead"))
    joined = asked.select("chunk_id").join(held, "chunk_id", "left").join(removed, "chunk_id", "left")
    status = F.when(F.col("live").isNotNull(), 200).when(F.col("dead").isNotNull(), 410).otherwise(404)
    return joined.select("chunk_id", status.alias("status"), F.coalesce("live", "dead").alias("source_id"), F.when(F.col("live").isNotNull(), F.col("display_text")).alias("display_text"))


def history(turns: DataFrame, most: int = HISTORY) -> DataFrame:
    """Each turn with the texts of the ``most`` turns before it, oldest first. turns: conversation_id, turn_index, text."""
    before = Window.partitionBy("conversation_id").orderBy("turn_index").rowsBetween(-most, -1)
    return turns.withColumn("history", F.collect_list("text").over(before))


def drift(turns: DataFrame) -> DataFrame:
    """Per conversation: share of turns answered from the conversation alone, by halves, and whether it rises.

    turns: conversation_id, turn_index, route. The first half has the smaller half of the turns.
    """
    own = Window.partitionBy("conversation_id")
    rows = turns.withColumn("at", F.row_number().over(own.orderBy("turn_index")) - 1).withColumn("n", F.count("*").over(own))
    alone = (F.col("route") == "conversation_only").cast("double")
    early = F.col("at") < F.floor(F.col("n") / 2)
    out = rows.groupBy("conversation_id").agg(F.max("n").alias("turns"), F.sum(alone).cast("long").alias("conversation_only"), F.avg(alone).alias("s"), F.avg(F.when(early, alone)).alias("a"), F.avg(F.when(~early, alone)).alias("b"))
    enough = F.col("turns") >= DRIFT_TURNS
    return out.select("conversation_id", "turns", "conversation_only", F.round("s", 3).alias("share"), F.round("a", 3).alias("first_half"), F.round("b", 3).alias("second_half"), enough.alias("sufficient"), (enough & (F.col("b") > F.col("a") + DRIFT_RISE)).alias("drifting"))


def summaries(turns: DataFrame) -> DataFrame:
    """Per conversation: title (head of its first question), turns. turns: conversation_id, turn_index, role, text."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn_index")))
    return turns.groupBy("conversation_id").agg(F.coalesce(F.substring(F.trim(first), 1, TITLE), F.lit("")).alias("title"), F.count("*").alias("n_turns"), F.sum((F.col("role") == "user").cast("long")).alias("n_questions"))


def opened(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """``conversations`` with the rows of ``new`` whose id is not taken. Both: conversation_id, owner, created_at."""
    return conversations.unionByName(new.join(conversations.select("conversation_id"), "conversation_id", "left_anti"))


def closed(conversations: DataFrame, turns: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and turns without those that their own owner asked to delete. asked: conversation_id, owner."""
    own = conversations.select("conversation_id", "owner").join(asked.select("conversation_id", "owner"), ["conversation_id", "owner"], "left_semi").select("conversation_id")
    return conversations.join(own, "conversation_id", "left_anti"), turns.join(own, "conversation_id", "left_anti")


def feedback_matrix(feedback: DataFrame, verdicts: list[str]) -> DataFrame:
    """Counts by evidence kind and verdict, one column a verdict."""
    return feedback.groupBy(F.coalesce("evidence_kind", F.lit("unknown")).alias("evidence_kind")).pivot("verdict", verdicts).count().na.fill(0)


def feedback_rates(feedback: DataFrame) -> DataFrame:
    """The three rates that only users can tell: detector false positives, fine sources declined, verified quotes that are wrong."""
    fine, wrong = F.col("verdict") == "source_is_fine", F.col("verdict").isin("not_in_source", "source_doesnt_say")
    rates = [
        ("table_detector_false_positives", F.col("evidence_kind") == "structure_inferred", fine),
        ("declined_but_fine", F.col("evidence_kind") == "found_not_quoted", fine),
        ("verified_but_wrong", F.col("quote_status") == "verified", wrong),
    ]
    row = feedback.agg(*[F.struct(F.lit(name).alias("name"), rate(F.coalesce(F.sum((own & hit).cast("long")), F.lit(0)), F.coalesce(F.sum(own.cast("long")), F.lit(0))).alias("r")).alias(name) for name, own, hit in rates])
    each = row.select(F.explode(F.array(*[F.col(name) for name, _, _ in rates])).alias("x"))
    label = F.when(F.col("x.r.n") == 0, "no flags").otherwise(F.col("x.r.label"))
    return each.select(F.col("x.name").alias("name"), "x.r.n", "x.r.hits", "x.r.rate", label.alias("label"))


def enrich_feedback(feedback: DataFrame, chunks: DataFrame, graves: DataFrame) -> DataFrame:
    """Feedback with what the system believed: text source and provenance of its chunk, and whether its source is gone."""
    known = chunks.select("chunk_id", F.col("text_source").alias("chunk_text_source"), F.col("text_provenance").alias("chunk_provenance"))
    gone = tombstone_of(feedback.select("chunk_id").distinct(), graves).select("chunk_id", F.lit(True).alias("removed"))
    return feedback.join(known, "chunk_id", "left").join(gone, "chunk_id", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def degradations(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per stage and cause: how often, of how many attempts. events: stage, cause; attempts: stage, n."""
    counts = events.groupBy("stage", "cause").agg(F.count("*").alias("n"))
    return counts.join(attempts.select("stage", F.col("n").alias("attempted")), "stage", "left").select("stage", "cause", "n", F.coalesce("attempted", "n").alias("attempted"))


def spend(operations: DataFrame, days: int = SPEND_DAYS) -> DataFrame:
    """Tokens and calls by day and stage, and by day (stage null), of the latest ``days`` days. operations: day, stage, tokens."""
    rolled = operations.groupBy("day", "stage").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    latest = rolled.select("day").distinct().orderBy(F.desc("day")).limit(days)
    kept = rolled.join(F.broadcast(latest), "day")
    totals = kept.groupBy("day").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")).withColumn("stage", F.lit(None).cast("string"))
    return kept.select("day", "stage", "tokens", "calls").unionByName(totals.select("day", "stage", "tokens", "calls"))


def appended(index: DataFrame, new: DataFrame, expected: str) -> DataFrame:
    """``index`` with the chunks of an upload; an error if their pipelines differ or the index moved on.

    ``expected`` is the fingerprint that the upload was made for.
    """
    prints = {r[0] for r in index.select("pipeline_fingerprint").distinct().limit(2).collect()} | {r[0] for r in new.select("pipeline_fingerprint").distinct().limit(2).collect()}
    if prints - {expected}:
        raise ValueError(f"chunks of other pipelines cannot be added: {sorted(map(str, prints))}")
    return index.unionByName(new)


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs as they stand after a restart: what was queued or running has failed. jobs: job_id, state, error."""
    cut = F.col("state").isin("queued", "running")
    return jobs.withColumns({"error": F.when(cut, "interrupted by a restart").otherwise(F.col("error")), "state": F.when(cut, "failed").otherwise(F.col("state"))})


def latest(rows: DataFrame, time: str, key: str, most: int) -> DataFrame:
    """The ``most`` latest rows, ties to the smaller key: job and conversation lists."""
    return rows.orderBy(F.desc(time), key).limit(most)


def latest_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the columns of ``order``; of rows that tie in all of them, one. Tasks keep one row a key before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("__row")).select(key, *(F.col("__row")[c].alias(c) for c in rest))
