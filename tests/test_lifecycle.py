import datetime as dt

import duckdb
import oracle
import pandas as pd
from pyspark.sql import functions as F

from quarrylight.operators import lifecycle as L
from quarrylight.plans import catalog
from quarrylight.streaming import limits

NOW = dt.datetime(2024, 5, 1, 12)


def test_plan_purge_and_return(spark):
    present = spark.createDataFrame([("", "new", "h", "f"), ("", "same", "h", "f"), ("", "edited", "h2", "f"), ("", "piped", "h", "f2"), ("me", "same", "h9", "f")], "owner string, source_id string, content_hash string, fingerprint string")
    manifest = spark.createDataFrame([("", s, "h", "f", f"T {s}", "pdf", [f"c-{s}"], [f"p-{s}"]) for s in ("same", "edited", "piped", "gone")], "owner string, source_id string, content_hash string, fingerprint string, title string, doc_type string, chunk_ids array<string>, parent_ids array<string>")
    planned = L.plan(present, manifest)
    got = {(r.owner, r.source_id): (r.action, r.reason) for r in planned.collect()}
    assert got == {
        ("", "new"): ("reprocess", "new document"),
        ("", "same"): ("skip", None),
        ("", "edited"): ("reprocess", "content changed"),
        ("", "piped"): ("reprocess", "pipeline changed (f -> f2)"),
        ("me", "same"): ("reprocess", "new document"),
        ("", "gone"): ("delete", None),
    }
    assert {r.source_id for r in L.to_reprocess(present, planned).filter("owner = ''").collect()} == {"new", "edited", "piped"}
    gone = planned.filter("action = 'delete'")
    graves = L.tombstones(gone, manifest, F.lit(NOW))
    left = L.purge({"manifest": manifest}, gone)["manifest"]
    assert left.count() == 3 and graves.first().title == "T gone"
    chunks = spark.createDataFrame([("c-same", "same", "text")], "chunk_id string, source_id string, display_text string")
    asked = spark.createDataFrame([("c-same",), ("c-gone",), ("p-gone",), ("zz",)], "chunk_id string")
    opened = {r.chunk_id: (r.status, r.source_id, r.display_text) for r in L.open_citation(asked, chunks, graves).collect()}
    assert opened == {"c-same": (200, "same", "text"), "c-gone": (410, "gone", None), "p-gone": (410, "gone", None), "zz": (404, None, None)}
    back, empty = L.record(left, graves, manifest.filter("source_id = 'gone'"))
    assert back.count() == 4 and empty.count() == 0


def turns(spark, routes):
    return spark.createDataFrame([(c, k, r) for c, rs in routes.items() for k, r in enumerate(rs)], "conversation_id string, turn_index int, route string")


def test_drift(spark):
    c, d = "conversation_only", "documents"
    got = {r.conversation_id: r for r in L.drift(turns(spark, {"five": [d, d, c, c, c], "six": [d, d, d, c, c, c], "seven": [d, d, d, d, c, d, d], "edge": [d, d, d, d, d, d, d, c]})).collect()}
    assert (got["five"].sufficient, got["five"].drifting) == (False, False)
    assert got["six"].drifting and got["six"].second_half == 1.0
    assert (got["seven"].second_half, got["seven"].drifting) == (0.25, False)
    assert not got["edge"].drifting and got["edge"].share == 0.125


def test_history_and_citations(spark):
    rows = [("c", k, "user" if k % 2 == 0 else "assistant", f"t{k}", [("s1",), ("s1",), ("",), (None,)] if k == 1 else [("s2",)], "f1" if k < 3 else "") for k in range(9)]
    frame = spark.createDataFrame(rows, "conversation_id string, turn_index int, role string, text string, sources array<struct<source_id:string>>, pipeline_fingerprint string")
    told = {r.turn_index: r.history for r in L.history(frame).collect()}
    assert told[0] == [] and told[8] == [f"t{k}" for k in range(2, 8)]
    index = L.citation_index(frame)
    assert index.filter("source_id = 's1'").count() == 1
    assert {r.source_id: (r.n_turns, r.n_stale) for r in L.impact(index, "f2").collect()} == {"s1": (1, 1), "s2": (8, 2)}
    assert L.impact(index, "").agg(F.sum("n_stale")).first()[0] == 0
    assert L.summaries(frame).first().title == "t0"


def test_feedback(spark):
    rows = [("structure_inferred", "source_is_fine", "absent")] * 3 + [("found_not_quoted", "source_is_fine", "absent")] * 10 + [(None, "not_in_source", "verified")]
    frame = spark.createDataFrame(rows, "evidence_kind string, verdict string, quote_status string")
    got = {r.name: r.label for r in L.feedback_rates(frame).collect()}
    assert got == {"table_detector_false_positives": "3 of 3", "declined_but_fine": "10/10 = 100%", "verified_but_wrong": "1 of 1"}
    assert {r.label for r in L.feedback_rates(frame.limit(0)).collect()} == {"no flags"}
    assert {r.evidence_kind: r.source_is_fine for r in L.feedback_matrix(frame, ["source_is_fine"]).collect()}["unknown"] == 0


def test_ledgers(spark):
    failed = spark.createDataFrame([("embed", "quota"), ("embed", "quota"), ("judge", "wait")], "stage string, cause string")
    got = {(r.stage, r.cause): (r.n, r.attempted) for r in L.degradations(failed, spark.createDataFrame([("embed", 9)], "stage string, n long")).collect()}
    assert got == {("embed", "quota"): (2, 9), ("judge", "wait"): (1, 1)}
    ops = spark.createDataFrame([(dt.date(2024, 1, d), "ask", d) for d in range(1, 32)] + [(dt.date(2024, 1, 31), "judge", 4)], "day date, stage string, tokens long")
    spent = L.spend(ops).collect()
    assert min(r.day for r in spent) == dt.date(2024, 1, 2) and [r.tokens for r in spent if r.stage is None and r.day.day == 31] == [35]
    sessions = spark.createDataFrame([("a", NOW - dt.timedelta(seconds=3600)), ("b", NOW - dt.timedelta(seconds=3601))], "id string, created_at timestamp")
    assert [r.id for r in L.expired(sessions, F.lit(NOW)).collect()] == ["b"]
    manifest = spark.createDataFrame([("", 0, True, 3), ("me", 2, True, 3), ("you", 0, False, 3)], "owner string, n_uncontextualized long, contextual boolean, n_chunks long")
    assert L.visible_documents(manifest, "me").filter("state = 'SEARCHABLE_INCOMPLETE'").count() == 1 and L.visible_documents(manifest, None).count() == 1
    assert L.mixed_provenance(manifest).first().mixed and not L.mixed_provenance(manifest.limit(0)).first().mixed


def requests():
    rows = [("a", float(k * 100), k) for k in range(25)] + [("a", 3600.0, 100), ("a", 3600.1, 101), ("b", 0.0, 200)]
    return rows


def brute(rows, most, seconds):
    held, out = {}, {}
    for client, at, number in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        times = [t for t in held.get(client, []) if at - t <= seconds]
        out[number] = len(times) < most
        held[client] = times + [at] if out[number] else times
    return out


def test_limiter_counts_only_what_it_admits(spark):
    frame = spark.createDataFrame(requests(), "client string, at double, request_id long")
    got = {r.request_id: r.admitted for r in limits.limited(frame).collect()}
    assert got == brute(requests(), 20, 3600)
    assert not got[20] and not got[100] and got[101] and got[200]


def test_daily_cap(spark):
    rows = [("d", 0, 60, 40), ("d", 1, 61, 1), ("d", 2, 60, 60), ("d", 3, 1, 1), ("e", 4, 60, 60)]
    frame = spark.createDataFrame(rows, "day string, seq int, estimated_tokens long, actual_tokens long")
    got = [r.admitted for r in limits.capped(frame, daily=100, single=60).orderBy("seq").collect()]
    assert got == [True, False, True, False, True]


def test_streams_agree_with_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(requests(), "client string, at double, request_id long")
    frame.filter("at < 1500").coalesce(1).write.parquet(source)
    frame.filter("at >= 1500").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def drain(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    out = drain(limits.limited_stream(stream), "limited", "append")
    assert sorted(r.request_id for r in out) == sorted(r[2] for r in requests())
    events = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 02:00", "2024-01-02 01:00"]), "event_type": ["a", "a", "b"]}))
    events.write.parquet(str(tmp_path / "events"))
    streamed = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    want = sorted(map(tuple, limits.daily_counts(events).collect()))
    assert sorted(map(tuple, drain(limits.daily_counts(streamed), "daily", "complete"))) == want
    limits.append_feedback(spark.readStream.schema(frame.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == frame.count()


def test_conversations_open_once_and_close_by_their_owner(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "conversation_id int, owner string")
    new = spark.createDataFrame([(2, "a"), (3, "a")], "conversation_id int, owner string")
    assert {tuple(r) for r in L.opened(held, new).collect()} == {(1, "a"), (2, "b"), (3, "a")}
    turns = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "conversation_id int, turn_index int")
    asked = spark.createDataFrame([(1, "a"), (2, "a")], "conversation_id int, owner string")
    kept, left = L.closed(held, turns, asked)
    assert {tuple(r) for r in kept.collect()} == {(2, "b")} and left.count() == 2


def test_parts_of_a_second_round_as_in_sql(spark, tmp_path):
    last = dt.datetime(2024, 5, 1, 12, 0, 0, 261702)
    at = [last] + [last - dt.timedelta(days=10) + dt.timedelta(milliseconds=k) for k in (-1600, -1000, -800, -762, -761, -700, -262, -261, 0, 238, 239, 500)]
    duckdb.sql(f"COPY (SELECT row_number() OVER () AS event_id, t::TIMESTAMP AS ts FROM (SELECT unnest({[str(t) for t in at]}) AS t)) TO '{tmp_path}/events.parquet'")
    oracle.same(spark, catalog.m5_expired_sessions, catalog.SQL["m5_expired_sessions"], str(tmp_path))
