import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylight.operators.lifecycle import citation_index
from quarrylight.sources import versions
from quarrylight.streaming import citations, limits, sessions

TURNS = "conversation_id long, turn_index long, sources array<struct<source_id string>>, pipeline_fingerprint string"


def turns(seed, conversations=12, most=6, fingerprint="f"):
    rng = random.Random(seed)
    return [(c, t, [(rng.choice(["a", "b", "c", "", None]),) for _ in range(rng.randrange(4))], f"{fingerprint}{t % 2}") for c in range(conversations) for t in range(rng.randrange(1, most))]


def rows(frame):
    return sorted(map(tuple, frame.select("source_id", "conversation_id", "turn_index", "pipeline_fingerprint").collect()))


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_batches_give_the_whole_index_and_replays_change_nothing(spark, tmp_path):
    root, held = str(tmp_path), turns(1)
    parts = [held[:9], held[9:20], [(c, t, [("new",)], "g") for c, t, *_ in held[5:12]] + held[20:], [(None, 1, [("lost",)], "f")]]
    latest = {}
    for k, part in enumerate(parts):
        batch = spark.createDataFrame(part, TURNS)
        assert citations.apply_batch(spark, root, batch, k) and not citations.apply_batch(spark, root, batch, k)
        latest |= {(c, t): (c, t, s, f) for c, t, s, f in part if c is not None}
        assert rows(citations.index(spark, root)) == rows(citation_index(spark.createDataFrame(list(latest.values()), TURNS)))
    before = rows(citations.index(spark, root))
    citations.merge(spark, root)
    assert rows(citations.index(spark, root)) == before
    assert not citations.apply_batch(spark, root, spark.createDataFrame(parts[0], TURNS), 3)


def test_a_batch_that_dies_between_rows_and_ledger_is_applied_when_it_comes_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first, second = spark.createDataFrame(turns(2), TURNS), spark.createDataFrame(turns(3), TURNS)
    citations.apply_batch(spark, root, first, 0)
    before = rows(citations.index(spark, root))

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(citations, "publish", dies)
        with pytest.raises(RuntimeError, match="killed"):
            citations.apply_batch(spark, root, second, 1)
    assert rows(citations.index(spark, root)) == before and versions.numbers(spark, root) == [1]
    assert citations.apply_batch(spark, root, second, 1)
    assert rows(citations.index(spark, root)) != before


def test_a_stream_of_turns_equals_the_batch_index(spark, tmp_path):
    held = turns(4, 20)
    for k in range(3):
        spark.createDataFrame([r for r in held if r[1] % 3 == k], TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        citations.start(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
        assert rows(citations.index(spark, str(tmp_path / "index"))) == rows(citation_index(spark.createDataFrame(held, TURNS)))
    assert len(versions.numbers(spark, str(tmp_path / "index"))) == 3


def test_expired_sessions_leave_the_state_and_emit_one_row_each(spark, tmp_path):
    rocks(spark)
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    batches = [[("a", 0), ("b", 0), ("b", 30), (None, 5)], [("b", 70), ("c", 80)], [("d", 200)], [("a", 210), ("d", 211)], [("e", 900)], [("e", 901)]]
    out = []

    def keep(frame, _):
        out.extend(map(tuple, frame.collect()))

    for k, batch in enumerate(batches):
        spark.createDataFrame([(s, at(m)) for s, m in batch], "session string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("session string, ts timestamp").parquet(str(tmp_path / "in"))
        query = sessions.expired_stream(stream, seconds=3600).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    held = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] if query.recentProgress else None
    assert sorted((s, n) for s, _, n in out) == [("a", 1), ("a", 1), ("b", 3), ("c", 1), ("d", 2)]
    assert {(s, last) for s, last, _ in out} == {("a", at(0)), ("a", at(210)), ("b", at(70)), ("c", at(80)), ("d", at(211))}
    assert held is None or held <= 3


def test_idle_clients_leave_the_limiter(spark, tmp_path):
    rocks(spark)
    got = []
    for k, part in enumerate([[("x", 1, 1000.0), ("x", 2, 1010.0), ("x", 3, 1020.0)], [("y", 4, 5000.0)], [("y", 5, 9000.0)], [("x", 6, 9010.0)]]):
        spark.createDataFrame(part, "client string, request_id long, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("client string, request_id long, at double").parquet(str(tmp_path / "in"))
        query = limits.limited_stream(stream, most=2, seconds=100, late="1 second").writeStream.foreachBatch(lambda f, _: got.extend((r["request_id"], r["admitted"]) for r in f.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(got) == [(1, True), (2, True), (3, False), (4, True), (5, True), (6, True)]


def spent_by(operations, start, daily, single):
    total, admitted = start, []
    for estimate, actual in operations:
        ok = estimate <= single and total + estimate <= daily
        total += actual if ok else 0
        admitted.append(ok)
    return total - start, admitted


def test_step_functions_equal_the_fold_from_every_start():
    rng = random.Random(9)
    for _ in range(30):
        operations = [(rng.randrange(0, 60), rng.randrange(0, 70)) for _ in range(rng.randrange(0, 40))]
        begins, spent = limits.spending(iter(operations), daily=200, single=50)
        assert len(begins) <= 202
        for start in range(0, 330):
            assert spent[np.searchsorted(begins, start, "right") - 1] == spent_by(operations, start, 200, 50)[0]


def test_one_day_is_decided_by_many_tasks(spark):
    rng = random.Random(10)
    operations = [(day, k, rng.randrange(1, 60), rng.randrange(0, 70)) for day, n in (("d1", 3000), ("d2", 40), (None, 5)) for k in range(n)]
    frame = spark.createDataFrame(operations, "day string, seq long, estimated_tokens long, actual_tokens long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = limits.capped(frame, daily=40_000, single=55)
        tasks = out.filter("day = 'd1'").select(F.spark_partition_id().alias("p")).distinct().count()
        got = {(r["day"], r["seq"]): r["admitted"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for day in ("d1", "d2", None):
        own = sorted((k, e, a) for d, k, e, a in operations if d == day)
        want = spent_by([(e, a) for _, e, a in own], 0, 40_000, 55)[1]
        assert [got[day, k] for k, _, _ in own] == want
    assert tasks > 1 and not all(got.values())
