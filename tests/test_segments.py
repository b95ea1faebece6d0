import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index as I
from quarrylight.operators import retrieval, segments
from quarrylight.sources import versions

WORDS = [f"w{k}" for k in range(60)]


def corpus(seed, ids):
    rng = random.Random(seed)
    return [(k, rng.choice(["", "", "es"]), " ".join(["the"] * rng.randrange(1, 4) + [WORDS[int(rng.random() ** 3 * 60)] for _ in range(rng.randrange(0, 40))]) if k % 17 else rng.choice([None, "", "!"])) for k in ids]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "chunk_id long, owner string, text string, term string").repartition(3)


def asked(spark):
    rows = [(1, "the w3 w50 w59", None), (2, "the w1 w1", "es"), (3, "the unknown", None), (4, "", None), (5, "w58 w57 w40 w9 the", "fr")]
    return spark.createDataFrame(rows, "query_id long, query_text string, caller string")


def direct(spark, rows, queries, k):
    texts = frame(spark, rows)
    posted = I.postings(texts)
    stats = I.corpus_stats(texts, posted)
    return sorted(map(tuple, retrieval.sparse(queries, posted, I.term_stats(posted, stats), stats, texts.select("chunk_id", "owner"), k).select("query_id", "chunk_id", F.round("score", 6), "matched", "rank").collect()))


def stored(index, queries, k):
    return sorted(map(tuple, segments.search(index, queries, k).select("query_id", "chunk_id", F.round("score", 6), "matched", "rank").collect()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)


def test_adding_removing_and_adding_again_equals_an_index_from_scratch(spark, tmp_path, small):
    queries, rows = asked(spark), corpus(1, range(150))
    index = segments.add(segments.load(spark, str(tmp_path)), frame(spark, rows[:100]))
    index = segments.remove(index, frame(spark, [r for r in rows if r[0] % 3 == 0]).select("chunk_id"))
    changed = corpus(2, range(90, 120))
    index = segments.add(index, frame(spark, changed + rows[120:]))
    index = segments.add(index, frame(spark, [r for r in rows[:60] if r[0] % 6 == 0]))
    live = {r[0]: r for r in rows[:90] if r[0] % 3 or (r[0] % 6 == 0 and r[0] < 60)} | {r[0]: r for r in changed + rows[120:]}
    want = list(live.values())
    posted = I.postings(frame(spark, want))
    stats = I.corpus_stats(frame(spark, want), posted)
    terms = sorted((r["term"], r["df"], round(r["idf"], 9)) for r in I.term_stats(posted, stats).collect())
    for now in (index, segments.merge(index), segments.load(spark, str(tmp_path))):
        assert (now.n, round(now.avgdl, 9)) == (len(want), round(stats.first()["avgdl"], 9))
        assert sorted((r["term"], r["df"], round(r["idf"], 9)) for r in now.terms().collect()) == terms
        assert sorted(r["chunk_id"] for r in now.chunks().collect()) == sorted(live)
        assert stored(now, queries, 5) == direct(spark, want, queries, 5)
    assert len(now.segments) == 1 and segments.load(spark, str(tmp_path), 1).n == 100
    assert stored(segments.load(spark, str(tmp_path), 1), queries, 7) == direct(spark, rows[:100], queries, 7)


def test_empty_index_and_unknown_ids(spark, tmp_path):
    index = segments.load(spark, str(tmp_path))
    assert (index.n, index.version, stored(index, asked(spark), 3)) == (0, 0, [])
    index = segments.add(index, frame(spark, []))
    assert index.n == 0 and stored(index, asked(spark), 3) == []
    index = segments.add(index, frame(spark, corpus(3, range(5)) + [(None, "", "lost")]))
    assert segments.remove(index, spark.createDataFrame([(99,)], "chunk_id long")).n == 5


def test_many_terms_are_joined_in_parts(spark, tmp_path, small, monkeypatch):
    rows = corpus(4, range(120))
    index = segments.add(segments.load(spark, str(tmp_path)), frame(spark, rows))
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 1)
    assert stored(index, asked(spark), 4) == direct(spark, rows, asked(spark), 4)


def test_blocks_that_cannot_reach_the_threshold_are_skipped(spark, tmp_path, small):
    rows = [(k, "", "the " * 3 + ("needle " * 4 if k % 50 == 0 else "other words ") + "pad " * (k % 7)) for k in range(400)]
    queries = spark.createDataFrame([(q, "the needle", None) for q in range(6)], "query_id long, query_text string, caller string")
    index = segments.add(segments.load(spark, str(tmp_path)), frame(spark, rows))
    terms = segments._asked(index, queries)
    marked, _ = segments.cells(index, terms, 3)
    told = marked.agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds"), F.count_if("needed").alias("needed")).first()
    assert told["n"] == 6 * 50 and told["seeds"] == 6 * 3
    assert told["seeds"] + told["needed"] < 0.25 * told["n"]
    assert stored(index, queries, 3) == direct(spark, rows, queries, 3)


def test_a_frequent_term_is_dealt_over_blocks(spark, tmp_path, small):
    index = segments.add(segments.load(spark, str(tmp_path)), frame(spark, corpus(5, range(400))))
    parts = segments._met(index, segments._asked(index, asked(spark)), False).filter("term = 'the'").groupBy(F.pmod(F.xxhash64("seq", "block"), F.lit(segments.SALTS)).alias("part")).agg(F.count("*").alias("n"))
    sizes = sorted(r["n"] for r in parts.collect())
    assert len(sizes) > segments.SALTS // 2 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_of_two_writers_one_fails_and_a_dead_writer_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    first = segments.load(spark, root)
    won = segments.add(first, frame(spark, corpus(6, range(10))))
    with pytest.raises(versions.Conflict):
        segments.add(first, frame(spark, corpus(7, range(20))))
    broken = frame(spark, corpus(8, range(30))).withColumn("text", F.when(F.col("chunk_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        segments.add(won, broken)
    assert versions.numbers(spark, root) == [1] and segments.load(spark, root).n == 10


def test_postings_of_a_block_are_made_from_its_rows(spark, tmp_path, small):
    rows = corpus(5, range(70))
    index = segments.add(segments.load(spark, str(tmp_path)), frame(spark, rows))
    got = index.read("postings", segments.POSTED, ("added",)).select("term", "block", "max_tf", "min_dl", "entries").collect()
    want = {(r.term, r.chunk_id, r.tf, r.dl) for r in I.postings(frame(spark, rows)).select("term", "chunk_id", "tf", "dl").collect()}
    assert {(r.term, e.chunk_id, e.tf, e.dl) for r in got for e in r.entries} == want and sum(len(r.entries) for r in got) == len(want)
    assert all((r.max_tf, r.min_dl) == (max(e.tf for e in r.entries), min(e.dl for e in r.entries)) for r in got)
    assert len({(r.term, r.block) for r in got}) == len(got)
    assert {(r.chunk_id, t, n) for r in index.chunks().collect() for t, n in zip(r.terms, r.tfs)} == {(c, t, n) for t, c, n, _ in want}
