import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index, invariants, retrieval
from quarrylight.plans import ask


def hits(spark, lists):
    return spark.createDataFrame([(q, rank, cost) for q, costs in lists.items() for rank, cost in enumerate(costs)], "query_id int, rank int, cost long")


def test_fill_stops_at_the_first_overflow(spark):
    rnd = random.Random(3)
    lists = {k: [rnd.choice([0, 1, 5, 20, 40]) for _ in range(rnd.randint(0, 30))] for k in range(60)}
    lists |= {100: [50, 50], 101: [101, 1], 102: [60, 50, 10]}
    want = {}
    for q, costs in lists.items():
        spent, taken = 0, []
        for rank, cost in enumerate(costs):
            if spent + cost > 100:
                break
            spent += cost
            taken.append(rank)
        want[q] = taken
    got = retrieval.fill(hits(spark, lists), 100).collect()
    assert {q: sorted(r.rank for r in got if r.query_id == q) for q in lists} == want
    starved = {r.query_id: r for r in retrieval.starvation(hits(spark, lists), 100).collect()}
    assert starved[101].starved and starved[101].min_unit_tokens == 1 and not starved[100].starved


def small_index(spark):
    texts = [("a", "p1", "", "the red fox ERR_5521"), ("b", "p1", "", "red red wine"), ("c", "p2", "me", "red secret"), ("d", "p9", "you", "red other"), ("e", None, "", ""), ("f", "p2", "", "blue")]
    rows = [(i, p, o, t, "ctx " + t, [1.0, float(k)]) for k, (i, p, o, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, parent_id string, owner string, text string, embed_text string, vec array<double>").withColumn("display_text", F.col("text"))


def built_index(chunks):
    posted = index.postings(chunks)
    stats = index.corpus_stats(chunks, posted)
    return posted, index.term_stats(posted, stats), stats


def test_bm25_against_the_formula(spark):
    chunks = small_index(spark)
    posted, terms, stats = built_index(chunks)
    queries = spark.createDataFrame([("q", "red red err_5521", None), ("mine", "red", "me")], "query_id string, query_text string, caller string")
    got = retrieval.sparse(queries, posted, terms, stats, chunks.select("chunk_id", "owner")).collect()
    tokens = {"a": "the red fox err_5521 err 5521".split(), "b": ["red", "red", "wine"], "c": ["red", "secret"], "d": ["red", "other"], "e": [], "f": ["blue"]}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    avgdl = sum(map(len, tokens.values())) / 6

    def score(query, chunk):
        tf = Counter(tokens[chunk])
        return sum(math.log(1 + (6 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(tokens[chunk]) / avgdl)) for t in query if tf[t])

    for name, query, seen in (("q", "red red err_5521 err 5521".split(), "ab"), ("mine", ["red"], "abc")):
        rows = sorted((r for r in got if r.query_id == name), key=lambda r: r.rank)
        want = sorted(((-round(score(query, c), 9), c) for c in seen))
        assert [(r.chunk_id, r.score) for r in rows] == [(c, pytest.approx(-s, abs=1e-8)) for s, c in want]


def test_owner_is_applied_below_the_ranking(spark):
    chunks = small_index(spark)
    queries = spark.createDataFrame([("q", [0.0, 1.0], None), ("mine", [0.0, 1.0], "me"), ("zero", [0.0, 0.0], None)], "query_id string, query_vec array<double>, caller string")
    ranked = retrieval.dense(queries, chunks, 3)
    got = {q: [r.chunk_id for r in sorted(ranked.collect(), key=lambda r: r.rank) if r.query_id == q] for q in ("q", "mine", "zero")}
    assert got["q"] == ["f", "e", "b"] and "c" in got["mine"] + ["c"] and "d" not in got["mine"] and got["zero"] == []
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("owner")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()


def test_rrf_and_contribution(spark):
    leg = lambda ids: spark.createDataFrame([("q", c, r) for r, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    fused = retrieval.rrf({"dense": leg(["a", "b", "a", "c"]), "sparse": leg(["c", "d"])})
    rows = sorted(fused.collect(), key=lambda r: r.rank)
    assert [r.chunk_id for r in rows] == ["c", "a", "b", "d"]
    assert rows[0].score == pytest.approx(1 / 64 + 1 / 61) and (rows[0].dense_rank, rows[0].sparse_rank) == (4, 1)
    told = retrieval.leg_contribution(fused, ["dense", "sparse"]).first()
    assert (told.n_fused, told.dense_only, told.sparse_only, told.both_legs, told.sparse_share_unique) == (4, 2, 1, 1, 0.25)
    assert [r.chunk_id for r in retrieval.rrf({"dense": leg(["a", "b"])}, limit=1).collect()] == ["a"]


def test_parents_are_charged_once_and_orphans_stand_in(spark):
    chunks = small_index(spark)
    parents = spark.createDataFrame([("p1", "x" * 40), ("p2", "y" * 80)], "parent_id string, parent_text string")
    ranked = spark.createDataFrame([("q", c, r) for r, c in enumerate("abdfc")], "query_id string, chunk_id string, rank int")
    rows = sorted(retrieval.costed(ranked, chunks, parents, unit="parent").collect(), key=lambda r: r.rank)
    assert [(r.target, r.cost) for r in rows] == [("parent:p1", 10), ("parent:p1", 0), ("child:d", 2), ("parent:p2", 20), ("parent:p2", 0)]
    resolved = retrieval.resolve_parents(retrieval.fill(retrieval.costed(ranked, chunks, parents, unit="parent"), 12)).collect()
    assert sorted((r.rank, r.target) for r in resolved) == [(0, "parent:p1"), (1, "child:d")]


def test_recall_ndcg_truncate(spark):
    truth = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, chunk_id string")
    found = spark.createDataFrame([("q", "b", 0), ("q", "x", 1)], "query_id string, chunk_id string, rank int")
    assert retrieval.recall_at_k(found, truth).first().recall == 0.5
    assert retrieval.ndcg(found, truth).first().ndcg == pytest.approx(1 / (1 + 1 / math.log2(3)), abs=1e-6)
    vec = spark.createDataFrame([([3.0, 4.0, 9.0],)], "v array<double>")
    assert vec.select(index.truncate(F.col("v"), 2)).first()[0] == [0.6, 0.8]
    with pytest.raises(Exception, match="fewer than 4"):
        vec.select(index.truncate(F.col("v"), 4)).collect()


def test_isolation_has_a_control_that_fails(spark):
    chunks = small_index(spark)
    built = built_index(chunks)
    checks = {r.name: r.state for r in invariants.isolation_checks(chunks.select("chunk_id", "owner", "text"), chunks.select("chunk_id", "vec"), built, "me", "you").collect()}
    assert len(checks) == 9 and set(checks.values()) == {"HOLDS"}
    leaky = chunks.withColumn("owner", F.lit(""))
    fails = {r.name: r.state for r in invariants.isolation_checks(leaky.select("chunk_id", "owner", "text"), chunks.select("chunk_id", "vec"), built, "me", "you").collect()}
    assert set(fails.values()) == {"NOT_MEASURED"}


def test_retrieve_numbers_at_most_the_sources(spark):
    chunks = small_index(spark)
    parents = spark.createDataFrame([("p1", "x" * 40), ("p2", "y" * 80)], "parent_id string, parent_text string")
    queries = spark.createDataFrame([("q", "red blue", [0.0, 1.0], None)], "query_id string, query_text string, query_vec array<double>, caller string")
    built = built_index(chunks)
    for mode in ("dense", "sparse", "rrf"):
        rows = ask.retrieve(queries, chunks, parents, built, mode=mode, sources=2).collect()
        assert sorted(r.label for r in rows) == list(range(1, len(rows) + 1)) and 0 < len(rows) <= 2
    with pytest.raises(ValueError, match="unknown mode"):
        ask.retrieve(queries, chunks, parents, built, mode="x")


def test_reached_equals_the_whole_index(spark):
    from quarrylight.operators import index

    texts = spark.createDataFrame([(1, "Alpha beta alpha"), (2, ""), (3, None), (4, "gamma v1.2"), (1, "beta"), (5, "--")], "chunk_id int, text string")
    wanted = spark.createDataFrame([("alpha",), ("alpha",), ("v1.2",), ("absent",)], "term string")
    posted, stats = index.reached(texts, wanted)
    whole = index.postings(texts)
    assert {tuple(r) for r in posted.collect()} == {tuple(r) for r in whole.filter("term in ('alpha', 'v1.2')").collect()}
    assert stats.first() == index.corpus_stats(texts, whole).first()


def test_reached_without_texts_or_terms(spark):
    from quarrylight.operators import index

    none = spark.createDataFrame([], "chunk_id int, text string")
    posted, stats = index.reached(none, spark.createDataFrame([("a",)], "term string"))
    assert posted.count() == 0 and tuple(stats.first()) == (0, 0.0)
    posted, stats = index.reached(spark.createDataFrame([(1, "a b")], "chunk_id int, text string"), spark.createDataFrame([], "term string"))
    assert posted.count() == 0 and tuple(stats.first()) == (1, 2.0)
