import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index, lexical, matrix, retrieval


@pytest.mark.parametrize("seed", range(6))
def test_best_keeps_what_a_sort_keeps(seed):
    rng = np.random.default_rng(seed)
    n, k, rows = 7, 5, 900
    ids = rng.permutation(rows)
    scores = rng.integers(0, 12, (n, rows)).astype(float)
    scores[:, rng.random(rows) < 0.3] = -np.inf
    scores[0, 3:] = -np.inf
    best = matrix.Best(n, k)
    for low in range(0, rows, 17):
        part = slice(low, low + 17)
        best.add(scores[:, part], ids[part], scores[:, part] * 2)
    q, found, told, extra = best.rows()
    for j in range(n):
        want = sorted((-s, i) for s, i in zip(scores[j], ids) if s > -np.inf)[:k]
        assert sorted((-s, i) for s, i in zip(told[q == j], found[q == j])) == want
    assert (extra == told * 2).all()


def test_rare_terms_in_parts_add_what_a_product_adds(monkeypatch):
    monkeypatch.setattr(lexical, "COMMON", 3)
    monkeypatch.setattr(lexical, "PAIRS", 4)
    rng = np.random.default_rng(1)
    qtf = rng.integers(0, 3, (9, 20))
    at = np.argwhere(qtf > 0)
    weights = lexical.Weights(pa.table({"query_id": [int(q) for q, _ in at], "caller": pa.array([None] * len(at), pa.string()), "term": [f"t{t}" for _, t in at], "qtf": [int(qtf[q, t]) for q, t in at], "idf": [t / 7 for _, t in at]}))
    names = weights.terms.to_pylist()
    dense = np.array([[qtf[key, int(t[1:])] * int(t[1:]) / 7 for t in names] for key in weights.keys])
    gain = rng.random((len(names), 6)) * (rng.random((len(names), 6)) < 0.5)
    got = weights.common(weights.weights) @ gain[:3]
    term, row = np.nonzero(gain[3:])
    weights.add_rare(got, weights.weights, term + 3, row, gain[3:][term, row])
    assert np.allclose(got, dense @ gain)


def test_pairs_of_query_and_text_are_not_shuffled(spark):
    texts = spark.createDataFrame([(k, "", f"the w{k % 3} x{k}") for k in range(40)], "chunk_id long, owner string, text string")
    posted = index.postings(texts)
    stats = index.corpus_stats(texts, posted)
    queries = spark.createDataFrame([(1, "the w1 x5", None)], "query_id long, query_text string, caller string")
    found = retrieval.sparse(queries, posted, index.term_stats(posted, stats), stats, texts.select("chunk_id", "owner"), 3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [5, 1, 4]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan and plan.index("WindowGroupLimit") < plan.index("MapInArrow")


def test_many_blocks_of_queries_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "es" if k % 4 == 0 else "", f"the w{k % 3} x{k % 7}") for k in range(60)], "chunk_id long, owner string, text string")
    posted = index.postings(texts)
    stats = index.corpus_stats(texts, posted)
    queries = texts.select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query_text"), F.when(F.col("chunk_id") % 2 == 0, "es").alias("caller"))
    once = lambda: sorted(map(tuple, retrieval.sparse(queries, posted, index.term_stats(posted, stats), stats, texts.select("chunk_id", "owner"), 4).select("query_id", "chunk_id", "score", "matched", "rank").collect()))
    whole = once()
    monkeypatch.setattr(lexical, "QUERIES", 9)
    assert once() == whole and len(whole) == 240


def odd_texts(spark):
    rows = [(1, "es", "Alpha beta alpha v1.2 camelCase iPhone4S-x.Y"), (2, "", ""), (3, "", None), (4, "", "a_b__c _d_ é naïve #tag A/B@c fooBarBAZ x.y.x"), (5, "", "--"), (6, "", "Alpha " * 5 + "x.y 9aB9"), (7, "es", "\u212a \u0130 \U0001f600")]
    return spark.createDataFrame(rows, "chunk_id long, owner string, text string").repartition(2)


@pytest.mark.parametrize("most", [200_000, 1])
def test_texts_counted_in_their_rows_are_the_postings(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "TERMS", most)
    texts, only = odd_texts(spark), spark.createDataFrame([("alpha",), ("x",), ("y",), ("b",), ("case",), ("4s",), ("absent",)], "term string")
    want = {tuple(r) for r in index.postings(texts).select("chunk_id", "term", "tf", "dl").collect()}
    kept = {r["term"] for r in only.collect()} if most > 7 else {t for _, t, _, _ in want}
    for terms, found in ((only, kept), (None, {t for _, t, _, _ in want})):
        rows = lexical.counted_texts(texts, terms, carried=("owner",))
        got = {(r.chunk_id, t, n, r.dl) for r in rows.collect() for t, n in zip(r.terms, r.tfs)}
        assert got == {w for w in want if w[1] in found}
        assert sorted((r.chunk_id, r.owner) for r in rows.collect()) == sorted((r.chunk_id, r.owner) for r in texts.collect())


def test_reached_texts_equal_reached_postings(spark):
    only = spark.createDataFrame([("alpha",), ("x",), ("b",)], "term string")
    twice = odd_texts(spark).unionByName(odd_texts(spark).filter("chunk_id IN (1, 5)").withColumns({"text": F.lit("alpha b"), "owner": F.lit("fr")}))
    for texts in (odd_texts(spark), twice, odd_texts(spark).limit(0)):
        rows, stats = index.reached_texts(texts, only, carried=("owner",))
        posted, whole = index.reached(texts, only)
        assert {(r.chunk_id, t, n, r.dl) for r in rows.collect() for t, n in zip(r.terms, r.tfs)} == {(r.chunk_id, t, n, r.dl) for r in lexical.packed(posted).collect() for t, n in zip(r.terms, r.tfs)}
        assert tuple(stats.first()) == tuple(whole.first())
        assert sorted(map(tuple, index.term_stats(rows, stats).collect())) == sorted(map(tuple, index.term_stats(posted, whole).collect()))


def test_tokens_are_not_shuffled(spark):
    texts = odd_texts(spark).coalesce(1)
    plan = lexical.counted_texts(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan


def test_texts_reach_the_count_uncut(spark):
    plan = lexical.counted_texts(odd_texts(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(lexical, "KEPT", 2)
    words = lexical.Words({"alpha", "v1"})
    assert words.count("Alpha v1.2 alpha, alpha-ALPHA") == (8, {"alpha": 4, "v1": 1})
    assert words.count("x") == (1, {}) and len(words.kept) == 1
