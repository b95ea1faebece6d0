import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import index, lexical, matrix, retrieval


def table(rows):
    q, c, t, n = zip(*rows)
    return pa.table({"query_id": q, "caller": pa.array(c, pa.string()), "term": t, "qtf": n, "idf": [1.0 + len(x) for x in t]})


def test_queries_of_the_same_terms_are_one_text():
    same = [(q, c, t, n) for q, c in (("a:1", "a"), ("p:1", None), ("b:1", "b")) for t, n in (("x", 2), ("yy", 1))]
    known = lexical.Weights(table([*same, ("a:2", "a", "x", 1), ("a:2", "a", "yy", 1), ("p:2", None, "x", 1), ("p:2", None, "yy", 1)]))
    assert len(known.keys) == 5 and np.diff(known.first).tolist() == [3, 2]
    assert set(known.keys[:3]) == {"a:1", "p:1", "b:1"} and known.common(known.weights).shape == (2, 2)


def test_low_scores_are_turned_away(monkeypatch):
    monkeypatch.setattr(matrix, "ROWS", 2)
    best = matrix.Best(1, 2)
    best.add(np.array([[5.0, 4.0, 3.0, 2.0, 6.0, 1.0, -np.inf, 4.5]]), np.arange(8))
    assert best.least.tolist() == [5.0] and best.fill.tolist() == [3]
    best.add(np.array([[1.0, 4.9, 5.0]]), np.array([8, 9, -1]))
    assert best.fill.tolist() == [4]
    _, ids, scores, _ = best.rows()
    assert sorted(zip(scores.tolist(), ids.tolist())) == [(5.0, -1), (6.0, 4)]


@pytest.mark.parametrize("size", [4096, 5])
def test_copies_of_a_query_rank_by_their_callers(spark, monkeypatch, size):
    monkeypatch.setattr(lexical, "QUERIES", size)
    texts = spark.createDataFrame([(k, ("", "a", "b")[k % 3], f"the w{k % 4} x{k % 7}") for k in range(60)], "chunk_id long, owner string, text string")
    queries = spark.createDataFrame([(f"{c}:{k}", f"w{k} x{k} the the", c) for k in range(4) for c in ("a", "b", None)], "query_id string, query_text string, caller string")
    posted, stats = index.reached_texts(texts, retrieval.query_terms(queries), carried=("owner",))
    terms = index.term_stats(posted, stats)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieval.sparse(queries, posted, terms, stats, k=5).collect()}
    for q in queries.collect():
        one = queries.filter(F.col("query_id") == q.query_id)
        alone = retrieval.sparse(one, posted, terms, stats, k=5).orderBy("rank").collect()
        assert [got[q.query_id, r["rank"]] for r in alone] == [(r.chunk_id, r.score) for r in alone] and len(alone) == 5
        assert all(r.chunk_id % 3 == 0 or ("", "a", "b")[r.chunk_id % 3] == q.caller for r in alone)


def test_an_index_with_owners_is_not_joined_for_them(spark):
    texts = spark.createDataFrame([(k, "", f"the x{k}") for k in range(9)], "chunk_id long, owner string, text string")
    queries = spark.createDataFrame([(1, "x5", None)], "query_id long, query_text string, caller string")
    posted, stats = index.reached_texts(texts, retrieval.query_terms(queries), carried=("owner",))
    found = retrieval.ranked_ids("sparse", queries, texts, (posted, index.term_stats(posted, stats), stats))
    assert [r.chunk_id for r in found.collect()] == [5]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
