import numpy as np

from quarrylight.llm import topk


def brute(rows, k):
    good = {i: np.floor(1024 * np.array(v, np.float64)).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % 100 == 0):
        found = sorted((-int(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def run(spark, rows, k=10, **sizes):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.search(df.filter("vec_id % 100 = 0"), df, k, **sizes).collect()
    return sorted(tuple(r) for r in got)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([0, 0, 0.25, -0.5, 0.1], 12)]) for i in range(400)]
    rows += [(500, None), (501, [1.0, float("nan")]), (502, [None, 1.0]), (600, [float("inf")]), (700, [0.5]), (None, [0.1] * 12)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, rows, query_rows=2, candidate_rows=50) == brute(rows, 10)
    assert run(spark, rows, 1000) == brute(rows, 1000)


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0])]) == []
    assert run(spark, [(100, []), (1, [1.0]), (2, [])]) == [(100, 1, 1, 0), (100, 2, 2, 0)]
    assert run(spark, [(100, [1.0]), (100, [1.0]), (7, [-1.0])]) == [(100, 1, 7, -(1024**2))]
