import os
import random
import zlib

import numpy as np
import oracle
import pytest

from quarrylight.llm import queries, subwords

ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (5, "ÄÖ ß x x x y"), (None, "null id"), (6, "word " * 200_000), (7, "###*** !! |"), (8, "a b a b")]


def row(gram, size):
    code = 0
    for c in gram:
        code = (code * 1_000_003 + ord(c)) % 2**64
    return ((code + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> 32) % size


def brute_score(model, text):
    """Softmax of the mean, features listed one by one."""
    words, found = (text or "").split(), []
    size = len(model.vectors)
    for k, w in enumerate(words):
        own = [zlib.crc32(w.encode()) % size] + [row(f"<{w}>"[i : i + n], size) for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        found += own + ([zlib.crc32(b"\1") % size] * len(own) if k and words[k - 1] == w else [])
    mean = np.bincount(found, minlength=size) @ model.vectors.astype(float) / (len(found) + subwords.BLANKS)
    z = model.output.astype(float) @ mean + model.bias
    return float(np.exp(z[1]) / np.exp(z).sum())


def corpus(spark, n=600, seed=5):
    rng = random.Random(seed)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60)))
    bad = [lambda: good().upper(), lambda: good().replace(" ", "## "), lambda: " ".join(w for w in good().split() for _ in range(4))]
    rows = [(k, good() if k % 3 else bad[k % 9 // 3](), int(k % 3 > 0)) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, label string").repartition(3)
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    return docs, labels, {k: q for k, _, q in rows}


@pytest.fixture(scope="module")
def model(spark):
    docs, labels, _ = corpus(spark)
    return subwords.fit(subwords.training_sample(docs, labels))


def test_score_equals_brute_force_on_odd_rows(spark, model):
    docs = spark.createDataFrame([(i, t, 9) for i, t in ODD], "doc_id long, text string, score int")
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in subwords.score(docs, model).collect()), key=repr)
    want = sorted(((i, brute_score(model, t)) for i, t in ODD), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, s, p), (_, w) in zip(got, want):
        assert abs(s - w) < 1e-5 and p == int(s >= 0.3)


def test_texts_of_another_seed_are_told_apart(spark, model):
    docs, _, truth = corpus(spark, seed=6)
    got = {r["doc_id"]: r["score"] for r in subwords.score(docs, model).collect()}
    assert sum((s >= 0.5) == bool(truth[k]) for k, s in got.items()) > 0.98 * len(got)


def test_training_is_repeatable_and_bounded(spark, model):
    docs, labels, _ = corpus(spark)
    again = subwords.fit(subwords.training_sample(docs.repartition(5), labels))
    assert np.array_equal(again.vectors, model.vectors)
    sample = subwords.training_sample(docs, labels, per_class=7)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 7, 1: 7}
    assert subwords.fit(sample, most_bytes=0).output.any() == False  # noqa: E712


def test_one_class_or_none_scores_the_bias(spark):
    docs, labels, _ = corpus(spark, 30)
    for some in (labels.filter("quality = 1"), labels.limit(0)):
        scores = {r["score"] for r in subwords.score(docs, subwords.fit(subwords.training_sample(docs, some))).collect()}
        assert len(scores) == 1
    assert subwords.score(docs.limit(0), subwords.fit(subwords.training_sample(docs.limit(0), labels))).count() == 0


@pytest.mark.skipif(not os.path.isdir(oracle.TABLES.replace("0.001", "0.01")), reason="no tables")
def test_held_out_documents(spark):
    tables = oracle.TABLES.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality")
    rows = queries.op12_quality_classifier(spark, tables).filter("held_out").join(labels, "doc_id").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.97 * len(rows)
