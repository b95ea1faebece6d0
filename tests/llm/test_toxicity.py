import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from quarrylight.llm import toxicity


def corpus(n, seed):
    rnd = random.Random(seed)
    common = [f"{a}{b}{c}" for a in ("mar", "len", "tor", "vis", "pel") for b in ("a", "i", "o") for c in ("ke", "nt", "sh", "ry", "")]
    rows = []
    for k in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(20, 200))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3 + len(words) // 40):
                words.insert(rnd.randrange(len(words)), rnd.choice(["gronkas", "gronkel", "gronkity", "blithwort"]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(2000, None, ""), (2001, "", ""), (2002, "... 123", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(1, 0), (5000, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    machine = toxicity.fit(toxicity.training_sample(docs, labels))
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    assert len(got) == len(rows) + 3
    held = [(y, got[i].predicted) for i, _, y in rows if i % 3 == 0]
    assert np.mean([y == p for y, p in held]) > 0.98
    bias = 1 / (1 + math.exp(-machine.bias))
    assert all(abs(got[i].score - bias) < 1e-12 for i in (2000, 2001, 2002))
    again = toxicity.fit(toxicity.training_sample(docs, labels))
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == {i: r.score for i, r in got.items()}


def test_factors_learn_pairs_that_weights_miss():
    rnd = random.Random(4)
    texts, labels = [], []
    for _ in range(1200):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append({**({0: 1.0} if insult else {}), **({1: 1.0} if group else {}), 2 + rnd.randrange(5): 1.0})
        labels.append(int(insult == group))
    arrays = [(np.array(list(t)), np.array(list(t.values()))) for t in texts]
    machine = toxicity.train(arrays, labels, dimension=7, epochs=20)
    assert np.mean([(machine.score(*t) > 0.5) == y for t, y in zip(arrays, labels)]) > 0.95


def test_fit_learns_a_pair_whose_parts_say_nothing(spark):
    """Toxic if both words stand there or neither: each word alone is as common in both classes."""
    rnd = random.Random(4)
    filler = [f"mot{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = []
    for k in range(1200):
        one, two = rnd.random() < 0.5, rnd.random() < 0.5
        words = [rnd.choice(filler) for _ in range(12)] + ["grobian"] * (2 * one) + ["volk"] * (2 * two)
        rnd.shuffle(words)
        rows.append((k, " ".join(words), int(one == two)))
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t, _ in rows], "doc_id long, text string, label string, predicted int")
    labels = spark.createDataFrame([(i, y, "clash") for i, _, y in rows if i % 3], "doc_id long, toxic int, text string")
    sample = toxicity.training_sample(docs, labels)
    n = [sample.filter(f"label = {c}").count() for c in (0, 1)]
    scale = toxicity.scales(sample, tuple(n))
    assert scale[[h % toxicity.DIMENSION for w in ("grobian", "volk") for h in toxicity.term_hashes(w)]].max() < 1
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(sample), threshold=0.5).collect()}
    assert np.mean([got[i] == y for i, _, y in rows if i % 3 == 0]) > 0.95


def test_no_word_or_stem_is_left_out():
    rows, values = toxicity.Terms()("A bc déf ghijklmnop x2y")
    assert len(rows) == 6 + 1 + 5 and (values > 0).all()
    assert len(toxicity.Terms()(None)[0]) == 0


def brute_score(machine, text):
    """Every pair of rows by itself."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    x = Counter()
    for w in words:
        for term in [w] + [f"^{w[:n]}" for n in range(3, 8) if n <= len(w)]:
            x[zlib.crc32(term.encode()) % len(machine.table)] += 1 / len(words) ** 0.5
    x = {r: v * machine.scale[r] for r, v in x.items()}
    z = machine.bias + sum(v * machine.table[r, 0] for r, v in x.items())
    z += sum(x[a] * x[b] * float(machine.table[a, 1:] @ machine.table[b, 1:]) for a, b in itertools.combinations(x, 2))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_score_equals_brute_force_on_odd_rows(spark):
    rows = corpus(200, 3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.fit(toxicity.training_sample(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), labels), epochs=2)
    odd = [(1, None), (2, ""), (3, "gronkas blithwort " * 3), (3, "gronkas blithwort " * 3), (None, "marake é"), (4, "a bb ccc"), (5, " ".join(rows[0][1].split()[:60]))]
    got = toxicity.score(spark.createDataFrame([(i, t, "x") for i, t in odd], "doc_id long, text string, score string"), machine).collect()
    assert sorted(((r.doc_id, round(r.score, 9), r.predicted) for r in got), key=repr) == sorted(((i, round(s := brute_score(machine, t), 9), int(s >= 0.7)) for i, t in odd), key=repr)


def test_training_is_bounded_in_rows_and_bytes(spark):
    rows = corpus(120, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, per_class=7)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 7, 1: 7}
    assert toxicity.fit(sample, most_bytes=0).scale is None


def test_very_long_text_is_scored_whole(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(300_000)]
    machine = toxicity.train([(np.array([1]), np.array([1.0])), (np.array([2]), np.array([1.0]))], [0, 1], epochs=2)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words) + " grobian" * 5000)], "doc_id long, text string")
    one, two = sorted(toxicity.score(docs, machine).collect(), key=lambda r: r.doc_id)
    assert 0 <= one.score <= 1 and one.score != two.score


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.fit(toxicity.training_sample(none, labels))
    assert toxicity.score(none, machine).count() == 0
    some = spark.createDataFrame([(1, "words here"), (1, "words here")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(some, machine).collect()] == [0, 0]
