import random

from pyspark.sql import functions as F

from quarrylight.operators import containment
from quarrylight.operators.containment import candidates, contained


def pairs(found):
    return sorted((r["needle"], r["k"]) for r in found.collect())


def brute(needles, texts):
    return sorted((n, k) for n in {n for n in needles if n} for k, t in texts if t is not None and n in t)


def test_equals_brute_force_for_needles_of_all_lengths(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("ab\nä") if rng.random() < 0.9 else "😀" for _ in range(rng.randrange(0, 400)))) for k in range(120)] + [(200, None), (201, ""), (202, "ab" * 20_000), (202, "ab" * 20_000)]
    needles = [None, "", "nowhere at all, in no text"]
    for size in (1, 2, 3, 5, 6, 7, 14, 15, 16, 30, 31, 32, 62, 63, 64, 150):
        for _ in range(6):
            text = rng.choice([t for _, t in texts if t and len(t) >= size])
            at = rng.randrange(len(text) - size + 1)
            needles += [text[at : at + size], text[at : at + size - 1] + "c"]
    found = contained(spark.createDataFrame([(n, 1) for n in needles], "needle string, text_id int"), spark.createDataFrame(texts, "k int, text string").repartition(3))
    assert pairs(found) == brute(needles, texts)


def test_no_needles_or_texts(spark):
    none, some = spark.createDataFrame([], "needle string"), spark.createDataFrame([("abc",)], "needle string")
    texts = spark.createDataFrame([(1, "abcd")], "k int, text string")
    assert pairs(contained(none, texts)) == [] and pairs(contained(some, texts.limit(0))) == [] and pairs(contained(some, texts)) == [("abc", 1)]


def test_few_pairs_are_compared_and_no_plan_pairs_all(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    common = " ".join(word() for _ in range(12))
    texts = [(k, common + " " + " ".join(word() for _ in range(60))) for k in range(300)]
    needles = [(k, t[k % 40 + 90 : k % 40 + 160]) for k, t in texts[:100]]
    asked = spark.createDataFrame(needles, "needle_id long, needle string")
    held = spark.createDataFrame(texts, "text_id long, text string")
    compared = candidates(asked, held).count()
    right = sum(n in t for _, n in needles for _, t in texts)
    assert right <= compared < 1.2 * right + 20 < 0.02 * len(needles) * len(texts)
    for rows in (containment.BROADCAST_ROWS, 0):
        monkeypatch.setattr(containment, "BROADCAST_ROWS", rows)
        found = contained(asked, held.withColumn("k", F.col("text_id").cast("int")).drop("text_id"))
        plan = found._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert found.count() == sum(n in t for n in {n for _, n in needles} for _, t in texts)
