import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quarrylight.llm import resampling

ODD = [(1, None), (2, ""), (3, "  ...  "), (4, "a b c " * 30), (4, "a b c " * 30), (5, "ÄB äb straße_x 12 " * 9), (None, "d e f g " * 8), (6, "Target words here " * 10), (7, "x"), (8, ".a b."), (9, "word " * 60_000), (10, "a\nb\tc-d " * 5), (11, "a b c " * 30)]
TARGET = ["target words here and a b", None, "", "zz zz zz"]


def brute(docs, target, orders, buckets=50, seed=7, min_words=5, percent=40):
    def runs(text):
        ws = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [" ".join(ws[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(ws) - n + 1)]

    of = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = (Counter(of(r) for x in texts for r in runs(x)[1]) for texts in ([x for _, x in docs], target))
    total_s, total_t, rows = sum(s.values()), sum(t.values()), []
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    for i, text in docs:
        n, found = runs(text)
        weight = sum(gain[of(r)] for r in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def frames(spark, docs, target):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, bucket string, n int").repartition(3), spark.createDataFrame([(t, "y") for t in target], "text string, word string")


@pytest.mark.parametrize("orders", [(1, 1), (1, 2), (2, 3), (1, 3), (3, 3)])
def test_equals_brute_force_on_odd_rows(spark, orders):
    docs, target = frames(spark, ODD, TARGET)
    got = resampling.resample(docs, target, orders=orders, buckets=50, seed=7, min_words=5, percent=40)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ODD, TARGET, orders)


def test_empty_tables(spark):
    docs, target = frames(spark, [], TARGET)
    assert resampling.resample(docs, target).count() == 0
    docs, target = frames(spark, ODD, [])
    got = resampling.resample(docs, target, buckets=50, seed=7, min_words=5, percent=40)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ODD, [], (1, 1))


def test_documents_like_the_target_are_drawn_more_often(spark):
    docs = [(k, ("alpha beta gamma " if k % 2 else "delta epsilon zeta ") * 10) for k in range(400)]
    got = resampling.resample(*frames(spark, docs, ["alpha beta gamma"] * 50), percent=20).filter("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 81))
    assert sum(r["doc_id"] % 2 for r in got) > 60
