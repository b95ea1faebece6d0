import hashlib
import math
import random
import zlib

import oracle
import pytest

from quarrylight.llm import queries, tries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"


def brute(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ended = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), convs):
        for k in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, rng.choice([None, k, k, k]), rng.choice(["user", "user", None, ""]), rng.choice([None, "", "a", "a", "ä" * 3, "b" * 5000]), 1, "x"))
    return rows + rows[:7] + [(None, 1, "user", "lost", 1, "x")]


def check(spark, rows):
    got = tries.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_odd_rows(spark, seed):
    check(spark, odd_rows(seed))


def test_blocks_salts_and_chunks_change_nothing(spark, monkeypatch):
    """Long conversations of several blocks, common first turns, many copies that end at one node."""
    monkeypatch.setattr(tries, "BLOCK", 4)
    monkeypatch.setattr(tries, "CHUNK", 3)
    monkeypatch.setattr(tries, "SALTS", 5)
    monkeypatch.setattr(tries, "BROADCAST_ROWS", 0)
    rows = [(c, k, "user", f"t{k}", 1, "x") for c in range(25) for k in range(23)]
    rows += [(c, k, "user", "same" if k < 2 else f"u{c % 3}", 1, "x") for c in range(30, 60) for k in range(4)]
    check(spark, rows + odd_rows(3, 10))


def test_empty_table(spark):
    assert tries.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tries.trie(spark.createDataFrame([(None, 1, "user", "a", 1, "x")], SCHEMA)).count() == 0


def test_odd_rows_equal_the_sql(spark, tmp_path):
    spark.createDataFrame(odd_rows(4), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    oracle.same(spark, queries.op11_prefix_trie, queries.OP11_SQL, str(tmp_path))
