import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarrylight.llm import neardup
from quarrylight.operators.components import components


def brute(rows):
    sets = defaultdict(list)
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i].append(frozenset(tuple(words[k : k + 4]) for k in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else []))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() if i is not None for s in many if s]
    for a in range(len(flat)):
        for b in range(a):
            both = len(flat[a][1] & flat[b][1])
            if 100 * both >= 80 * (len(flat[a][1]) + len(flat[b][1]) - both):
                x, y = find(flat[a][0]), find(flat[b][0])
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, many in sets.items() for s in many)


def corpus(seed, families, members):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(40))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "a b c d"), (7, "A B  C\nd")]
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 120, 400]))]
        for _ in range(members):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(text) // 25))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                text.insert(rnd.randrange(len(text)), passage)
            rows.append((len(rows), " ".join(text)))
    # one id with several texts: linked through the id, each text with its own links
    rows += [(8, rows[-1][1]), (10, rows[-2][1]), (10, ""), (len(rows) + 90, rows[10][1] + " and one more word")]
    return rows + [(len(rows) + 5, rows[9][1]), (9, rows[9][1]), (None, rows[9][1])]


@pytest.mark.parametrize(("block", "families", "members", "stars"), [(512, 12, 12, 4), (7, 3, 40, 4), (7, 3, 40, 1)])
def test_against_brute_force(spark, monkeypatch, block, families, members, stars):
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup.links, "__kwdefaults__", neardup.links.__kwdefaults__ | {"block": block})
    rows = corpus(block, families, members)
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string"), words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_thousands_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = [(k, " ".join(base[:at] + [f"own{k}"] + base[at + 1 :])) for k in range(3000) for at in [rnd.randrange(120)]] + [(9000, "an unrelated text of six words")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {(r.component_id, r.kept) for r in got} == {(0, True), (0, False), (9000, True)} and sum(r.kept for r in got) == 2


def test_very_long_text(spark):
    words = [f"w{k}" for k in range(250_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9] + ["x"] * 9)), (3, " ".join(words[:100_000]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 249_997, 1), (2, 249_995 - 3, 1), (3, 99_997, 3)]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimate_is_exact_for_small_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    matrix = np.full((30, 48), neardup.TOP)
    for row, s in zip(matrix, sets):
        row[: len(s)] = s
    n = np.array([len(s) for s in sets])
    got = neardup.similar_by_sketch(matrix, n, matrix, n, 48, 50, 0.5)
    for a in range(30):
        for b in range(30):
            both, union = len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))
            sizes = 100 * min(len(sets[a]), len(sets[b])) >= 50 * max(len(sets[a]), len(sets[b]))
            assert got[a, b] == (both >= 0.5 * union and sizes)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(400 + k, 401 + k) for k in range(60)] + [(7, 7), (None, 3)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in range(500) if find(x) != x}
