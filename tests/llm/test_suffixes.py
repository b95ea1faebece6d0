import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import suffixes


def brute(rows, length=50):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for k in range(len(data) - length + 1):
                s = data[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if i is not None:
            for k in range(len(data) - length + 1):
                if first[data[k : k + length]] < i:
                    gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "über", "a", "tion", "zz9", "😀", "word", "\n"]

    def text(k):
        return " ".join(rnd.choice(words) + rnd.choice(["", "x", "q7"]) for _ in range(k))

    shared = [text(rnd.randint(9, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rnd.randrange(5)
        if kind == 0 and rows:
            rows.append((i, rnd.choice(rows)[1]))
        elif kind == 1 and rows:
            other = list(rnd.choice(rows)[1])
            if other:
                other[rnd.randrange(len(other))] = "#"
            rows.append((i, "".join(other)))
        else:
            rows.append((i, text(rnd.randint(0, 60)) + rnd.choice(shared) * rnd.randint(0, 2) + text(rnd.randint(0, 30)) + rnd.choice(shared)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * 200), (n + 3, "ab" * 90), (n + 4, "c" + "ab" * 30), (n + 5, "x" * 49), (n + 6, "x" * 49), (n + 7, "y" * 50), (n + 8, "y" * 50), (3, rows[5][1]), (None, rows[5][1]), (8, rows[8][1])]
    rnd.shuffle(rows)
    return rows


def removed(spark, rows, rows_a_batch=2000):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    got = suffixes.removal_report(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_spans int")).collect()
    return Counter(tuple(r) for r in got)


@pytest.mark.parametrize(("seed", "rows_a_batch", "hot", "few"), [(1, 2000, 1 << 18, 32), (2, 5, 1 << 18, 32), (3, 5, 100, 32), (4, 2, 400, 2), (5, 2, 1, 32)])
def test_against_brute_force(spark, monkeypatch, seed, rows_a_batch, hot, few):
    monkeypatch.setattr(suffixes, "HOT_STRINGS", hot)
    monkeypatch.setattr(suffixes, "FEW_STRINGS", few)
    rows = corpus(seed)
    assert removed(spark, rows, rows_a_batch) == brute(rows)
    assert suffixes.removal_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_repeated_thousands_of_times(spark):
    passage = "a passage of well over fifty bytes that the repeated rows and one other text share"
    rows = [(7, f"{passage} seven")] * 5000 + [(9, f"nine {passage}"), (8, f"{passage} seven"), (7, f"other text of seven, {passage}"), (None, passage)]
    assert removed(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [1 << 18, 5000])
def test_one_passage_in_every_text(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_STRINGS", hot)
    rnd = random.Random(5)
    passage = " ".join(f"common{k}" for k in range(12))
    rows = [(k, f"{rnd.random()} {rnd.random()} {passage} {rnd.random()}") for k in range(4000)]
    rows += [(4000 + k, "so it is " * rnd.randint(10, 400)) for k in range(60)]
    rnd.shuffle(rows)
    assert removed(spark, rows, 500) == brute(rows)


def test_very_long_texts(spark, monkeypatch):
    rnd = random.Random(6)
    text = " ".join(f"{rnd.getrandbits(40):x}" for _ in range(120_000))
    assert len(text) > 1 << 20
    rows = [(1, text), (2, text[400_000:700_000] + " end"), (3, "begin#" + text[131_000:131_200]), (4, text + "!"), (5, "no " * 50_000)]
    got = {r[0]: r for r in removed(spark, rows)}
    assert (got[1][2], got[2][2], got[3][2], got[4][2]) == (0, 300_000, 200, len(text))
    assert got[2][4] == hashlib.sha256(b" end").hexdigest() and got[4][4] == hashlib.sha256(b"!").hexdigest()
    assert got[5][2] == 0


def test_strings_are_sorted_in_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED", 64)
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("ab") for _ in range(90)).encode() for _ in range(30)]
    texts += texts[:10]
    owner, start, count, value = suffixes._runs_of(texts, 50)
    blob = suffixes._pack_runs(np.arange(40), np.arange(40), owner, start, count, value, [texts[k][s : s + n + 49] for k, s, n in zip(owner.tolist(), start.tolist(), count.tolist())])
    got = Counter()
    for doc, _, spans in suffixes._settle_runs([blob], 50):
        for s, e in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
            got.update((doc, k) for k in range(s, e))
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = {(i, k + j) for i, t in enumerate(texts) for k in range(len(t) - 49) if first[t[k : k + 50]] < i for j in range(50)}
    assert set(got) == want


def test_digests_name_equal_strings():
    text = np.frombuffer(b"abcde" * 60 + bytes(range(100)), np.uint8)
    one, two = suffixes.digests(text)
    strings = [text[k : k + 50].tobytes() for k in range(len(one))]
    assert len(set(zip(one.tolist(), two.tolist()))) == len(set(one.tolist())) == len(set(two.tolist())) == len(set(strings))
    names = dict(zip(strings, one.tolist()))
    assert [names[s] for s in strings] == one.tolist()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=60, max_size=400).map(lambda b: bytes(x % 2 for x in b)), st.integers(26, 50), st.randoms(use_true_random=False))
def test_sort_names_equal_strings(data, length, rnd):
    text = np.frombuffer(data + data[:70], np.uint8)
    starts = np.array(sorted(rnd.sample(range(len(text) - length + 1), (len(text) - length + 1) // 2 + 1)))
    owners = np.array([rnd.randrange(9) for _ in starts])
    least = {}
    for s, o in zip(starts.tolist(), owners.tolist()):
        key = text[s : s + length].tobytes()
        least[key] = min(least.get(key, o), o)
    assert suffixes.least_owners(text, starts, owners, length).tolist() == [least[text[s : s + length].tobytes()] for s in starts.tolist()]


def test_minimizers_are_the_least_of_their_strings():
    text = np.random.default_rng(1).integers(0, 4, 300).astype(np.uint8)
    whole = suffixes.minimizers(text)
    for k in range(0, 251, 10):
        assert suffixes.minimizers(text[k : k + 50])[0] == whole[k]
    assert len(suffixes.minimizers(text[:49])) == 0


def test_remove_repeats(spark):
    passage = "A passage of well over fifty bytes that two of the documents share, é."
    rows = [(1, "First. " + passage, "a", 7), (2, passage + " Last.", "b", 7), (3, None, "c", 0), (4, passage, "d", 1)]
    got = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == [rows[0][1], " Last.", None, ""]
    assert [got[i].lang for i in (1, 2, 3, 4)] == list("abcd")
    assert [got[i].n_chars for i in (1, 2, 3, 4)] == [len(rows[0][1]), 6, None, 0]
