import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a b c", "a a a a", "a b c a b c", "a b c d a b c", "x y x y x y", "one\ntwo\none\n\n \none", "é ü #$ <b>|", "\x1cα\x85 b", "w " * 60, "A B C!! " * 20, "the cat sat on the mat " * 30, "😀 😀 😀 😀"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab #\n\tÄ", max_size=60), max_size=40))
def test_measurements(spark, texts):
    rows = list(enumerate(TEXTS + texts))
    got = quality.ledger(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_words string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in rows}


def test_policies_and_ablations(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"word{i}$$$" for i in range(80))
    rows = [(1, clean), (2, junk), (3, "too short"), (4, None), (5, "LOUD " + " ".join(f"WORD{i}" for i in range(80))), (1, clean), (None, "same words here " * 40)]
    frame = quality.apply_policy(quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r.doc_id or 0, r.kept) for r in frame.collect()) == [(0, False), (1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(frame).collect()}
    bits = [r.failed for r in frame.collect()]
    for rule in quality.RULES:
        bit = 1 << rule.bit
        assert got[rule.name] == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    empty = quality.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and quality.ablations(empty).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = quality.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
