import difflib
import json

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import answers

CLAIMS = "answer_id string, abstained boolean, claims array<struct<text:string,source:string,citations:array<struct<label:string,quote:string>>>>"
SENT = "answer_id string, label int, chunk_id string, verbatim_text string, text_provenance string"
BODY = "The pump needs 0.831 bar, at least; read the manual."


def cite(*pairs):
    return [(label, quote) for label, quote in pairs]


def frames(spark):
    rows = [
        ("good", False, [("c", "documents", cite(("1", "the PUMP needs 0.831 bar")))]),
        ("absent", False, [("c", "documents", cite(("1", "the pump needs 0.900 bar")))]),
        ("made_up", False, [("c", "documents", cite(("7", "the pump needs")))]),
        ("no_number", False, [("c", "documents", cite(("one", "the pump needs")))]),
        ("short", False, [("c", "documents", cite(("1", "0.831 bar at")))]),
        ("caption", False, [("c", "documents", cite(("2", "the pump needs 0.831 bar")))]),
        ("uncited", False, [("c", None, [])]),
        ("uncited_abstained", True, [("c", "documents", [])]),
        ("mislabelled", False, [("c", "conversation", cite(("1", "the pump needs 0.831 bar")))]),
        ("talk", False, [("c", "conversation", [])]),
        ("nothing", True, []),
    ]
    answered = spark.createDataFrame(rows, CLAIMS)
    sent = spark.createDataFrame([(r[0], 1, "k1", BODY, "verbatim") for r in rows] + [(r[0], 2, "k2", None, "model_generated") for r in rows], SENT)
    return answered, sent


def test_verification(spark):
    answered, sent = frames(spark)
    checks = answers.citation_checks(answered, sent)
    status = {r.answer_id: (r.fabricated, r.quote_status) for r in checks.collect()}
    assert status == {"good": (False, "verified"), "absent": (False, "absent"), "made_up": (True, "no_quote"), "no_number": (True, "no_quote"), "short": (False, "no_quote"), "caption": (False, "unquotable"), "mislabelled": (False, "verified")}
    told = {r.answer_id: r for r in answers.reconcile_answers(answered, checks, sent).collect()}
    assert {k for k, r in told.items() if r.grounded} == {"good", "caption", "uncited_abstained", "talk", "nothing"}
    assert told["uncited"].claims_uncited == 1 and told["mislabelled"].claims_mislabelled == 1 and told["good"].chunks_sent == 2
    assert answers.integrity(answers.reconcile_answers(answered, checks, sent)).first().state == "FAILS"
    empty = answers.reconcile_answers(answered.limit(0), checks.limit(0), sent.limit(0))
    assert answers.integrity(empty).first().state == "NOT_MEASURED"
    share = {r.answer_id: r.overlap for r in answers.with_overlap(checks).collect()}
    q, t = "thepumpneeds0900bar", "thepumpneeds0831baratleastreadthemanual"
    want = sum(b.size for b in difflib.SequenceMatcher(None, q, t).get_matching_blocks() if b.size >= 3) / len(q)
    assert share["good"] == 1.0 and share["made_up"] == 0.0 and share["absent"] == pytest.approx(want)


def test_eleven_and_twelve_characters(spark):
    rows = spark.createDataFrame([("abcdefghijk", "abcdefghijkl", "verbatim"), ("abcdefghijkl", "abcdefghijkl", "verbatim"), ("abcdefghijkl", "", "verbatim")], "q string, v string, p string")
    assert [r[0] for r in rows.select(answers.quote_status(F.col("q"), F.col("v"), F.col("p"))).collect()] == ["no_quote", "verified", "unquotable"]


def test_spans_and_salvage(spark):
    assert answers.locate_span("pump NEEDS", BODY) == (4, 14) and BODY[4:14] == "pump needs"
    assert answers.locate_span("é1", "x É-1") == (2, 5) and answers.locate_span("", "x") is None and answers.locate_span("zz", "x") is None
    whole = json.dumps({"answer_markdown": 'He said "no" \\ é\n', "claims": []})
    assert answers.salvage(whole) == 'He said "no" \\ é\n'
    for cut in range(24, len(whole)):
        assert 'He said "no" \\ é\n'.startswith(answers.salvage(whole[:cut]))
    assert answers.salvage("no json") == "" and answers.salvage(None) == ""
    got = answers.parsed_answers(spark.createDataFrame([(1, whole), (2, whole[:40]), (3, None)], "k int, raw string")).collect()
    assert {r.k: r.truncated for r in got} == {1: False, 2: True, 3: True}


def test_condense(spark):
    rows = [("q one", "", "conversation_only", "other", False, None), ("q two", "h", "conversation_only", " ", False, False), ("short", "h", "documents", "a much longer rewrite", True, False), ("short", "h", "documents", "a rewrite", None, None), ("fails", "h", None, None, None, True)]
    got = answers.condensed(spark.createDataFrame(rows, "question string, history string, route string, search_query string, topic_shift boolean, failed boolean")).collect()
    assert [(r.route, r.search_query, r.fallback, r.searches) for r in got] == [("documents", "q one", False, True), ("conversation_only", "q two", False, False), ("documents", "short", False, True), ("documents", "a rewrite", False, True), ("documents", "fails", True, True)]


def test_injected_models(spark):
    prompts = spark.createDataFrame([("a", "p one"), ("b", "p one"), ("c", "p two")], "key string, prompt string")
    got = {r.key: r.text for r in answers.generated(prompts, str.upper, "answer").collect()}
    assert got == {"a": "P ONE", "b": "P ONE", "c": "P TWO"}
    with pytest.raises(Exception, match="empty answer"):
        answers.generated(prompts, lambda _: "", "answer").collect()
    pairs = answers.swapped(spark.createDataFrame([(k, "q", "a", ["x", "y"]) for k in range(40)], "item_id int, question string, answer string, sources array<string>"), "item_id", 3)
    told = answers.judged(pairs, lambda q, a, s: s[0], "judge", "writer").collect()
    assert {(r.order_swapped, r.faithfulness) for r in told} == {(True, "y"), (False, "x")}
    with pytest.raises(ValueError, match="same model"):
        answers.judged(pairs, lambda *_: "", "m", "m")
