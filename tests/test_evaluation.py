import pytest

from quarrylight.operators import evaluation as E
from quarrylight.operators import invariants


def pairs(spark, counts):
    return spark.createDataFrame([(a, b) for (a, b), n in counts.items() for _ in range(n)], "a string, b string")


def test_published_kappa(spark):
    got = E.kappa(pairs(spark, {("partly", "partly"): 12, ("supported", "supported"): 10, ("unsupported", "unsupported"): 6, ("partly", "unsupported"): 1, ("unsupported", "partly"): 1}), "a", "b").first()
    assert (got.kappa, got.raw_agreement, got.chance_agreement, got.dominant_class_share, got.n, got.sufficient, got.prevalence_warning) == (0.897, 0.933, 0.353, 0.433, 30, True, False)
    assert E.kappa(pairs(spark, {("x", "x"): 5}), "a", "b").first().kappa == 1.0
    assert E.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    gate = E.judge_gate(E.kappa(pairs(spark, {("x", "x"): 20, ("y", "y"): 12}), "a", "b"), "m", "m").first()
    assert gate.validated and gate.collision and not gate.may_emit


def test_published_failures(spark):
    causes = ["partial"] * 6 + ["absent"] * 7 + ["starved", "miss_answered"]
    first = spark.createDataFrame([(f"q{k}", c) for k, c in enumerate(causes)], "question string, cause string")
    again = spark.createDataFrame([("q0", "present")], "question string, cause string")
    got = {r.point: (r.n, r.share) for r in E.failure_histogram([first, again]).collect()}
    assert got == {"FP2": (8, 0.533), "FP3": (7, 0.467)}
    with pytest.raises(Exception, match="unknown cause"):
        E.failure_histogram([spark.createDataFrame([("q", "odd")], "question string, cause string")]).collect()


def test_scores(spark):
    items = spark.createDataFrame([("one", "the pump needs water", ["s1"]), ("two", "alpha beta gamma", ["s2"]), ("two", "missing thing here", ["s2"]), ("half", "abcdefgh12345678", ["s3"]), ("less", "abcdefgh12345678", ["s3"]), ("none", "zzz", ["s9"])], "item_id string, needle string, accept array<string>")
    given = [("one", "child", 0, "s0", "The PUMP needs"), ("one", "child", 1, "s1", "... the pump NEEDS: water"), ("two", "child", 0, "s2", "Alpha, beta. Gamma"), ("half", "child", 0, "s4", "x abcdefgh y"), ("less", "child", 0, "s4", "x abcdefg y")]
    got = {r.item_id: r for r in E.score_items(items, spark.createDataFrame(given, "item_id string, unit string, rank int, source_id string, text string")).collect()}
    assert (got["one"].strict, got["one"].source_hit, got["one"].rank_first_hit) == (True, True, 1)
    assert (got["two"].strict, got["two"].partial, got["two"].needle_fraction) == (False, True, 0.5)
    assert (got["half"].strict, got["half"].partial, got["half"].source_hit) == (False, True, False)
    assert (got["less"].partial, got["none"].partial, got["none"].unit) == (False, False, None)


def test_slices_leave_out_skipped_and_quarantined(spark):
    rows = [("m" if k < 12 else "n", k % 2 == 0, True, True, k == 20, k == 21, k, False) for k in range(22)]
    frame = spark.createDataFrame(rows, "stratum string, strict boolean, partial boolean, source_hit boolean, skipped boolean, quarantined boolean, tokens int, no_delivery boolean")
    got = {(r.slice, r.value): r for r in E.aggregate_items(frame, ["stratum"]).collect()}
    assert got["headline", ""].n_items == 20 and got["headline", ""].strict_label == "10/20 = 50%"
    assert got["stratum", "m"].strict_rate == 0.5 and got["stratum", "n"].strict_rate is None and got["stratum", "n"].strict_label == "4 of 8"
    assert {r.stratum: (r.present, r.thin) for r in E.coverage(frame.replace("n", "multi_hop", "stratum"), ("multi_hop", "ambiguous")).collect()} == {"multi_hop": (True, False), "ambiguous": (False, False)}


def test_windows_needles_and_questions(spark):
    blocks = [("s", "pdf", 1, 1, "text", "b" * 150, None), ("s", "pdf", 1, 0, "table", "a" * 60 + " ERR_1", "x.png"), ("s", "pdf", 2, 0, "text", "short", None), ("s", "pdf", 1, 2, "text", "  ", None)]
    pages = E.windows(spark.createDataFrame(blocks, "source_id string, doc_type string, page int, ordinal int, kind string, text string, asset_path string"), ("ERR_",))
    row = pages.collect()[0]
    assert pages.count() == 1 and row.text.startswith("aaa") and row.has_table and row.has_identifier and row.asset_path == "x.png"
    items = spark.createDataFrame([("i", "s", "b" * 13), ("i", "s", "b" * 14), ("j", "t", "b" * 20), ("k", "s", "q" * 20), ("l", "s", "b" * 161)], "item_id string, source_id string, needle string")
    got = {r.item_id: r for r in E.verify_items(items, E.occurrences(items.select("item_id", "needle"), pages)).collect()}
    assert (got["i"].n_good, got["i"].n_length, got["i"].is_unique, got["i"].kept) == (1, 1, True, True)
    assert (got["j"].kept, got["j"].n_unlocatable, got["k"].kept, got["l"].n_length) == (False, 1, False, 1)
    asked = spark.createDataFrame([(1, "Which quantum entanglement experiments matter?"), (2, "no")], "question_id int, question string")
    held = spark.createDataFrame([("s", "quantum entanglement and experiments")], "source_id string, text string")
    assert {r.question_id: r.rejected for r in E.answerable(asked, held).collect()} == {1: True, 2: False}


def test_gates(spark):
    now = spark.createDataFrame([("a", 0.80, 20), ("b", 0.80, 20), ("c", 0.9, 5), ("d", 0.9, 50)], "metric string, rate double, n long")
    base = spark.createDataFrame([("a", 0.83, 20), ("b", 0.84, 20), ("c", 0.9, 50)], "metric string, rate double, n long")
    assert {r.metric: r.holds for r in E.regression_gate(now, base).collect()} == {"a": True, "b": False, "c": False, "d": False}
    stamps = lambda rows: E.require_comparable(spark.createDataFrame(rows, "fingerprint string, budget int")).first().comparable
    assert stamps([("f", 1), ("f", 1)]) and not stamps([("f", 1), ("g", 1)]) and not stamps([("f", None)]) and not stamps([])
    assert E.index_provenance(spark.createDataFrame([("x",), ("y",)], "pipeline_fingerprint string")).first().fingerprint == "MIXED"


def test_a_check_over_nothing_is_not_measured(spark):
    empty = spark.createDataFrame([], "strict boolean, partial boolean")
    assert invariants.scoring_check(empty).first().state == "NOT_MEASURED"
    bad = spark.createDataFrame([(True, False)], "strict boolean, partial boolean")
    assert invariants.scoring_check(bad).first().state == "FAILS"
    names = spark.createDataFrame([("golden", 5), ("index", 0)], "name string, n long")
    assert {r.name: r.state for r in invariants.artifact_checks(names, ["golden", "index", "report"]).collect()} == {"artifact_golden": "HOLDS", "artifact_index": "FAILS", "artifact_report": "NOT_MEASURED"}


def test_balanced_sample_is_the_same_however_it_is_partitioned(spark):
    items = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(90)], "item_id int, c string")
    one = sorted(r.item_id for r in E.balanced_sample(items, "c", 10, 5).collect())
    assert one == sorted(r.item_id for r in E.balanced_sample(items.repartition(7), "c", 10, 5).collect()) and len(one) == 20


def test_failed_verdicts_pair_with_nothing_and_are_judged_again(spark):
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "item_id int, label string")
    verdicts = spark.createDataFrame([(1, "x", False), (2, "y", True), (3, None, None)], "item_id int, verdict string, failed boolean")
    assert [tuple(r) for r in E.rated(labels, verdicts).collect()] == [(1, "x", "x")]
    assert {r.item_id for r in E.unjudged(labels, verdicts).collect()} == {2, 3}


def test_gated_sections_show_only_behind_a_held_gate(spark):
    from quarrylight.plans import evaluate

    stored = {"rates": spark.createDataFrame([(1, None)], "n int, rate double"), "judged": spark.createDataFrame([(2,)], "n int")}
    shown = lambda ok: {tuple(r) for r in evaluate.inspector(stored, spark.createDataFrame([(ok,)], "may_emit boolean"), ("judged",)).collect()}
    assert shown(True) == {("rates", '{"n":1,"rate":null}'), ("judged", '{"n":2}')}
    assert shown(False) == shown(None) == {("rates", '{"n":1,"rate":null}')}


def test_round_trip_counts_faults_on_both_sides(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    row = invariants.round_trip_check(left, right, ["k"], "x", "y").first()
    assert (row["state"], row["observed"], row["n"]) == ("FAILS", "2", 3)
    assert invariants.round_trip_check(left.limit(0), right.limit(0), ["k"], "x", "y").first()["state"] == "NOT_MEASURED"
