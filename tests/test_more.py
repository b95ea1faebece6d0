import pytest

from quarrylight.__main__ import main
from quarrylight.operators import answers, evaluation, index, lifecycle
from quarrylight.plans import catalog
from quarrylight.streaming.limits import retry_delay


def test_arms_of_one_pipeline_are_refused(spark):
    rows = [("a", "f1", "delivered", 500, True), ("a", "f1", "delivered", 500, False), ("b", "f2", "delivered", 500, True)]
    ddl = "arm string, fingerprint string, basis string, budget int, strict boolean"
    got = evaluation.ab_grid(spark.createDataFrame(rows, ddl), "a", "b").first()
    assert (got.a_hits, got.a_n, got.b_hits, got.b_n) == (1, 2, 1, 1)
    with pytest.raises(ValueError, match="same fingerprint"):
        evaluation.ab_grid(spark.createDataFrame([(a, "f", *r) for a, _, *r in rows], ddl), "a", "b")


def test_mixed_indexes_are_refused(spark):
    ddl = "pipeline_fingerprint string, role string, text_provenance string, has_contextual_prefix boolean"
    even = spark.createDataFrame([("f", "child", "prefixed", True), ("f", "child", "model_generated", False), ("f", "parent", "verbatim", False)], ddl)
    metrics = spark.createDataFrame([("strict", 0.9, 92)], "metric string, rate double, n long")
    assert evaluation.baseline(metrics, even).first().fingerprint == "f"
    for more in (("g", "child", "prefixed", True), ("f", "child", "prefixed", False)):
        with pytest.raises(ValueError, match="mixed"):
            evaluation.baseline(metrics, even.union(spark.createDataFrame([more], ddl)))


def test_uploads_are_added_to_their_own_pipeline_only(spark):
    old, new = (spark.createDataFrame([(k, p)], "k int, pipeline_fingerprint string") for k, p in ((1, "f"), (2, "f")))
    assert lifecycle.appended(old, new, "f").count() == 2
    with pytest.raises(ValueError, match="other pipelines"):
        lifecycle.appended(old, new, "g")
    jobs = spark.createDataFrame([("a", "running", None), ("b", "done", None)], "job_id string, state string, error string")
    assert {r.job_id: r.state for r in lifecycle.interrupted(jobs).collect()} == {"a": "failed", "b": "done"}
    assert lifecycle.latest(spark.createDataFrame([(1, "a"), (3, "c"), (3, "b")], "t int, k string"), "t", "k", 2).collect()[0].k == "b"


def test_models_are_functions(spark):
    turns = spark.createDataFrame([("k", ["one", "two"], "and?")], "key string, history array<string>, question string")
    told = answers.from_conversation(turns, lambda p: p.replace("\n", " ")).first()
    assert told.text == "Conversation so far: one two  Question: and?" and told.verification == "not_applicable"
    images = spark.createDataFrame([(1, bytearray(b"x"), None), (2, bytearray(b"x"), None), (3, bytearray(b"y"), "c")], "image_id int, content binary, context string")
    got, made = answers.captioned(images, spark.createDataFrame([], "cache_key string, value string"), lambda c: "an x" if c == b"x" else None)
    assert {r.image_id: r.caption for r in got.collect()} == {1: "an x", 2: "an x", 3: None} and made.count() == 1
    pairs = spark.createDataFrame([([1.0, 2.0, 9.0], [1.0, 2.0])], "long array<double>, short array<double>")
    assert index.truncation_equivalence(pairs, 2).first().equivalent
    assert not index.truncation_equivalence(pairs.limit(0), 2).first().equivalent


def test_delays():
    assert retry_delay("429, retryDelay: 17.5s", 3) == 17.5
    assert [retry_delay("quota", k, chance=0.0) for k in range(3)] == [1.0, 2.0, 4.0]


def test_every_catalogue_query_is_named_and_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 80


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.md").write_text("# Pump manual\nUse it well.\n## Codes\nERR_5521 means no water.\n")
    out = str(tmp_path / "out")
    assert main(["list"]) == 0 and "r20_retrieve" in capsys.readouterr().out
    assert main(["run", "nothing", str(tmp_path)], spark) == 2
    assert main(["ingest", str(tmp_path / "in"), out], spark) == 0
    assert main(["reconcile", out], spark) == 0
