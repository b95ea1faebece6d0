import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from test_sources import docx

from quarrylight.operators import segments
from quarrylight.plans import library as L
from quarrylight.sources import versions
from quarrylight.streaming import citations

DOC = "owner string, source_id string, title string, text string, origin string, content_hash string"
GONE = "owner string, source_id string"
AT = dt.datetime(2024, 5, 1)


def doc(source, text, owner=""):
    return (owner, source, f"T {source}", text, "upload" if owner else "corpus", hashlib.sha256(text.encode()).hexdigest())


def stand_in():
    def embedder(texts):
        if any("never embed" in t for t in texts):
            raise ValueError("an unchanged text was embedded")
        return [[float(len(t) % 7 + 1), float(t.count("a") + 1)] + [0.0] * 62 for t in texts]

    return embedder


model = stand_in()


def body(word, n=60):
    return "# Head\n\n" + f"A sentence about {word} and apples. " * n


def state(library):
    """What a library holds, but times and the order of rows."""
    return {
        "manifest": sorted((r.owner, r.source_id, r.content_hash, r.n_chunks, tuple(r.chunk_ids), tuple(r.cache_keys)) for r in library.table("manifest").collect()),
        "chunks": sorted((r.chunk_id, r.display_text) for r in library.table("chunks").collect()),
        "vectors": sorted((r.owner, r.source_id, r.chunk_id, tuple(r.vec)) for r in library.table("vectors").collect()),
        "cache": sorted(r.cache_key for r in library.table("cache").collect()),
        "terms": sorted((r.term, r.df) for r in library.index.terms().collect()),
        "n": (library.index.n, library.index.tokens),
    }


def test_removing_and_adding_again_equals_a_library_from_scratch(spark, tmp_path):
    frame = lambda docs: spark.createDataFrame(docs, DOC)
    first = [doc("a", body("pears")), doc("b", body("plums")), doc("c", body("pears")), doc("mine", body("figs"), "me")]
    held = L.added(L.load(spark, str(tmp_path / "x")), frame(first), model, fingerprint="f")
    kept = held.version
    turns = spark.createDataFrame([(1, 0, [("a",), ("b",)], "old"), (2, 0, [("b",)], "f")], "conversation_id long, turn_index long, sources array<struct<source_id string>>, pipeline_fingerprint string")
    citations.apply_batch(spark, str(tmp_path / "x" / "citations"), turns, 0)
    gone = spark.createDataFrame([("", "a"), ("", "unknown"), ("me", "b")], GONE)
    assert sorted(map(tuple, L.preview(held, gone, "f").collect())) == [("a", 1, 1, 1), ("b", 1, 1, 1), ("b", 2, 1, 0)]
    before = {r.source_id: r.chunk_ids[0] for r in held.table("manifest").collect()}

    less = L.removed(held, gone, F.lit(AT))
    rest = L.added(L.load(spark, str(tmp_path / "y")), frame(first[1:]), model, fingerprint="f")
    assert state(less) == state(rest)
    assert [(r.source_id, r.n_chunks > 0) for r in less.table("tombstones").collect()] == [("a", True)]
    asked = spark.createDataFrame([(before["a"],), (before["b"],), (before["mine"],), ("none",)], "chunk_id string")
    assert {r.chunk_id: r.status for r in L.opened(less, asked, None).collect()} == {before["a"]: 410, before["b"]: 200, before["mine"]: 404, "none": 404}
    assert {r.chunk_id: r.status for r in L.opened(less, asked, "me").collect()}[before["mine"]] == 200
    answers = L.answered_feedback(less, spark.createDataFrame([(before["a"],), (before["b"],)], "chunk_id string")).collect()
    assert {r.chunk_id: r.removed for r in answers} == {before["a"]: True, before["b"]: False}

    again = [doc("a", body("pears")), doc("b", body("grapes", 90))]
    more = L.added(less, frame(again), model, fingerprint="f")
    scratch = L.added(L.load(spark, str(tmp_path / "z")), frame([again[0], again[1], first[2], first[3]]), model, fingerprint="f")
    got, want = state(more), state(scratch)
    assert set(want["cache"]) <= set(got["cache"])
    assert {k: v for k, v in got.items() if k != "cache"} == {k: v for k, v in want.items() if k != "cache"}
    assert more.table("tombstones").count() == 0
    assert state(L.load(spark, str(tmp_path / "x"), kept)) == state(held)
    query = spark.createDataFrame([(1, "grapes", None)], "query_id long, query_text string, caller string")
    found = segments.search(more.index, query, 5).collect()
    assert found and {r.chunk_id for r in found} <= {r.chunk_id for r in more.table("chunks").filter("source_id = 'b'").collect()}


def test_unchanged_sources_are_not_read_and_other_pipelines_refused(spark, tmp_path):
    held = L.added(L.load(spark, str(tmp_path)), spark.createDataFrame([doc("a", body("pears"))], DOC), model, fingerprint="f")
    same = doc("a", body("pears"))
    same = (*same[:3], "never embed " + same[3], *same[4:])
    held = L.added(held, spark.createDataFrame([same, doc("b", body("plums"))], DOC), model, fingerprint="f")
    assert held.table("manifest").count() == 2
    with pytest.raises(ValueError, match="other pipelines"):
        L.added(held, spark.createDataFrame([doc("c", body("figs"))], DOC), model, fingerprint="g")
    assert versions.numbers(spark, str(tmp_path)) == [1, 2]


def test_a_writer_that_dies_leaves_tables_and_index_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    held = L.added(L.load(spark, root), spark.createDataFrame([doc("a", body("pears"))], DOC), model, fingerprint="f")
    before = state(held)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(L, "publish", dies)
        with pytest.raises(RuntimeError, match="killed"):
            L.added(held, spark.createDataFrame([doc("b", body("plums"))], DOC), model, fingerprint="f")
    assert state(L.load(spark, root)) == before
    after = L.added(L.load(spark, root), spark.createDataFrame([doc("b", body("plums"))], DOC), model, fingerprint="f")
    assert sorted(r.source_id for r in after.table("manifest").collect()) == ["a", "b"]
    with pytest.raises(versions.Conflict):
        L.removed(held, spark.createDataFrame([("", "a")], GONE), F.lit(AT))


def test_uploads_are_gated_parsed_and_added_for_their_owner_alone(spark, tmp_path):
    held = L.load(spark, str(tmp_path))
    files = spark.createDataFrame([("/in/notes.docx", docx()), ("/in/evil.pdf", b"not a pdf")], "path string, content binary")
    none, verdicts = L.uploaded(held, files.filter("path LIKE '%pdf'"), model, owner="me", fingerprint="f")
    assert none.version == 0 and [r.code for r in verdicts.collect()] == ["unknown_type"]
    more, verdicts = L.uploaded(held, files, model, owner="me", fingerprint="f")
    assert {r.path: r.accepted for r in verdicts.collect()} == {"/in/notes.docx": True, "/in/evil.pdf": False}
    assert [(r.owner, r.source_id, r.n_chunks > 0) for r in more.table("manifest").collect()] == [("me", "notes.docx", True)]
    chunk = more.table("chunks").filter("role = 'child'").select("chunk_id")
    assert {r.status for r in L.opened(more, chunk, "me").collect()} == {200} and {r.status for r in L.opened(more, chunk, None).collect()} == {404}
