import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylight.plans.ingest import ingest
from quarrylight.sources import artifacts, corpus, uploads, versions

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def docx(**members):
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in (["Code", "Part"], ["ERR_5521", "PN-8891-A"])) + "</w:tbl>"
    numbers = "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in (["1", "2"], ["3", "4"])) + "</w:tbl>"
    body = paragraph("Manual", "Title") + paragraph("Errors", "Heading1") + paragraph("See table.") + table + paragraph("Deep", "Heading2") + paragraph(" ") + numbers
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        archive.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>')
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def test_docx():
    got = corpus.load_docx("m.docx", docx())
    assert [(b["kind"], b["heading_path"], b["table_header_missing"]) for b in got] == [("text", ["Manual", "Errors"], False), ("table", ["Manual", "Errors"], False), ("table", ["Manual", "Errors", "Deep"], True)]
    assert got[1]["text"] == "| Code | Part |\n| --- | --- |\n| ERR_5521 | PN-8891-A |"


def test_walk_parse_and_cache(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.md").write_text("# One\ntext\n| a | b |\n| 1 | 2 |\n")
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.png").write_bytes(b"\x89PNG captioned")
    (tmp_path / "d.png").write_bytes(b"\x89PNG other")
    (tmp_path / "skip.bin").write_bytes(b"x")
    files = corpus.walk(spark, str(tmp_path))
    assert files.count() == 4
    blocks, made = corpus.parse(files, caption=lambda raw: "A chart." if raw.endswith(b"captioned") else None)
    got = {r.source_id: r.n for r in blocks.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.md": 2, "b.docx": 3, "c.png": 1}
    again, fresh = corpus.parse(files.filter("path NOT LIKE '%png'"), made, pdf=None)
    assert fresh.count() == 0 and again.count() == 5
    assert corpus.parsed_hash(blocks).count() == 3
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(Exception, match="no loader"):
        corpus.parse(corpus.walk(spark, str(tmp_path)))[0].collect()


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", width, height)


def test_upload_probe(spark):
    cases = {
        ("a.docx", docx()): "ok",
        ("a.docx", docx(**{"../evil": "x"})): "archive_escape",
        ("a.docx", docx(**{"word/big": "0" * 30_000_000})): "archive_bomb",
        ("a.docx", b"PK\x03\x04 broken"): "unreadable",
        ("a.png", png(100, 100)): "ok",
        ("a.png", png(100_000, 100_000)): "too_many_pixels",
        ("a.pdf", png(1, 1)): "suffix_mismatch",
        ("a.txt", b"hello"): "unknown_type",
        ("a.pdf", b"%PDF-1.4 /Type /Page /Type /Pages"): "ok",
        ("b.pdf", b"%PDF-1.4 /JavaScript"): "active_content",
        ("c.pdf", b"%PDF-1.4 /Encrypt"): "encrypted",
        ("d.pdf", b"%PDF-1.4 " + b"/Type /Page " * 501): "too_many_pages",
        ("e.pdf", b"%PDF-" + b"x" * 20_000_001): "too_large",
    }
    assert {k: uploads.probe(*k) for k in cases} == cases
    assert set(cases.values()) <= set(uploads.MESSAGES)
    got = uploads.gated(spark.createDataFrame([("a.png", bytearray(png(9, 9))), ("x", None)], "path string, content binary")).collect()
    assert [(r.accepted, r.code) for r in got] == [(True, "ok"), (False, "unknown_type")]


def test_assets_stay_inside(tmp_path):
    assert uploads.inside(str(tmp_path), "a/b.png") == (tmp_path / "a/b.png").resolve()
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            uploads.inside(str(tmp_path), bad)


def test_artifacts(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    first = artifacts.save_version({"t": one}, str(tmp_path / "index"))
    artifacts.save_version({"t": one.withColumn("v", F.lit("b"))}, str(tmp_path / "index"))
    assert artifacts.load(spark, str(tmp_path / "index"), "t").first().v == "b"
    assert artifacts.load(spark, str(tmp_path / "index"), "t", first).first().v == "a"

    lines = tmp_path / "f.jsonl"
    lines.write_text('{"k": 1, "v": "x"}\n\nnot json\n{"k": 2}\n')
    assert sorted((r.k, r.v) for r in artifacts.read_lines(spark, str(lines), "k int, v string").collect()) == [(1, "x"), (2, None)]
    artifacts.append_lines(one, str(tmp_path / "log"))
    artifacts.append_lines(one, str(tmp_path / "log"))
    assert artifacts.read_lines(spark, str(tmp_path / "log"), "k int, v string").count() == 2
    merged = artifacts.upsert(one.union(spark.createDataFrame([(2, "z")], one.schema)), spark.createDataFrame([(1, "new")], one.schema), ["k"])
    assert sorted((r.k, r.v) for r in merged.collect()) == [(1, "new"), (2, "z")]
    assert artifacts.stamped(one, fingerprint="f", parser="p", chunker="c", budget=1500).first().token_budget == 1500


def test_ingest(spark):
    docs = spark.createDataFrame([("", "a", "T", "# H\nThe red fox.", "corpus", "h1"), ("", "b", "T", "Unchanged.", "corpus", "h2")], "owner string, source_id string, title string, text string, origin string, content_hash string")
    manifest = spark.createDataFrame([("", "b", "h2", "fp"), ("", "z", "h", "fp")], "owner string, source_id string, content_hash string, fingerprint string")
    cache = spark.createDataFrame([], "cache_key string, value array<double>")
    made = ingest(docs, manifest, cache, lambda texts: [[float(len(t)), 1.0, 2.0] + [0.0] * 61 for t in texts], fingerprint="fp")
    assert {r.source_id: r.action for r in made["plan"].collect()} == {"a": "reprocess", "b": "skip", "z": "delete"}
    assert {r.source_id for r in made["chunks"].collect()} == {"a"}
    report = made["report"].first()
    assert (report.n_children, report.n_zero, report.n_orphans, report.uniform_provenance) == (1, 0, 0, True)
    assert made["vectors"].count() == 1 and made["terms"].filter("term = 'fox'").count() == 1 and made["cache"].count() == 1
    with pytest.raises(Exception, match="another number"):
        ingest(docs, manifest, cache, lambda texts: [], fingerprint="fp")["vectors"].collect()


def test_a_failing_task_and_a_second_writer_leave_the_published_version(spark, tmp_path):
    root, one = str(tmp_path), spark.createDataFrame([("a", 1)], "v string, k int")
    first = artifacts.save_version({"t": one}, root)
    with pytest.raises(Exception, match="lost"):
        artifacts.save_version({"t": one, "u": one.withColumn("v", F.raise_error(F.lit("lost")))}, root)
    assert versions.numbers(spark, root) == [first] and artifacts.load(spark, root, "t").first().v == "a"
    second = artifacts.save_version({"t": one.withColumn("v", F.lit("b"))}, root, first)
    with pytest.raises(versions.Conflict):
        artifacts.save_version({"t": one.withColumn("v", F.lit("c"))}, root, first)
    assert second == first + 1 and artifacts.load(spark, root, "t").first().v == "b"
