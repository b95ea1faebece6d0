import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_quality import brute as measure
from tokenizers import Tokenizer

import corpus_pipeline
from quarrylight.llm import secrets

CLEAN = [" ".join(f"{a}{b}" for b in range(70)) for a in ("alpha", "beta", "gamma", "delta", "omega")]
PASSAGE = "This passage of far more than fifty bytes stands in several of the documents word for word."


def rows():
    texts = [CLEAN[0], CLEAN[0], CLEAN[0].replace("alpha3 ", "other "), CLEAN[1] + " " + PASSAGE, PASSAGE + " " + CLEAN[2], "too short", None, "", "junk$$$ " * 90, CLEAN[3] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', CLEAN[4] + "\n" + " ".join(f"é{k}" for k in range(4000))]
    return [(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in enumerate(texts)] + [(20, CLEAN[1] + " x", None, None, None, None)]


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(table):
    kept = []
    for row in table:
        text = row[1] or ""
        n, chars, symbols, dup, repeat = measure(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
        capitals = sum("A" <= c <= "Z" for c in text)
        if not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n or 100 * dup > 50 * lines or 100 * capitals > 50 * chars or 2 * chars < 4 * n or chars > 20 * n):
            kept.append((row[0], text))
    unique = []
    for i, text in sorted(kept):
        mine = shingles(text)
        if not any(100 * len(mine & s) >= 80 * len(mine | s) for s in (shingles(t) for _, t in unique)):
            unique.append((i, text))
    first, cut = {}, []
    for i, text in unique:
        data = text.encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for i, text in unique:
        data = text.encode()
        stay = np.ones(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                stay[k : k + 50] = False
        cut.append((i, bytes(np.frombuffer(data, np.uint8)[stay]).decode(errors="ignore")))
    out = []
    for i, text in cut:
        base, added = secrets._all_spans([text], secrets.default_network())
        for _, start, end in sorted(base[0] + added[0], key=lambda s: -s[1]):
            if any(s < end and start < e and (s, e) != (start, end) and s <= start for _, s, e in base[0] + added[0]):
                continue
            reach = max(e for _, s, e in base[0] + added[0] if start <= s <= end)
            text = text[:start] + "[secret]" + text[reach:]
        out.append((i, text))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in brute(rows()):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) % 2048 or 2048
        bounds = [0, *range(head, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want.update((i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(bounds, bounds[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert {r.doc_id for r in got} == {0, 3, 4, 9, 10, 20}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        found.sort()
        assert all(o == sum(n for _, n in found[:k]) for k, (o, _) in enumerate(found)) and sum(n for _, n in found) <= 2048


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept string, rid string, spans string, row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
    docs = spark.createDataFrame([r[:5] + ("k", "r", "s", "w") for r in rows()], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert {(r.kept, r.rid, r.spans, r.row) for r in docs.collect()} == {("k", "r", "s", "w")}
