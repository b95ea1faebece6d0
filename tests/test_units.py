"""Both units scored by their texts: e5_scored_both_units against a brute force over the ranking."""

import hashlib
import os
import re
from collections import defaultdict

import oracle
import pytest

from quarrylight.operators import chunking, retrieval
from quarrylight.plans import catalog, evaluate

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.TABLES), reason="no tables")


def squash(text):
    return re.sub("[^a-z0-9]", "", (text or "").lower())


def cover(needle, text):
    return next((k for k in range(len(needle), 0, -1) if needle[:k] in text), 0) / max(len(needle), 1)


def tables(spark):
    docs = [r.asDict() for r in catalog.read(spark, oracle.TABLES, "documents").collect()]
    items = {r.item_id: squash(r.text) for r in catalog.read(spark, oracle.TABLES, "benchmark").collect()}
    return docs, items


def brute(spark):
    docs, items = tables(spark)
    children, parents = {}, {}
    for d in docs:
        source = {"source_id": f"{d['doc_id']}\x1f{d['source']}", "title": d["source"], "owner": "es" if d["lang"] == "es" else "", "origin": ""}
        last = None
        for c in chunking.cut_parts(source, chunking.markdown_parts(d["text"])):
            digest = hashlib.sha256(((d["source"] or "") + "\n\n" + c["display_text"] if c["role"] == "child" and re.search("[a-z0-9]", d["source"] or "") else c["display_text"]).encode()).hexdigest()
            key = hashlib.sha256(f"{c['role']}|{source['source_id']}|{c['ordinal']}|{digest}".encode()).hexdigest()[:24]
            last = key if c["role"] == "parent" else last
            (children if c["role"] == "child" else parents)[key] = (last, d["source"], c["display_text"])
    chunks, _ = catalog.section_chunks(spark, oracle.TABLES)
    queries = catalog.text_queries(spark, oracle.TABLES)
    ranked = defaultdict(list)
    for r in retrieval.sparse(queries, *catalog.text_index(chunks, queries), chunks.select("chunk_id", "owner")).collect():
        ranked[r.query_id].append((r["rank"], r.chunk_id))
    squashed = [(d["source"], squash(d["text"])) for d in docs]
    out = {}
    for item, needle in items.items():
        accept = {s for s, t in squashed if needle and needle in t}
        for unit in ("child", "parent"):
            spent, seen, given = 0, set(), []
            for rank, key in sorted(ranked[item]):
                parent, source, text = children[key]
                if unit == "parent":
                    text = parents[parent][2]
                    if parent in seen:
                        continue
                    seen.add(parent)
                spent += max(1, len(text) // 4)
                if spent > retrieval.HEADLINE_BUDGET:
                    break
                given.append((rank, source, squash(text)))
            share = max([cover(needle, t) for _, _, t in given], default=0)
            hits = [rank for rank, source, _ in given if source in accept]
            out[item, unit] = (len(given), float(share >= 1), share >= 1, share >= 0.5, bool(hits), min(hits, default=None))
    return out


def scored(spark):
    return {(r.item_id, r.unit): (r.needle_fraction, r.strict, r.partial, r.source_hit, r.rank_first_hit) for r in catalog.e5_scored_both_units(spark, oracle.TABLES).collect()}


def test_units_are_scored_by_their_texts(spark):
    want = {k: v[1:] for k, v in brute(spark).items() if v[0]}
    got = scored(spark)
    assert {k: got[k] for k in want} == want
    assert any(v[1] for (_, unit), v in got.items() if unit == "parent")


def test_every_item_has_a_row_for_each_unit(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    items = frame([("a", "needle of a", ["s"]), ("b", "needle of b", ["s"]), ("none", "needle of none", None)], "item_id string, needle string, accept array<string>")
    chunks = frame([(1, "p", "s", "needle of a", "needle of a"), (2, "q", "s", "needle of b " * 900, "x")], "chunk_id long, parent_id string, source_id string, display_text string, embed_text string")
    parents = frame([("p", "needle of a " * 900), ("q", "needle of b")], "parent_id string, parent_text string")
    ranked = frame([("a", 1, 0), ("b", 2, 0)], "query_id string, chunk_id long, rank int")
    got = {(r.item_id, r.unit): (r.needle_fraction, r.strict, r.partial, r.source_hit, r.rank_first_hit) for r in evaluate.run(items, ranked, chunks, parents).collect()}
    failed, held = (0.0, False, False, False, None), (1.0, True, True, True, 0)
    assert got == {("a", "child"): held, ("a", "parent"): failed, ("b", "child"): failed, ("b", "parent"): held, ("none", "child"): failed, ("none", "parent"): failed}
    assert evaluate.run(items, ranked, chunks, parents).count() == 6


def test_catalogue_scores_every_item_in_both_units(spark):
    want = {k: v[1:] for k, v in brute(spark).items()}
    assert scored(spark) == want


def test_abstention_causes_rank_once(spark, monkeypatch):
    ranked = []
    inner = catalog.sparse_hits
    monkeypatch.setattr(catalog, "sparse_hits", lambda *given: ranked.append(1) or inner(*given))
    assert catalog.a12_abstention_causes(spark, oracle.TABLES).count() == 40
    assert len(ranked) == 1
