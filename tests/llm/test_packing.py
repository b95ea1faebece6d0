import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylight.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def placed(counts, capacity):
    out = []
    for length, steps in packing.best_fit_plan(counts, capacity).items():
        ends = [s[0] for s in steps[1:]] + [counts[length]]
        for (rank, first, offset), end in zip(steps, ends):
            out += [(first + k, offset, length) for k in range(end - rank)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 30), max_size=20))
def test_plan_is_gapless_and_near_the_best(counts):
    out = placed(counts, 50)
    assert Counter(x[2] for x in out) == Counter({k: v for k, v in counts.items() if v})
    by = defaultdict(list)
    for sequence, offset, length in out:
        by[sequence].append((offset, length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 50
    assert len(by) <= len(best_fit([k for k, v in counts.items() for _ in range(v)], 50)) * 1.05 + 1


def best_fit(lengths, capacity=2048):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [(gap, k) for k, gap in enumerate(gaps) if gap >= length]
        if fitting:
            gaps[min(fitting)[1]] -= length
        else:
            gaps.append(capacity - length)
    return gaps


def test_cut():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(1, 2048) == [(0, 1)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "ion", "Zürich", "\n", "x1"]) for _ in range(rnd.choice([3, 3, 3, 40, 900, 6000]))), "e") for i in range(80)]
    rows += [(100, None, "e"), (101, "", "e"), (0, rows[0][1], "e")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH, public_tokenizers.PATTERN).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for found in by.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) <= 2048
    assert len(by) <= len(best_fit(r.length for r in got))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_of_pieces_come_from_the_model_where_it_cuts_alike():
    from tokenizers.pre_tokenizers import ByteLevel

    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    assert packing._cuts_alike(own)
    split, memo = packing._tokenizer(PATH, public_tokenizers.PATTERN)
    asked = []
    inner = memo.make
    memo.make = lambda pieces: asked.extend(pieces) or inner(pieces)
    for text in ("Ein Rävich's  ''s qzxv\t\n y", "naïve x y ¼x²", "日本語 12 😀", "<|endoftext|> a", "\x1cy\x85z\x7f", " ", ""):
        ids = own.encode(text, add_special_tokens=False).ids
        assert b"".join(memo.all(split(text))) == np.array(ids, "<u4").tobytes()
    assert " qzxv" in asked and len(asked) == len({*asked})
    memo.make = inner
    own.pre_tokenizer = ByteLevel(add_prefix_space=True)
    assert not packing._cuts_alike(own)
