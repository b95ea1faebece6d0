import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import bpe, pieces

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.TreeCodec(RANKS, public_tokenizers.PATTERN)
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_the_fast_split_restates_the_public_pattern():
    assert pieces.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=400))
def test_any_text_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == WHOLE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abet hn'sÄé12.\n\t", max_size=600))
def test_texts_of_the_fast_split(text):
    assert CODEC.encode(text) == WHOLE.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=300, max_size=3000) | st.text(alphabet="the ion", min_size=200, max_size=900).map(lambda x: x.replace(" ", "")))
def test_long_pieces_join_up_the_tree(text):
    assert CODEC.encode(text) == WHOLE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "中文" * 900, "!" * 2000, "\x1c\x1d  x", "½ ² Ⅷ 12", "abcdefghij" * 3000, "x" * 50_000])
def test_runs(text):
    assert CODEC.encode(text) == WHOLE.encode_ordinary(text)


def test_round_trip_query(spark):
    rows = [(1, "the cat's  hat\n", "x"), (2, None, "y"), (3, "", None), (1, "the cat's  hat\n", "x"), (None, "é" * 500, "z")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, public_tokenizers.PATTERN).collect()
    want = [(i, len(ids := WHOLE.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows]
    assert [tuple(r) for r in got] == want
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=200) | st.text(alphabet="the iona", min_size=1, max_size=200).map(str.encode))
def test_merges_as_the_library(window):
    assert CODEC.merged(window) == CODEC._merged_by_heap(window) == WHOLE._core_bpe.encode_single_piece(window)
