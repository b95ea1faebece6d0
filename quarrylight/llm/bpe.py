"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece's encoding is reduced over a binary tree. Leaves of at most ``LEAF`` bytes are encoded
by merging pairs in the order of the rank table; two neighbours are joined by re-encoding a window of tokens around their
boundary and growing that window until both of its edges are stable. A token sequence is the
encoding of its bytes exactly if each adjacent pair is the encoding of its own bytes, so an
edge is proven stable once the pair across it encodes to itself; tokens outside the window
keep their proven pairs. Decoding maps tokens to bytes at the leaves and concatenates upwards.

Null and empty texts have no tokens and decode to the empty byte string. Equal pieces are
encoded once and kept in a bounded per-worker memo.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.pieces import Memo, splitter

#: Bytes of a leaf; bytes up to which a window's pairs are looked through again after each merge; windows that are kept.
LEAF, SHORT, WINDOWS = 4, 48, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The mergeable ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class TreeCodec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = splitter(pattern)
        self.kept: dict[bytes, list[int]] = {}
        self.none = max(self.bytes_of, default=0) + 1

    def leaf(self, window: bytes) -> list[int]:
        """The encoding of a few bytes; not to be changed by the caller."""
        found = self.kept.get(window)
        if found is None:
            if len(self.kept) > WINDOWS:
                self.kept.clear()
            found = self.merged(window)
            if len(window) <= SHORT:
                self.kept[window] = found
        return found

    def merged(self, window: bytes) -> list[int]:
        """Always merge the pair of lowest rank, the first of equals, until no pair has a rank."""
        if len(window) > SHORT:
            return self._merged_by_heap(window)
        ranks, none, parts = self.ranks, self.none, [window[i : i + 1] for i in range(len(window))]
        while len(parts) > 1:
            least, at, before = none, -1, parts[0]
            for i in range(1, len(parts)):
                rank = ranks.get(before + parts[i], none)
                if rank < least:
                    least, at = rank, i
                before = parts[i]
            if at < 0:
                break
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, window: bytes) -> list[int]:
        """The same over a linked list of parts and a heap of pairs; pairs that have changed since are passed over."""
        ranks, end = self.ranks, len(window)
        stop = list(range(1, end + 1))
        before = list(range(-1, end - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and stop[at] < end:
                rank = ranks.get(window[at : stop[stop[at]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, stop[stop[at]]))

        for at in range(end - 1):
            offer(at)
        while heap:
            _, at, until = heapq.heappop(heap)
            middle = stop[at]
            if middle < 0 or middle >= end or stop[middle] != until:
                continue
            stop[at], stop[middle] = until, -1
            if until < end:
                before[until] = at
            offer(before[at])
            offer(at)
        out, at = [], 0
        while at < end:
            out.append(ranks[window[at : stop[at]]])
            at = stop[at]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left or right
        of, leaf = self.bytes_of, self.leaf
        a = b = 1
        while True:
            window = leaf(b"".join(of[t] for t in left[len(left) - a :]) + b"".join(of[t] for t in right[:b]))
            more_left = a < len(left) and leaf(of[left[-a - 1]] + of[window[0]]) != [left[-a - 1], window[0]]
            more_right = b < len(right) and leaf(of[window[-1]] + of[right[b]]) != [window[-1], right[b]]
            if not more_left and not more_right:
                return left[: len(left) - a] + window + right[b:]
            a = min(len(left), 2 * a) if more_left else a
            b = min(len(right), 2 * b) if more_right else b

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece, by pairwise joins up the tree."""
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= LEAF:
            return self.leaf(piece)
        level = [self.leaf(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, each match of the pattern separately."""
        return [t for piece in self.split(text or "") for t in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a token sequence, concatenated by halves up the tree."""
        level = [self.bytes_of[t] for t in ids] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


_codecs: dict[tuple[str, str], tuple[TreeCodec, Memo]] = {}
_lock = threading.Lock()


def _codec(path: str, pattern: str) -> tuple[TreeCodec, Memo]:
    with _lock:
        if (path, pattern) not in _codecs:
            codec = TreeCodec(read_ranks(path), pattern)

            def made(pieces: list[str]) -> list[tuple[str, bytes]]:
                encoded = [codec.encode_piece(piece.encode()) for piece in pieces]
                return [(",".join(map(str, ids)), codec.decode(ids)) for ids in encoded]

            _codecs[path, pattern] = (codec, Memo(made))
        return _codecs[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text; returns id, n_tokens, ids_sha256, decoded_sha256, one row per input row.

    ``path`` is the rank file, readable on every executor. ids_sha256 is over decimal ids
    joined by commas. A null or empty text gives 0 tokens and digests of the empty string.
    Other columns are not read; nulls in the id column pass through.
    """
    schema = f"{docs.select(id_column).schema.fields[0].name} {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, memo = _codec(path, pattern)
        for batch in batches:
            counts, ids_digest, back_digest = [], [], []
            for text in batch.column(1):
                made = memo.all(codec.split(text.as_py() or ""))
                joined = ",".join([ids for ids, _ in made])
                counts.append(joined.count(",") + 1 if joined else 0)
                ids_digest.append(hashlib.sha256(joined.encode()).hexdigest())
                back_digest.append(hashlib.sha256(b"".join([back for _, back in made])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(back_digest, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)
