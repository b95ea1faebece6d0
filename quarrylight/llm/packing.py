"""Best-fit packing of token pieces into sequences of a fixed capacity.

The bulk-synchronous best fit works on range-sorted classes: pieces of one length form a
class ordered by rank, open sequences of one remaining gap form a class ordered by number.
Each round sweeps the next longest class over its successor gaps (the smallest gap that
holds it), gives conflicting pieces consecutive places by rank, updates the gaps and
repeats. Lengths are at most the capacity, so the sweep needs only the class counts: at
most ``capacity`` lengths, whatever the corpus. The plan, a list of rank intervals, is
matched against the pieces in parallel: each piece finds its interval by its rank.

Ranks are taken within cells of a length; a length with many pieces is split into many
cells, so no task holds an unbounded group even if a third of all pieces are equal.
"""

from __future__ import annotations

import bisect
import struct
import threading
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import write_shared
from quarrylight.llm.pieces import PATTERN, Memo, plain, splitter

CAPACITY = 2048
#: Pieces of a cell, and the most cells that the driver holds counts of.
CELL_ROWS, CELLS = 500, 100_000
#: The character that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from 256.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = dict(zip(_SHOWN, _SHOWN)) | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
PIECES = "piece int, start long, length long, ids_crc32 long"

_tokenizers: dict[tuple[str, str], tuple] = {}
_lock = threading.Lock()


def _cuts_alike(tokenizer) -> bool:
    """Whether a tokenizer cuts texts by ``PATTERN`` alone and writes their bytes as byte-level vocabularies do, so that its model may be asked piece by piece."""
    from tokenizers.pre_tokenizers import ByteLevel

    cutter = tokenizer.pre_tokenizer
    own = all(t.special for t in tokenizer.get_added_tokens_decoder().values())
    return own and tokenizer.normalizer is None and isinstance(cutter, ByteLevel) and cutter.use_regex and not cutter.add_prefix_space


def _tokenizer(path: str, pattern: str) -> tuple:
    with _lock:
        if (path, pattern) not in _tokenizers:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True

            quick, tokens = pattern == PATTERN and _cuts_alike(tokenizer), tokenizer.model.tokenize

            def ids_of(pieces: list[str]) -> list[bytes]:
                bare = {p for p in pieces if plain(p)} if quick else ()
                rest = [p for p in pieces if p not in bare]
                made = {p: [t.id for t in tokens(p.encode().decode("latin-1").translate(BYTE_NAMES))] for p in bare}
                made.update(zip(rest, (e.ids for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)) if rest else ()))
                return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(made.__getitem__, pieces)]

            _tokenizers[path, pattern] = (splitter(pattern), Memo(ids_of))
        return _tokenizers[path, pattern]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of ``capacity`` but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))] if n else []


def token_pieces(docs: DataFrame, path: str, pattern: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's tokens followed by ``end_id``.

    A null text counts as empty: one piece that holds only ``end_id``. Texts of any length are
    tokenized whole; repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, memo = _tokenizer(path, pattern)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(memo.all(split(text.as_py() or ""))) + last
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {PIECES}")


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, intervals (first rank, first sequence, offset) in order of rank.

    The piece of rank r in an interval goes to sequence first sequence + r - first rank, at
    the interval's offset. Lengths are swept from the longest; each takes the smallest gap
    that holds it and fills a gap as often as it fits before the next.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    plan: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0

    def keep(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, count))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, need, out = 0, counts[length], plan.setdefault(length, [])
        while need:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            else:
                gap, fits = capacity, capacity // length
                first, count = sequences, -(-need // fits)
                sequences += count
            fits = gap // length
            full = min(count, need // fits)
            for layer in range(fits if full else 0):
                out.append((rank, first, capacity - gap + layer * length))
                rank += full
            need -= full * fits
            keep(gap - fits * length, first, full)
            if full < count and need:
                for layer in range(need):
                    out.append((rank, first + full, capacity - gap + layer * length))
                    rank += 1
                keep(gap - need * length, first + full, 1)
                full, need = full + 1, 0
            keep(gap, first + full, count - full)
    return plan


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a length column of 1 to ``capacity``, doc_id, piece) with sequence_id and offset.

    ``pieces`` is read several times, so it should be stored. An empty table gives an empty one;
    pieces of equal length are interchangeable, so ties need no order.
    """
    spark = pieces.sparkSession
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = max(CELL_ROWS, sum(sizes.values()) // CELLS)
    parts = {length: -(-n // rows) for length, n in sizes.items()}
    cells = F.lit(1)
    if hot := any(k > 1 for k in parts.values()):
        cells = F.get(F.lit([parts.get(length, 1) for length in range(capacity + 1)]), F.col("length").cast("int"))
    celled = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "start"), cells).cast("int"))
    base: dict[tuple[int, int], int] = {}
    if hot:
        seen: dict[int, int] = defaultdict(int)
        for r in celled.groupBy("length", "cell").agg(F.count("*").alias("n")).collect():
            base[r["length"], r["cell"]] = seen[r["length"]]
            seen[r["length"]] += r["n"]
    plan = best_fit_plan(sizes, capacity)
    steps = {length: tuple(np.array(x, np.int64) for x in zip(*found)) for length, found in plan.items()}
    shared = spark.sparkContext.broadcast((steps, base))
    ranked = celled.withColumn("rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, base = shared.value
        for batch in batches:
            n = batch.num_rows
            length, cell, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "cell", "rank"))
            sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys = length * (1 << 32) + cell
            for key in np.unique(keys):
                rows = np.flatnonzero(keys == key)
                size, part = int(key) >> 32, int(key) & 0xFFFFFFFF
                at = rank[rows] + base.get((size, part), 0)
                first_rank, first_sequence, start = steps[size]
                k = np.searchsorted(first_rank, at, side="right") - 1
                sequence[rows], offset[rows] = first_sequence[k] + at - first_rank[k], start[k]
            kept = [c for c in batch.schema.names if c not in ("cell", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text); one row per piece. See token_pieces and pack for odd inputs."""
    return pack(write_shared(token_pieces(docs, path, pattern, capacity=capacity), "pieces"), capacity=capacity)
