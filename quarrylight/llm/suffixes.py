"""Removal of repeated passages by a distributed difference-cover suffix sort.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller
id goes. The order of suffixes matters to ``LENGTH`` bytes only, so the sort stops there:

1. Exact copies of a whole text are set aside: all their bytes are repeats of the smallest id.
   Rows that repeat both id and text are sorted once and share the result.
2. A string's minimizer is the least hash of its ``GRAM``-byte substrings; equal strings have
   equal minimizers. Minimizers met in a single document rule their strings out, so only text
   under repeated minimizers is sorted. Their counts are combined per batch, then per bucket.
3. The remaining text is dealt by minimizer, in runs of strings that share one. The sorted
   order is thus by bucket, then by bytes, and equal strings are neighbours in it. A run that
   a smaller document of the same map batch holds too is settled there and not sent.
4. Each bucket's suffixes are sorted by a difference cover of 3: sampled positions (1 and 2 modulo 3)
   are named by sorted triples of words, the names are named again by sorted pairs until they span
   all but two bytes of the string, the remaining positions are sorted by one byte and the name that
   follows and merged in, and neighbours with equal prefixes form the classes whose least id keeps
   the string.
5. A minimizer with ``HOT_STRINGS`` strings or more (a very common passage, a text of one
   repeated phrase) is not sorted in one bucket: its strings are named by 128-bit digests, one
   by one, reduced to their least documents per batch and dealt by name, so that neither the
   passage nor the differing texts around it meet in one task.

Null texts count as empty, an empty table gives no rows. Rows without an id neither lose bytes
nor take any. Rows that share an id are not smaller than one another, whatever their texts;
rows that repeat id and text lose the same bytes. Very long texts are worked on in parts of
``HASHED`` bytes and dealt in runs; only one text at a time is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import write_shared

LENGTH, GRAM = 50, 24
#: Bytes hashed at a time, strings sorted at a time; bytes that may be broadcast to a text scan.
HASHED, SORTED, BROADCAST_BYTES = 1 << 17, 1 << 20, 32 << 20
#: Partitions that minimizers are dealt to: at least PARTS and one for each PART_BYTES of text; buckets of each.
PARTS, PART_BYTES, BUCKETS = 32, 128 << 20, 8
#: Documents and bytes of text of a batch; document numbers fit in 14 bits.
MOST_ROWS, MOST_BYTES = 1 << 14, 16 << 20
#: Strings under a minimizer from which on they are named and dealt one by one.
HOT_STRINGS = 1 << 18
#: Strings that a batch is taken to have under a minimizer for which it sends no count; it sends those above.
FEW_STRINGS = 32
#: Ways that the copies of one text are dealt.
SALTS = 32
#: What identifies a text: its document and the hash that tells the texts of one document apart.
KEY = ["doc_id", "rid"]
RUNS, NAMES, SPANS = 0, 1, 2
_low = np.uint64((1 << 48) - 1)
_all = np.array([[0, 1 << 40]], np.int64).tobytes()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Names in sorted order: equal keys get equal ranks."""
    order = np.argsort(keys)
    ordered = keys[order]
    steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    out = np.empty(len(keys), np.uint64)
    out[order] = steps
    return out


def _least_of_classes(order: np.ndarray, heads: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each element, the least owner in its class; ``heads`` marks where classes begin in ``order``."""
    out = np.empty(len(owners), owners.dtype)
    out[order] = np.minimum.reduceat(owners[order], np.flatnonzero(heads))[np.cumsum(heads) - 1]
    return out


def sorted_classes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``length`` bytes at ``starts`` in ``text``, and where in it a new string begins.

    ``length`` is between 26 and 50. Names of 24 bytes come from sorted triples of 8-byte words
    at sampled positions, names of ``length`` - 2 from sorted pairs of those.
    """
    padded = np.concatenate([text, np.zeros(length + 64, np.uint8)])
    residue = starts % 3
    needed = np.zeros(len(text) + length, bool)
    for delta in (0, 1, 2):
        needed[(starts + delta)[(residue + delta) % 3 != 0]] = True
    second = length - 2 - 24
    sampled = np.flatnonzero(needed | np.concatenate([np.zeros(second, bool), needed])[: len(needed)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    place = np.zeros(len(padded), np.int64)
    place[sampled] = np.arange(len(sampled))

    def word(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[at]).view(">u8")[:, 0].astype(np.uint64)

    names = _ranks(word(sampled))
    for offset in (8, 16):
        names = _ranks((names << np.uint64(32)) | _ranks(word(sampled + offset)))
    base = np.flatnonzero(needed)
    long_names = _ranks((names[place[base]] << np.uint64(32)) | names[place[base + second]])
    place[base] = np.arange(len(base))

    def name(at: np.ndarray) -> np.ndarray:
        return long_names[place[at]]

    def byte(at: np.ndarray) -> np.ndarray:
        return padded[at].astype(np.uint64)

    eight, wide, last = np.uint64(8), np.uint64(40), length - 2

    def whole(at: np.ndarray) -> np.ndarray:
        return (((name(at) << eight) | byte(at + last)) << eight) | byte(at + last + 1)

    def after_one(at: np.ndarray) -> np.ndarray:
        return (byte(at) << wide) | (name(at + 1) << eight) | byte(at + last + 1)

    def after_two(at: np.ndarray) -> np.ndarray:
        return (((byte(at) << eight) | byte(at + 1)) << np.uint64(32)) | name(at + 2)

    cover = np.flatnonzero(residue != 0)
    rest = np.flatnonzero(residue == 0)
    cover_keys, rest_keys = whole(starts[cover]), after_one(starts[rest])
    by = np.argsort(cover_keys)
    cover, cover_keys = cover[by], cover_keys[by]
    by = np.argsort(rest_keys)
    rest, rest_keys = rest[by], rest_keys[by]
    ahead = np.arange(len(rest))
    for r, key in ((1, after_one), (2, after_two)):
        ahead = ahead + np.searchsorted(key(starts[cover[residue[cover] == r]]), key(starts[rest]))
    merged = np.empty(len(starts), np.int64)
    from_rest = np.zeros(len(starts), bool)
    from_rest[ahead] = True
    merged[from_rest], merged[~from_rest] = rest, cover
    heads = np.ones(len(starts), bool)
    own = np.empty(len(starts), np.uint64)
    own[from_rest], own[~from_rest] = rest_keys, cover_keys
    heads[1:] = (from_rest[1:] != from_rest[:-1]) | (own[1:] != own[:-1])
    # a string of the rest comes before its equals of the cover, never after
    step = np.flatnonzero(from_rest[:-1] & ~from_rest[1:])
    left, right = starts[merged[step]], starts[merged[step + 1]]
    for r, key in ((1, after_one), (2, after_two)):
        at = right % 3 == r
        heads[step[at] + 1] = key(left[at]) != key(right[at])
    return merged, heads


def least_owners(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string of ``length`` bytes at ``starts`` in ``text``, the least owner of an equal string."""
    return _least_of_classes(*sorted_classes(text, starts, length), owners) if len(starts) else owners.copy()


def _mixed_spans(text: np.ndarray, seed: int, spans: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 2, 4, ... bytes, by length; each joins two of half its length."""
    h = text.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 ^ seed)
    out = {}
    for span, factor in zip(spans, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8CB92BA72F3D8DD7)):
        h = h[:-span] * np.uint64(factor) + h[span:]
        h ^= h >> np.uint64(29)
        out[2 * span] = h
    return out


def _finished(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x8EBC6AF09C88C6E3)
    return h ^ (h >> np.uint64(29))


def digests(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of ``length`` bytes (32 to 64) of ``text``, by its start."""
    out = []
    n = max(len(text) - length + 1, 0)
    for seed in (0x51ED270B, 0x2545F491):
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        half = _mixed_spans(text, seed, (1, 2, 4, 8, 16))[32]
        out.append(_finished(_finished(half[:n]) * np.uint64(0xE7037ED1A0B428DB) + half[length - 32 : length - 32 + n]))
    return out[0], out[1]


def minimizers(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The minimizer of each string of ``length`` bytes of ``text``, by its start. ``gram`` is 24."""
    grams = length - gram + 1
    if len(text) < length:
        return np.zeros(0, np.uint64)
    by_span = _mixed_spans(text, 0, (1, 2, 4, 8))
    h = _finished(by_span[16][: len(text) - gram + 1] * np.uint64(0xE7037ED1A0B428DB) + by_span[8][16 : 16 + len(text) - gram + 1])
    span = 1
    while 2 * span <= grams:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(text) - length + 1], h[grams - span : grams - span + len(text) - length + 1]) if span < grams else h


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of pieces of about HASHED bytes."""
    start = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= HASHED:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first start, number of starts and minimizer of each run of strings with one minimizer.

    A long text is cut into pieces of HASHED bytes that overlap by ``length`` - 1; runs end there too.
    """
    pieces = [(k, at) for k, text in enumerate(texts) for at in range(0, max(len(text) - length + 1, 0), HASHED)]
    ends_at = [min(len(texts[k]), at + HASHED + length - 1) for k, at in pieces]
    sizes = [end - at for (_, at), end in zip(pieces, ends_at)]
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for low, high in _grouped(sizes):
        found = minimizers(np.frombuffer(b"".join(texts[k][at:end] for (k, at), end in zip(pieces[low:high], ends_at[low:high])), np.uint8), length)
        ends = np.cumsum(sizes[low:high])
        begins = ends - sizes[low:high]
        piece = np.searchsorted(ends, np.arange(len(found)), side="right")
        valid = np.arange(len(found)) + length <= ends[piece]
        heads = np.concatenate([[True], (found[1:] != found[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])])
        at = np.flatnonzero(heads)
        counts = np.diff(np.append(at, len(found)))
        good = valid[at]
        at, counts = at[good], counts[good]
        whose, offset = np.array(pieces[low:high], np.int64).T
        for part, column in zip(parts, (whose[piece[at]], at - begins[piece[at]] + offset[piece[at]], counts, found[at])):
            part.append(column)
    return tuple(np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (np.int64, np.int64, np.int64, np.uint64)))


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most MOST_ROWS, and of at most MOST_BYTES of text but for one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(max(int(np.searchsorted(ends, before + MOST_BYTES, side="right")), start + 1), start + MOST_ROWS)
            yield batch.slice(start, end - start)
            start = end


def _rows(columns: dict[str, pa.DataType], found: list[tuple]) -> pa.RecordBatch:
    made = zip(*found) if found else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, columns.values())], names=list(columns))


def _repeated_minimizers(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """doc_id, rid, the packed low 48 bits of a text's minimizers that other texts hold too, and those of the hot ones.

    Each batch sends a minimizer to its bucket once, whatever number of its documents hold it, with the
    number of its strings if they are not few. The bucket adds them up, so that a minimizer is hot, or
    repeated, for all texts alike.
    """
    buckets = BUCKETS * parts
    columns = {"deal": pa.int32(), "uid": pa.int64(), "kind": pa.int32(), "entries": pa.binary()}
    schema = "deal int, uid long, kind int, entries binary"
    few, hot_strings = FEW_STRINGS, HOT_STRINGS

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        for number, batch in enumerate(_slices(batches, 2)):
            owner, _, count, value = _runs_of([t.as_py().encode() for t in batch.column(2)], length)
            if not len(owner):
                continue
            uid = (part << 32) | number
            value &= _low
            order = np.lexsort((owner, value))
            value, owner, count = value[order], owner[order], count[order]
            first = np.concatenate([[True], value[1:] != value[:-1]])
            weight = np.add.reduceat(count, np.flatnonzero(first))
            new = first | np.concatenate([[True], owner[1:] != owner[:-1]])
            value, owner, first = value[new], owner[new], first[new]
            repeated = ~first | np.concatenate([~first[1:], [False]])
            keys = np.concatenate([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)])
            out = [(buckets + uid % buckets, uid, 0, keys.tobytes())]
            if repeated.any():
                out.append((buckets + uid % buckets, uid, 1, _packed(value[repeated], owner[repeated])))
            value, owner, known, many = value[first], owner[first], repeated[first], weight > few
            owner = owner | (known.astype(np.int64) << 15) | (many.astype(np.int64) << 14)
            bucket = (value >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[b] : cuts[b + 1]]
                out.append((b, uid, 2, np.int64(len(own)).tobytes() + _packed(value[own], owner[own]) + weight[own][many[own]].astype(np.int64).tobytes()))
            yield _rows(columns, out)

    def met(deal: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sizes = [int(np.frombuffer(e, np.int64, 1)[0]) for _, e in blobs]
        value, owner = _unpacked(b"".join(e[8 : 8 + 8 * n] for (_, e), n in zip(blobs, sizes)))
        weight = np.full(len(value), few, np.int64)
        weight[owner & 0x4000 != 0] = np.frombuffer(b"".join(e[8 + 8 * n :] for (_, e), n in zip(blobs, sizes)), np.int64)
        order = np.argsort(value)
        ordered = value[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(heads, len(value)))
        batches, strings = np.empty(len(value), np.int64), np.empty(len(value), np.int64)
        batches[order] = np.repeat(times, times)
        strings[order] = np.repeat(np.add.reduceat(weight[order], heads), times)
        hot = strings >= hot_strings
        told = (batches > 1) | (hot & (owner & 0x8000 != 0))
        out = []
        ends = np.cumsum(sizes)
        for (uid, _), end, size in zip(blobs, ends.tolist(), sizes):
            at = np.flatnonzero(told[end - size : end]) + end - size
            if len(at):
                out.append((deal, uid, 1, _packed(value[at], (owner[at] & 0x3FFF) | (hot[at].astype(np.int64) << 15))))
        return _rows(columns, out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            passed = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if row[2] != 2:
                    passed.append(row)
                    continue
                if row[0] != current and held:
                    yield met(current, held)
                    held = []
                current = row[0]
                held.append((row[1], row[3]))
            yield _rows(columns, passed)
        if held:
            yield met(current, held)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, keys, found = None, None, []

        def done() -> pa.RecordBatch:
            value, owner = _unpacked(b"".join(found))
            common = np.unique(value[owner >= 1 << 15])
            value, owner = _distinct(value, owner & 0x3FFF)
            order = np.argsort(owner, kind="stable")
            owner, value = owner[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
            lists = np.split(value, heads[1:]) if len(heads) else []
            hot = [v[np.isin(v, common)].tobytes() for v in lists] if len(common) else [b""] * len(lists)
            at = owner[heads] if len(heads) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[0][at]), pa.array(keys[1][at]), pa.array([v.tobytes() for v in lists], pa.binary()), pa.array(hot, pa.binary())], names=[*KEY, "repeated", "hot"])

        for batch in batches:
            for own, kind, entries in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if own != uid:
                    if uid is not None:
                        yield done()
                    uid, found = own, []
                if kind == 0:
                    keys = np.frombuffer(entries, np.int64).reshape(2, -1)
                else:
                    found.append(entries)
        if uid is not None:
            yield done()

    dealt = texts.select(*KEY, "text").mapInArrow(select, schema).repartition(parts, "deal").sortWithinPartitions("deal")
    told = dealt.mapInArrow(meet, schema).select("uid", "kind", "entries")
    return told.repartition("uid").sortWithinPartitions("uid", "kind").mapInArrow(name, "doc_id long, rid long, repeated binary, hot binary")


def _packed(value: np.ndarray, owner: np.ndarray) -> bytes:
    """48 bits of each value and 16 of its owner in one word each."""
    return ((value << np.uint64(16)) | owner.astype(np.uint64)).tobytes()


def _unpacked(entries: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(entries, np.uint64)
    return words >> np.uint64(16), (words & np.uint64(0xFFFF)).astype(np.int64)


def _distinct(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (value, owner), ordered by value, then owner."""
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    return value[keep], owner[keep]


def _spans(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Disjoint [start, end) byte ranges covered by ``counts`` strings from each of ``starts``, in order."""
    order = np.argsort(starts, kind="stable")
    begin = starts[order]
    end = np.maximum.accumulate(begin + counts[order] + length - 1)
    heads = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.zeros(0, bool)
    at = np.flatnonzero(heads)
    return np.stack([begin[at], end[np.append(at[1:], len(begin)) - 1]], 1) if len(at) else np.zeros((0, 2), np.int64)


def _named(texts: list[bytes], owner: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """owner, start and the two digests (as int64) of each string of the given runs, one column a string."""
    sizes = (count + length - 1).tolist()
    parts = []
    for low, high in _grouped(sizes):
        own, first, n = owner[low:high], start[low:high], count[low:high]
        joined = np.frombuffer(b"".join(texts[k][s : s + size] for k, s, size in zip(own.tolist(), first.tolist(), sizes[low:high])), np.uint8)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum([0, *sizes[low : high - 1]]), n) + inside
        one, two = digests(joined, length)
        parts.append(np.stack([np.repeat(own, n), np.repeat(first, n) + inside, one[at].view(np.int64), two[at].view(np.int64)]))
    return np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)


def _lost_names(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same name: names are sorted, neighbours compared."""
    order = np.lexsort((two, one))
    heads = np.ones(len(order), bool)
    heads[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return _least_of_classes(order, heads, docs) < docs if len(docs) else np.zeros(0, bool)


def _pack_names(rids: np.ndarray, ids: np.ndarray, named: np.ndarray) -> bytes:
    """Named strings and the texts that own them; see _settle_names."""
    who, number = np.unique(named[0], return_inverse=True)
    return b"".join([np.array([named.shape[1], len(who)], np.int64).tobytes(), rids[who].tobytes(), ids[who].tobytes(), np.ascontiguousarray(named[2:]).tobytes(), np.stack([number, named[1]]).astype(np.int32).tobytes()])


def _settle_names(blobs: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """doc_id, rid and packed spans of the named strings that a smaller id holds too."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for blob in blobs:
        n, m = np.frombuffer(blob, np.int64, 2).tolist()
        rids, ids = np.frombuffer(blob, np.int64, 2 * m, 16).reshape(2, m)
        names = np.frombuffer(blob, np.int64, 2 * n, 16 + 16 * m).reshape(2, n)
        number, start = np.frombuffer(blob, np.int32, 2 * n, 16 + 16 * m + 16 * n).reshape(2, n).astype(np.int64)
        for column, part in zip(columns, (rids[number], ids[number], names[0], names[1], start)):
            column.append(part)
    rid, doc, one, two, start = map(np.concatenate, columns)
    gone = np.flatnonzero(_lost_names(one, two, doc))
    rid, doc, start = rid[gone], doc[gone], start[gone]
    order = np.lexsort((rid, doc))
    cuts = np.flatnonzero((rid[order][1:] != rid[order][:-1]) | (doc[order][1:] != doc[order][:-1])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(doc[part[0]]), int(rid[part[0]]), _spans(start[part], np.ones(len(part), np.int64), length).tobytes()


def _pack_runs(rids: np.ndarray, ids: np.ndarray, owner: np.ndarray, start: np.ndarray, count: np.ndarray, value: np.ndarray, strings: list[bytes]) -> bytes:
    """Runs, the documents that own them and their bytes in one blob; see _unpack_runs."""
    who, number = np.unique(owner, return_inverse=True)
    columns = np.stack([number, start, count, (value & np.uint64(0x7FFFFFFF)).astype(np.int64)]).astype(np.int32)
    return b"".join([np.array([len(owner), len(who)], np.int64).tobytes(), rids[who].tobytes(), ids[who].tobytes(), columns.tobytes(), *strings])


def _unpack_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rids, ids, a matrix of (owner, start, count, minimizer bits) and the bytes of all runs."""
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    owners = np.frombuffer(blob, np.int64, 2 * m, 16).reshape(2, m)
    at = 16 + 16 * m
    return owners[0], owners[1], np.frombuffer(blob, np.int32, 4 * n, at).reshape(4, n).astype(np.int64), np.frombuffer(blob, np.uint8, -1, at + 16 * n)


def _settle_runs(blobs: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """doc_id, rid and packed spans of the strings in a bucket's runs that a smaller id holds too, sorted SORTED strings at a time."""
    rids, ids, runs, texts = zip(*map(_unpack_runs, blobs))
    shift = np.cumsum([0, *map(len, rids)])
    owner = np.concatenate([r[0] + k for r, k in zip(runs, shift)])
    _, start, count, bits = np.concatenate(runs, 1)
    rid, doc, text = np.concatenate(rids), np.concatenate(ids), np.concatenate(texts)
    sizes = count + length - 1
    begins = np.cumsum(sizes) - sizes
    parts = -(-int(count.sum()) // SORTED)
    for part in range(parts):
        own = np.flatnonzero(bits % parts == part)
        n, size = count[own], sizes[own]
        moved = np.cumsum(size) - size
        held = text[np.repeat(begins[own] - moved, size) + np.arange(size.sum())]
        ahead = np.cumsum(n) - n
        at = np.repeat(moved - ahead, n) + np.arange(n.sum())
        owners = np.repeat(doc[owner[own]], n)
        lost = least_owners(held, at, owners, length) < owners
        run, first, counts, flags = _split(lost, n, start[own])
        gone = np.flatnonzero(flags)
        for k, spans in _by_owner(owner[own][run[gone]], first[gone], counts[gone], length):
            yield int(doc[k]), int(rid[k]), spans


def _split(flags: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where ``flags`` of their strings change: run number, first start, number of starts, flag."""
    run = np.repeat(np.arange(len(count)), count)
    heads = np.concatenate([[True], (run[1:] != run[:-1]) | (flags[1:] != flags[:-1])]) if len(run) else np.zeros(0, bool)
    at = np.flatnonzero(heads)
    inside = at - (np.cumsum(count) - count)[run[at]]
    return run[at], first[run[at]] + inside, np.diff(np.append(at, len(run))), flags[at]


def repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, rid and ``spans``: packed [start, end) byte ranges that go from each text that loses any; rows of one key add up.

    ``docs`` has rid (a hash of the text), doc_id and text.
    """
    spark = docs.sparkSession
    owned = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    size = F.octet_length("text").cast("long")
    seen = write_shared(owned.select(*KEY, F.unhex(F.md5("text")).alias("digest"), size.alias("size")), "digests")
    total = seen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    buckets = BUCKETS * parts
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).filter("other > rep").drop("other")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
    copies = write_shared(salted.join(first, ["digest", "salt"]).filter("doc_id > rep").select(*KEY).distinct(), "copies")
    texts = owned.join(_limited(copies), KEY, "left_anti")
    again = write_shared(seen.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*KEY).join(_limited(copies), KEY, "left_anti"), "repeated-rows")
    if not again.isEmpty():
        once = _limited(again)
        texts = texts.join(once, KEY, "left_anti").unionByName(texts.join(once, KEY, "left_semi").dropDuplicates(KEY))
    known = write_shared(_repeated_minimizers(texts, length, parts), "minimizers")
    columns = {"deal": pa.int32(), "kind": pa.int32(), "doc_id": pa.int64(), "rid": pa.int64(), "held": pa.binary()}

    def deal_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            held = [t.as_py().encode() for t in batch.column(2)]
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            owner, start, count, value = _runs_of(held, length)
            low = value & _low
            repeated, hot = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
            bounds = np.searchsorted(owner, np.arange(len(held) + 1))
            for k, (packed, common) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                part = slice(bounds[k], bounds[k + 1])
                repeated[part] = np.isin(low[part], np.frombuffer(packed, np.uint64))
                if common:
                    hot[part] = np.isin(low[part], np.frombuffer(common, np.uint64))
            out: list[tuple] = []
            if (hot & repeated).any():
                own = hot & repeated
                named = _named(held, owner[own], start[own], count[own], length)
                lost = _lost_names(named[2], named[3], ids[named[0]])
                gone = named[:, lost]
                for k, spans in _by_owner(gone[0], gone[1], np.ones(gone.shape[1], np.int64), length):
                    out.append((buckets + k % buckets, SPANS, int(ids[k]), int(rids[k]), spans))
                named = named[:, ~lost]
                bucket = (named[2].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    out.append((b, NAMES, None, None, _pack_names(rids, ids, named[:, order[cuts[b] : cuts[b + 1]]])))
            plain = repeated & ~hot
            owner, start, count, value = owner[plain], start[plain], count[plain], value[plain]
            strings = [held[k][s : s + n] for k, s, n in zip(owner.tolist(), start.tolist(), (count + length - 1).tolist())]
            least: dict[bytes, int] = {}
            for string, doc in zip(strings, ids[owner].tolist()):
                if least.setdefault(string, doc) > doc:
                    least[string] = doc
            lost = np.fromiter(map(least.__getitem__, strings), np.int64, len(strings)) < ids[owner]
            gone = np.flatnonzero(lost)
            for k, spans in _by_owner(owner[gone], start[gone], count[gone], length):
                out.append((buckets + k % buckets, SPANS, int(ids[k]), int(rids[k]), spans))
            stay = np.flatnonzero(~lost)
            bucket = ((value[stay] >> np.uint64(31)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = stay[order[cuts[b] : cuts[b + 1]]]
                out.append((b, RUNS, None, None, _pack_runs(rids, ids, owner[own], start[own], count[own], value[own], [strings[r] for r in own])))
            yield _rows(columns, out)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        held: list[bytes] = []

        def done() -> pa.RecordBatch:
            work = _settle_runs if current[1] == RUNS else _settle_names
            return _found(list(work(held, length)))

        for batch in batches:
            passed = []
            for deal, kind, doc, rid, blob in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if kind == SPANS:
                    passed.append((doc, rid, blob))
                    continue
                if (deal, kind) != current and held:
                    yield done()
                    held = []
                current = (deal, kind)
                held.append(blob)
            yield _found(passed)
        if held:
            yield done()

    wanted = texts.join(_limited(known.select(*KEY)), KEY, "left_semi").select(*KEY, "text").join(known.hint("shuffle_merge"), KEY)
    dealt = wanted.mapInArrow(deal_batch, "deal int, kind int, doc_id long, rid long, held binary").repartition(parts, "deal").sortWithinPartitions("deal", "kind")
    settled = dealt.mapInArrow(settle, "doc_id long, rid long, spans binary")
    return settled.unionByName(copies.select(*KEY, F.lit(_all).alias("spans")))


def _found(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _rows({"doc_id": pa.int64(), "rid": pa.int64(), "spans": pa.binary()}, rows)


def _by_owner(owner: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    for part in np.split(order, cuts[1:]) if len(cuts) else ():
        yield int(owner[part[0]]), _spans(starts[part], counts[part], length).tobytes()


def _limited(rows: DataFrame) -> DataFrame:
    """``rows`` (a key and perhaps spans), marked for broadcast if their size, as counted, is within the bound."""
    width = F.octet_length("spans") + 16 if "spans" in rows.columns else F.lit(16)
    size = rows.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's ranges from all buckets as disjoint ranges, in order."""
    for batch in batches:
        out = []
        for doc, rid, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ranges = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            out.append((doc, rid, _spans(ranges[:, 0], ranges[:, 1] - ranges[:, 0], 1).tobytes()))
        yield _found(out)


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """The rows of ``docs`` with rid and ``spans``, packed disjoint ranges that are null where nothing goes."""
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "rid": F.xxhash64("text")})
    found = repeats(rows.select("rid", "doc_id", "text"), length=length).groupBy(*KEY).agg(F.collect_list("spans").alias("spans"))
    merged = write_shared(found.mapInArrow(_joined_spans, "doc_id long, rid long, spans binary"), "spans")
    return rows.join(_limited(merged), KEY, "left")


def _cut(text: bytes, packed: bytes | None, length: int) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed and number of removed ranges."""
    if not packed or len(text) < length:
        return text, 0, 0
    at, parts, removed, joined = 0, [], 0, np.frombuffer(packed, np.int64).reshape(-1, 2)
    for start, end in joined.tolist():
        end = min(end, len(text))
        parts.append(text[at:start])
        removed += end - start
        at = end
    return b"".join([*parts, text[at:]]), removed, len(joined)


def removal_report(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            cuts = [_cut(t, spans, length) for t, spans in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()), pa.array([c[2] for c in cuts], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cuts], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = _with_spans(docs.select("doc_id", "text"), length)
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; characters that a cut splits go whole.

    All rows and columns stay; n_chars, where it exists, follows the new text. Null texts stay null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            texts = columns["text"].to_pylist()
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans and texts[k] is not None:
                    texts[k] = _cut(texts[k].encode(), spans, length)[0].decode(errors="ignore")
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    keyed = _with_spans(docs.select("doc_id", "text", F.struct(*names).alias("row")), length)
    return keyed.select(*[F.col("row")[n].alias(n) for n in names], F.col("spans").alias("ranges that go")).mapInArrow(run, docs.schema)
