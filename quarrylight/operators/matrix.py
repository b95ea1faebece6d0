"""Vectors against a stated query set: queries in blocks of bounded size, one matrix product for each batch of rows, and only the best of each task shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.sources.shared import write_shared

#: Queries of a block: with 1024 components of 8 bytes, 32 MB are broadcast. Rows scored at once against a block: 16 MB of scores.
QUERIES, ROWS = 4096, 512


#: Under every score that counts as a hit.
LOWEST = -np.finfo(np.float64).max


class Best:
    """The ``k`` best rows of each of ``n`` queries so far, ties to the smaller id; memory for 2 k and ``ROWS`` rows a query.

    ``least`` is a score that k rows of the query have reached: lower ones are turned away before anything else is done with them.
    A query's rows are cut back to k when its room is full, so most slices cost one comparison a score.
    """

    def __init__(self, n: int, k: int):
        self.k, self.width = k, 2 * k + ROWS
        self.least, self.fill = np.full(n, LOWEST), np.zeros(n, np.int64)
        self.scores, self.at, self.extra = np.empty((n, self.width)), np.empty((n, self.width), np.int64), None
        self.parts: list[np.ndarray] = []
        self.known, self.used = 0, 0

    @property
    def ids(self) -> np.ndarray:
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def add(self, scores: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Scores of each query (-inf: no hit) for the rows ``ids``, and another number for each, carried along."""
        for low in range(0, len(ids), ROWS):
            part = scores[:, low : low + ROWS]
            q, c = np.nonzero(part >= self.least[:, None])
            self.push(q, c, part[q, c], ids[low : low + ROWS], None if extra is None else extra[:, low : low + ROWS][q, c])

    def push(self, q: np.ndarray, c: np.ndarray, scores: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Scores of the pairs of query ``q`` (ascending) and row ``ids[c]``, of ``ROWS`` rows at most, each pair once."""
        if not len(q):
            return
        counts = np.bincount(q, minlength=len(self.fill))
        full = np.flatnonzero(self.fill + counts > self.width)
        if len(full):
            self._cut(full)
        to = (self.fill - np.cumsum(counts) + counts)[q] + np.arange(len(q))
        self.scores[q, to], self.at[q, to] = scores, self.known + c
        if extra is not None:
            if self.extra is None:
                self.extra = np.empty(self.scores.shape, extra.dtype)
            self.extra[q, to] = extra
        self.fill += counts
        self.parts.append(ids)
        self.known += len(ids)
        if self.known > 4 * self.used + 100_000:
            self._forget()

    def _forget(self) -> None:
        """Drop ids that no query holds."""
        held = np.arange(self.width) < self.fill[:, None]
        kept = np.zeros(self.known, bool)
        kept[self.at[held]] = True
        self.at[held] = (np.cumsum(kept) - 1)[self.at[held]]
        self.parts = [self.ids[kept]]
        self.known = self.used = int(kept.sum())

    def _cut(self, over: np.ndarray) -> None:
        """Cut the rows of the queries ``over`` back to the k best."""
        every, at = self.scores[over], self.at[over]
        every[np.arange(self.width) >= self.fill[over, None]] = -np.inf
        least = np.partition(every, -self.k, axis=1)[:, -self.k]
        mask = (every > -np.inf) & (every >= least[:, None])
        self._break_ties(every, mask, least, at)
        r, c = np.nonzero(mask)
        counts = np.bincount(r, minlength=len(over))
        to = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.scores[over[r], to], self.at[over[r], to] = every[r, c], at[r, c]
        if self.extra is not None:
            self.extra[over[r], to] = self.extra[over[r], c]
        self.fill[over], self.least[over] = counts, np.maximum(least, LOWEST)

    def _break_ties(self, every: np.ndarray, mask: np.ndarray, least: np.ndarray, at: np.ndarray) -> None:
        over = np.flatnonzero(mask.sum(1) > self.k)
        if not len(over):
            return
        tied = mask[over] & (every[over] == least[over, None])
        room = self.k - (mask[over].sum(1) - tied.sum(1))
        r, c = np.nonzero(tied)
        order = np.lexsort((self.ids[at[over[r], c]], r))
        r, c = r[order], c[order]
        counts = tied.sum(1)
        late = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts) >= room[r]
        mask[over[r[late]], c[late]] = False

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Query positions, ids, scores and carried numbers of all hits."""
        if self.known:
            self._cut(np.arange(len(self.fill)))
        q, c = np.nonzero(np.arange(self.width) < self.fill[:, None])
        ids = self.ids[self.at[q, c]] if len(q) else np.empty(0, np.int64)
        return q, ids, self.scores[q, c], None if self.extra is None else self.extra[q, c]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have all ``dim`` components, their vectors); ``dim`` of the first filled row by default."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(array.value_lengths().fill_null(0))
    if dim is None:
        dim = int(sizes.max(initial=0))
    fits = (sizes == dim) & (dim > 0)
    flat = array.filter(pa.array(fits)).flatten()
    vectors = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim or 1)
    whole = ~np.isnan(vectors).any(axis=1)
    at = np.flatnonzero(fits)[whole]
    return at, vectors[whole]


def best_of_blocks(queries: DataFrame, rows: DataFrame, k: int, digits: int) -> DataFrame:
    """query_id, chunk_id and score (cosine, rounded) of at most the ``k`` best visible rows of each query in each task.

    queries: query_id, caller, query_vec; rows: chunk_id, owner, vec (unit); ids are numbers or strings. A row is visible without an owner, or
    to its owner. Ties go to the smaller id. Zero queries have no hits; rows without a vector of the queries' length, or with a
    null or NaN in it, are no hits.
    """
    asked = write_shared(queries.select("query_id", "caller", "query_vec"), "asked-vectors")
    blocks = max(1, -(-asked.count() // QUERIES))
    if blocks > 1:
        rows = write_shared(rows.select("chunk_id", "owner", "vec").filter("vec IS NOT NULL"), "vectors")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = [_best(asked.filter(F.col("block") == b).drop("block"), rows, k, digits) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _best(queries: DataFrame, rows: DataFrame, k: int, digits: int) -> DataFrame:
    table = queries.toArrow()
    at, vectors = _matrix(table["query_vec"])
    norms = np.sqrt((vectors * vectors).sum(1))
    ids = np.array(table["query_id"].to_pylist())[at][norms > 0]
    callers = [c for c, n in zip(table["caller"].take(pa.array(at)).to_pylist(), norms) if n > 0]
    names = {c: i for i, c in enumerate(dict.fromkeys(callers))}
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors[norms > 0], norms[norms > 0], np.array([names[c] for c in callers], int), names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, norms, callers, names = shared.value
        best = Best(len(ids), k)
        for batch in batches if len(ids) else ():
            at, held = _matrix(batch.column(2), asked.shape[1])
            own = np.array(batch.column(0).to_pylist())[at]
            owner = np.array([-1 if o == "" else names.get(o, -2) for o in batch.column(1).take(pa.array(at)).to_pylist()], int)
            for low in range(0, len(at), ROWS):
                part = slice(low, low + ROWS)
                new = np.round(asked @ held[part].T / norms[:, None], digits)
                new[(owner[part] != -1) & (owner[part] != callers[:, None])] = -np.inf
                best.add(new, own[part])
        q, c, scores, _ = best.rows()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q].tolist(), types[0]), pa.array(c.tolist(), types[1]), pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "score"])

    kinds = queries.schema["query_id"].dataType, rows.schema["chunk_id"].dataType
    types = [to_arrow_type(kind) for kind in kinds]
    return rows.select("chunk_id", "owner", "vec").mapInArrow(run, f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double")
