"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words, of any length, and their stems of three to seven letters, all
hashed to ``DIMENSION`` rows of weights and factors; none is left out. A term's value is its count over the
root of the text's word count, times the row's scale. The machine scores bias + linear weights + the
pairwise interactions of the terms' factors, so a pair of terms (an insult with a group mention)
can count for more than its parts, even if each part alone says nothing.

A row's scale grows with how differently the classes' texts have it (the root of the log likelihood ratio
against ``TELLING``), from ``FLOOR`` to 1, relative to the most telling row: thousands of rare words do not
outweigh the others, and where no term says anything alone, all count alike. Both constants were chosen
on folds of rows outside the held-out third.

Training reads at most ``MAX_PER_CLASS`` labelled texts of each class, chosen by hash, within the bounds in
bytes that ``_labels`` names. Every document is scored, over its whole text. Only the text is an
input. A null or empty text has no terms and scores the bias. Repeated rows are scored alike;
repeated labelled rows count once per label and text. Other columns than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import drop_shared, write_shared
from quarrylight.llm._labels import MAX_BYTES, MAX_TOTAL, bounded, labelled

_words = re.compile(r"[^\W\d_]+").findall
STEMS = range(3, 8)
MAX_PER_CLASS = 5000
DIMENSION, FLOOR, TELLING, POWER = 1 << 18, 0.05, 4.0, 4
FACTORS, EPOCHS, STEPS, SEED = 8, 8, 20_000, 7
MEMO = 400_000
THRESHOLD = 0.7


def term_hashes(word: str) -> tuple[int, ...]:
    """The hash of a word and those of its stems."""
    return (zlib.crc32(word.encode()), *(zlib.crc32(f"^{word[:n]}".encode()) for n in STEMS if n <= len(word)))


class Terms:
    """Rows and unscaled values of texts, with the rows of words kept between texts."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.memo: dict[str, np.ndarray] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _words((text or "").lower())
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.memo) > MEMO:
            self.memo.clear()
        counts, found = Counter(words), []
        for word in counts:
            rows = self.memo.get(word)
            if rows is None:
                rows = self.memo[word] = np.array(term_hashes(word), np.int64) % self.dimension
            found.append(rows)
        times = np.repeat(np.fromiter(counts.values(), float, len(counts)), np.fromiter(map(len, found), np.int64, len(found)))
        rows, place = np.unique(np.concatenate(found), return_inverse=True)
        return rows, np.bincount(place, times) / len(words) ** 0.5


@dataclass
class FactorMachine:
    """A weight (first column) and factors (the others) of each row of the hashed terms, and the rows' scales (None: 1)."""

    bias: float
    table: np.ndarray
    scale: np.ndarray | None = None

    def logit(self, rows: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The score before the logistic, the terms' scaled rows and their sum."""
        own = self.table[rows] * values[:, None]
        total = own.sum(0)
        return self.bias + float(total[0]) + 0.5 * float(total[1:] @ total[1:] - np.einsum("ij,ij->", own[:, 1:], own[:, 1:])), own, total

    def score(self, rows: np.ndarray, values: np.ndarray) -> float:
        """Probability for a text with these unscaled values by row."""
        if self.scale is not None:
            values = values * self.scale[rows]
        return 1 / (1 + math.exp(-min(max(self.logit(rows, values)[0], -30.0), 30.0)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, scale: np.ndarray | None = None, dimension: int = DIMENSION, factors: int = FACTORS, epochs: int | None = None, rate: float = 0.3, decay: float = 1e-4, seed: int = SEED) -> FactorMachine:
    """Fit by AdaGrad on the log loss, classes weighted alike; a text is its rows and scaled values.

    Without ``epochs``, there are EPOCHS of them, or as many as make STEPS steps. Without texts the
    machine scores its bias.
    """
    epochs = epochs or max(EPOCHS, -(-STEPS // max(1, len(texts))))
    rng = np.random.default_rng(seed)
    share = min(max(sum(labels) / max(1, len(labels)), 1e-3), 1 - 1e-3)
    table = rng.normal(0, 0.05, (dimension, 1 + factors)) if texts else np.zeros((dimension, 1 + factors))
    table[:, 0] = 0
    machine = FactorMachine(-2.0, table, scale)
    squares, squares_bias = np.full(table.shape, 1e-2), 1e-2
    rates = np.full(1 + factors, 0.3 * rate)
    rates[0] = rate
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            at, x = texts[k]
            z, own, total = machine.logit(at, x)
            d = (1 / (1 + math.exp(-min(max(z, -30.0), 30.0))) - labels[k]) * (0.5 / share if labels[k] else 0.5 / (1 - share))
            squares_bias += d * d
            machine.bias -= rate * d / squares_bias**0.5
            step = total - own
            step[:, 0] = 1
            step *= d * x[:, None]
            held = table[at]
            step += decay * held
            square = squares[at] + step * step
            squares[at] = square
            table[at] = held - rates * step / np.sqrt(square)
    return machine


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class: int = MAX_PER_CLASS, label: str = "toxic") -> DataFrame:
    """doc_id, label and text of at most ``per_class`` labelled documents of each class, lowest hash first."""
    return labelled(docs, labels, label, per_class)


def scales(sample: DataFrame, n: tuple[int, int], *, dimension: int = DIMENSION) -> np.ndarray:
    """The scale of every row, from the texts (doc_id, label, text) of each class, ``n`` in all, that have it.

    Tasks count before the shuffle; the driver gets two numbers for each row, ``dimension`` rows at most.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(dimension)
        for batch in batches:
            seen = np.zeros((2, dimension), np.int64)
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[label, terms(text.as_py())[0]] += 1
            rows = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(seen[0, rows]), pa.array(seen[1, rows])], names=["term", "c0", "c1"])

    sums = sample.select(F.col("label").cast("int"), "text").mapInArrow(counted, "term long, c0 long, c1 long").groupBy("term").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    seen = np.zeros((2, dimension))
    seen[:, sums["term"].to_numpy()] = sums["c0"].to_numpy(), sums["c1"].to_numpy()

    def likelihood(k: np.ndarray, of: int, share: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(share, 1e-300)), 0) + np.where(k < of, (of - k) * np.log(np.maximum(1 - share, 1e-300)), 0)

    together = (seen[0] + seen[1]) / sum(n)
    gained = sum(likelihood(seen[c], n[c], seen[c] / n[c]) - likelihood(seen[c], n[c], together) for c in (0, 1))
    told = FLOOR + (1 - FLOOR) * np.minimum(1, (np.sqrt(2 * np.maximum(gained, 0)) / TELLING) ** POWER)
    return told / told.max()


def fit(sample: DataFrame, *, most_bytes: int = MAX_BYTES, most_total: int = MAX_TOTAL, **options) -> FactorMachine:
    """The machine for a bounded sample of (doc_id, label, text); terms are counted and valued on the executors.

    The driver holds a row number and a value for each distinct term of each text, at most ``most_total`` bytes of text
    a class, as Arrow buffers. A sample without both classes gives a machine that scores its bias.
    """
    stored = write_shared(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").distinct(), "toxicity-sample")
    held = write_shared(bounded(stored, most_bytes, most_total), "toxicity-texts")
    counts = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        drop_shared(stored, held)
        return train([], [], **options)
    scale = scales(held, (counts[0], counts[1]))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype(np.int32).tobytes() for r, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], names=["doc_id", "label", "rows", "x"])

    table = held.mapInArrow(valued, "doc_id long, label int, rows binary, x binary").toArrow().combine_chunks()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("rows", "ascending"), ("x", "ascending")])
    drop_shared(stored, held)
    rows = [np.frombuffer(r.as_buffer(), np.int32) for r in table["rows"]]
    texts = [(r, np.frombuffer(x.as_buffer(), np.float32) * scale[r]) for r, x in zip(rows, table["x"])]
    return train(texts, table["label"].to_pylist(), scale=scale, **options)


def score(docs: DataFrame, machine: FactorMachine, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 at or above ``threshold``) of each row; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        terms = Terms(len(machine.table))
        for batch in batches:
            scores = [machine.score(*terms(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
