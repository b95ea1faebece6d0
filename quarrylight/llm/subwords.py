"""Quality by supervised subword embeddings: learned vectors of words and character n-grams, averaged, then softmax.

A text's features are its words (runs of other than white space, case and punctuation kept) and the
character n-grams of each word between boundary marks, all hashed to ``DIMENSION`` rows of learned
vectors. Of word pairs only the pair of equal words is learnt, under one row that counts as often as
the word has features: other pairs are too rare in a bounded sample. A document's vector is the mean
over all its features, repeats counted, and over ``BLANKS`` null vectors, so that a text of one word is
not sure of anything; a linear layer and softmax give each class's probability. Numpy stochastic
gradient descent fits both, as the learning rate falls to nothing.

Training reads at most ``MAX_PER_CLASS`` labelled texts of each class, chosen by hash, of which
texts above ``MAX_BYTES`` bytes and texts beyond a running total of ``MAX_TOTAL`` bytes are left out:
the only bounds, and only on what is learnt from. Every document is scored over its whole text. As
the output is linear in the mean, a word's share in the class margin is one number: it is computed once and
kept (``MEMO`` words at most, then started anew), so scoring costs a lookup a word.

Only the text is an input. A null or empty text has no features and scores as the bias has it. Repeated rows are
scored alike; repeated labelled rows count once per label and text. Without labels of two classes
every score is that of the only class seen, or a half. Ties do not arise. Other columns than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import drop_shared, write_shared
from quarrylight.llm._labels import MAX_BYTES, MAX_TOTAL, bounded, labelled

NGRAMS = range(3, 6)
DIMENSION, VECTOR, SEED = 1 << 17, 16, 11
MAX_PER_CLASS = 4000
#: Passes over the sample, or as many as make STEPS steps; rate at the start.
EPOCHS, STEPS, RATE = 4, 24_000, 1.0
BLANKS = 50
MEMO = 400_000
THRESHOLD = 0.3


def features(words: list[str], dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and of their character n-grams, and the number of the word that each is of.

    All n-grams of all words are hashed at once: a polynomial of the characters, mixed by a product.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    rows, owners = [np.fromiter((zlib.crc32(w.encode()) % dimension for w in words), np.int64, len(words))], [np.arange(len(words))]
    polynomial = np.zeros(len(codes), np.uint64)
    for n in range(1, NGRAMS[-1] + 1):
        polynomial = polynomial[: max(0, len(codes) - n + 1)] * np.uint64(1_000_003) + codes[n - 1 :]
        if n in NGRAMS:
            whole = left[: len(polynomial)] >= n
            mixed = (polynomial[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(((mixed >> np.uint64(32)) % np.uint64(dimension)).astype(np.int64))
            owners.append(owner[: len(polynomial)][whole])
    return np.concatenate(rows), np.concatenate(owners)


def words_of(text: str | None) -> tuple[Counter[str], Counter[str]]:
    """How often a text has each word, and how often right after itself."""
    words = (text or "").split()
    return Counter(words), Counter(compress(words, map(eq, words, words[1:])))


def again_row(dimension: int = DIMENSION) -> int:
    """The row of a pair of equal words."""
    return zlib.crc32(b"\1") % dimension


def counts(text: str | None, dimension: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a text, ascending, and each row's share of all features."""
    each, again = words_of(text)
    rows, owner = features(list(each), dimension)
    times = np.fromiter(each.values(), np.int64, len(each))
    pairs = np.fromiter((again[w] for w in each), np.int64, len(each))
    found = np.bincount(rows, times[owner], dimension)
    found[again_row(dimension)] += int((pairs * np.bincount(owner, minlength=len(each))).sum())
    held = np.flatnonzero(found)
    return held.astype(np.int32), (found[held] / (BLANKS + found.sum())).astype(np.float32)


@dataclass
class Embeddings:
    """Vectors of the hashed features, and the output layer of two classes."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def probability(self, rows: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Softmax over the classes for one text."""
        z = self.output @ (share @ self.vectors[rows]) + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def margins(self) -> tuple[np.ndarray, float]:
        """Per row its part in the log odds of class 1, and the bias's."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, dimension: int = DIMENSION, vector: int = VECTOR, epochs: int | None = None, rate: float = RATE, seed: int = SEED) -> Embeddings:
    """Stochastic gradient descent on the log loss; the rate falls linearly to nothing.

    The bias starts at the classes' log shares. Without two classes nothing is learnt beyond that.
    """
    rng = np.random.default_rng(seed)
    share = (np.bincount(np.array(labels, int), minlength=2) + 1) / (len(labels) + 2)
    model = Embeddings(rng.uniform(-1 / vector, 1 / vector, (dimension, vector)).astype(np.float32), rng.normal(0, 0.1, (2, vector)).astype(np.float32), np.log(share).astype(np.float32))
    if len(set(labels)) < 2:
        model.output[:] = 0
        return model
    epochs = epochs or max(EPOCHS, -(-STEPS // len(texts)))
    done, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            rows, x = texts[k]
            now = rate * (1 - done / steps)
            done += 1
            mean = x @ model.vectors[rows]
            z = model.output @ mean + model.bias
            e = np.exp(z - z.max())
            d = e / e.sum()
            d[labels[k]] -= 1
            back = model.output.T @ d
            model.output -= now * np.outer(d, mean)
            model.bias -= 0.1 * now * d
            # A row's step is by its share of the text against the text's mean share, so that long texts teach as much as short ones.
            model.vectors[rows] -= (now * x * (1 / max(float(x @ x), 1e-6)) ** 0.5)[:, None] * back
    return model


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class: int = MAX_PER_CLASS, label: str = "quality") -> DataFrame:
    """doc_id, label and text of at most ``per_class`` labelled documents of each class, lowest hash first."""
    return labelled(docs, labels, label, per_class)


def fit(sample: DataFrame, *, most_bytes: int = MAX_BYTES, most_total: int = MAX_TOTAL, **options) -> Embeddings:
    """The model for a bounded sample of (doc_id, label, text).

    Texts are counted on the executors. The driver holds a row number and a share for each distinct
    feature of each text: at most ``most_total`` bytes of text a class, as Arrow buffers.
    """
    stored = write_shared(sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").distinct(), "quality-sample")
    held = bounded(stored, most_bytes, most_total)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["doc_id", "label", "rows", "share"])

    table = held.mapInArrow(counted, "doc_id long, label int, rows binary, share binary").toArrow().combine_chunks()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("rows", "ascending"), ("share", "ascending")])
    drop_shared(stored)
    texts = [(np.frombuffer(r.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32)) for r, x in zip(table["rows"], table["share"])]
    return train(texts, table["label"].to_pylist(), **options)


def score(docs: DataFrame, model: Embeddings, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 at or above ``threshold``) of each row; other columns are not read.

    What is broadcast is one number a hashed row, ``DIMENSION`` in all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.margins())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        known: dict[str, tuple[float, int]] = {}
        pair = float(table[again_row(len(table))])
        for batch in batches:
            scores = []
            for text in batch.column(1):
                total, n = 0.0, 0
                each, again = words_of(text.as_py())
                if len(known) > MEMO:
                    known.clear()
                new = [w for w in each if w not in known]
                if new:
                    rows, owner = features(new, len(table))
                    known |= zip(new, zip(np.bincount(owner, table[rows]).tolist(), np.bincount(owner).tolist()))
                for word, times in each.items():
                    margin, size = known[word]
                    total += times * margin
                    n += times * size
                for word, times in again.items():
                    size = times * known[word][1]
                    total += size * pair
                    n += size
                scores.append(1 / (1 + math.exp(-min(max(bias + total / (BLANKS + n), -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
