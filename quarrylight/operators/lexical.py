"""BM25 of texts against a stated query set: each text's terms are counted within its row, weights of a block of queries are broadcast, each task scores its texts against all of them, and only the best of each task are shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.functions.text import whole_words, word_tokens
from quarrylight.operators.matrix import QUERIES, ROWS, Best
from quarrylight.operators.numbering import numbered
from quarrylight.sources.shared import write_shared

#: Terms that most queries of a block have: these go through a matrix product, the others pair by pair, at most PAIRS at once.
COMMON, PAIRS = 512, 131_072
#: Terms of queries that are broadcast at most, to leave others out where texts are counted (some 100 bytes each in a task).
TERMS = 1_000_000
#: Raw words of which a task remembers how they are cut (some 200 bytes each).
KEPT = 200_000
#: Texts whose terms a task holds at once.
SLICE = 1024


class Words:
    """Counts a text's terms, and remembers for some ``KEPT`` raw words how they are cut. only: other terms count in the length alone."""

    def __init__(self, only: set[str] | None = None):
        self.only, self.kept = only, {}

    def cut(self, word: str) -> str | None | tuple[int, tuple[str, ...]]:
        """A raw word's one token, None if that is not wanted; or how many tokens it is, and which of them are wanted."""
        tokens = word_tokens(word)
        wanted = tokens if self.only is None else [t for t in tokens if t in self.only]
        return (wanted[0] if wanted else None) if len(tokens) == 1 else (len(tokens), tuple(wanted))

    def count(self, text: str) -> tuple[int, dict[str, int]]:
        """The text's token count, and its wanted terms with their tfs."""
        if len(self.kept) > KEPT:
            self.kept = {}
        kept, out, more = self.kept, {}, 0
        words = whole_words(text)
        # Most words are one token: nothing but its string is kept for them, which the garbage collector need not visit.
        for word, n in Counter(words).items():
            try:
                known = kept[word]
            except KeyError:
                known = kept[word] = self.cut(word)
            if known is None:
                continue
            if known.__class__ is str:
                out[known] = out.get(known, 0) + n
                continue
            more += n * (known[0] - 1)
            for term in known[1]:
                out[term] = out.get(term, 0) + n
        return len(words) + more, out


def counted_texts(texts: DataFrame, only: DataFrame | None = None, key: str = "chunk_id", text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row a text: key, ``carried``, its token count dl, its terms and their tfs. Nothing is shuffled.

    only (term): other terms are left out, as far as ``TERMS`` of them are broadcast; of more, all terms are kept. Texts
    without terms have a row with empty lists.
    """
    session = texts.sparkSession
    wanted = None if only is None else only.select("term").distinct().limit(TERMS + 1).toArrow()["term"].combine_chunks()
    shared = None if wanted is None or len(wanted) > TERMS else session.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Words(None if shared is None else set(shared.value.to_pylist()))
        for batch in (whole.slice(low, SLICE) for whole in batches for low in range(0, whole.num_rows, SLICE)):
            dl, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(batch.num_columns - 1):
                size, own = cut.count(text.as_py() or "")
                dl.append(size)
                terms.extend(own)
                tfs.extend(own.values())
                ends.append(len(terms))
            starts = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(terms, pa.string())), pa.ListArray.from_arrays(starts, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(dl, pa.int32()), *lists], names=[*batch.schema.names[:-1], "dl", "terms", "tfs"])

    own = texts.select(key, *carried, F.col(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{kept}, dl int, terms array<string>, tfs array<int>")


def packed(posted: DataFrame) -> DataFrame:
    """One row a chunk: chunk_id, dl, terms and their tfs, of postings (chunk_id, term, tf, dl)."""
    rows = posted.groupBy("chunk_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("e"))
    return rows.select("chunk_id", F.col("dl").cast("int").alias("dl"), F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs"))


class Weights:
    """The terms of a block of queries, most frequent first; by term the texts that have it, their weights and counts.

    Queries whose terms and counts are the same are one text: ``first`` has each text's first query in ``keys``, and their end.
    """

    def __init__(self, asked: pa.Table):
        term = asked["term"].combine_chunks().dictionary_encode()
        code = np.asarray(term.indices, np.int64)
        n = np.bincount(code, minlength=len(term.dictionary))
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place, counts, idf = place[code], np.asarray(asked["qtf"], np.float64), np.asarray(asked["idf"], np.float64)
        self.terms = term.dictionary.take(pa.array(order))
        query, caller = (asked[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "caller"))
        both = np.asarray(query.indices, np.int64) * len(caller.dictionary) + np.asarray(caller.indices, np.int64)
        by = np.lexsort((place, both))
        starts = np.flatnonzero(np.r_[len(both) > 0, both[by][1:] != both[by][:-1]])
        ends = np.r_[starts[1:], len(by)]
        texts: dict[bytes, int] = {}
        text = np.array([texts.setdefault(np.r_[place[by[i:j]], counts[by[i:j]]].tobytes(), len(texts)) for i, j in zip(starts, ends)], np.int64)
        heads = by[starts[np.argsort(text, kind="stable")]]
        self.keys = query.dictionary.take(query.indices.take(pa.array(heads))).to_pylist()
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))]
        names = [c.as_py() for c in caller.dictionary]
        self.names = {c: i for i, c in enumerate(names)}
        self.callers = np.asarray(caller.indices, np.int64)[heads]
        alone = np.unique(text, return_index=True)[1]
        own = np.concatenate([by[starts[k] : ends[k]] for k in alone]) if len(alone) else by
        number = np.repeat(np.arange(len(texts)), ends[alone] - starts[alone])
        sort = np.argsort(place[own], kind="stable")
        own, self.query = own[sort], number[sort]
        self.starts = np.r_[0, np.cumsum(np.bincount(place[own], minlength=len(self.terms)))]
        self.counts, self.weights = counts[own], counts[own] * idf[own]

    def common(self, values: np.ndarray) -> np.ndarray:
        """Texts by common terms."""
        n = min(COMMON, len(self.terms))
        out = np.zeros((len(self.first) - 1, n))
        end = self.starts[n]
        out[self.query[:end], np.repeat(np.arange(n), np.diff(self.starts[: n + 1]))] = values[:end]
        return out

    def add_rare(self, out: np.ndarray, values: np.ndarray, term: np.ndarray, row: np.ndarray, gain: np.ndarray) -> None:
        """Add value * gain of each posting (term, row) to ``out`` (texts by rows, in either memory order) at each text that has the term."""
        per_text, per_row = (out.shape[1], 1) if out.flags.c_contiguous else (1, out.shape[0])
        n = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(n)
        flat, low = out.reshape(-1, order="A"), 0
        while low < len(term):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            m = n[low:high]
            at = np.repeat(self.starts[term[low:high]] - (ends[low:high] - m - before), m)
            at += np.arange(len(at))
            to = self.query[at] * per_text
            to += np.repeat(row[low:high] * per_row, m)
            more = values[at]
            more *= np.repeat(gain[low:high], m)
            np.add.at(flat, to, more)
            low = high


def best_texts(asked: DataFrame, rows: DataFrame, avgdl: float, k: int, digits: int, k1: float, b: float, counted: bool = True) -> DataFrame:
    """query_id, chunk_id, score (rounded, above 0) and matched (0 if not ``counted``) of at most the ``k`` best visible rows of each query in each task.

    asked: query_id, caller, term, qtf, idf; rows: chunk_id, owner, dl, terms, tfs. Ties go to the smaller id. Memory is for a
    block of queries, some 2 ``k`` hits of each and ``ROWS`` texts; nothing is shuffled by pair of query and text. Queries of the same
    terms are dealt to the same block, where these are scored once.
    """
    asked = write_shared(asked.select("query_id", "caller", "term", "qtf", "idf"), "asked")
    blocks = max(1, -(-asked.select("query_id").distinct().count() // QUERIES))
    if blocks == 1:
        return _best(asked, rows, None, avgdl, k, digits, k1, b, counted)
    words = asked.select("term").distinct().limit(TERMS + 1).toArrow()["term"].combine_chunks()
    words = words if len(words) <= TERMS else None
    rows = write_shared(_coded(rows.select("chunk_id", "owner", "dl", "terms", "tfs"), words), "packed")
    alike = write_shared(asked.groupBy("query_id").agg(F.bit_xor(F.xxhash64("term", "qtf")).alias("alike")), "alike")
    block = F.floor((F.col("number") - 1) / QUERIES).cast("int")
    dealt = write_shared(asked.join(numbered(alike, "alike", "query_id").select("query_id", block.alias("block")), "query_id"), "dealt")
    return reduce(DataFrame.unionByName, [_best(dealt.filter(F.col("block") == n), rows, words, avgdl, k, digits, k1, b, counted) for n in range(blocks)])


def _coded(rows: DataFrame, words: pa.Array | None) -> DataFrame:
    """Rows with the places of their terms in ``words`` for terms; others are left out. Without ``words``, terms stay words."""
    if words is None:
        return rows
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pc.index_in(batch.column(3).flatten(), value_set=shared.value)
            ends = np.cumsum(np.r_[0, np.asarray(batch.column(3).value_lengths(), np.int64)])
            starts = pa.array(np.cumsum(np.r_[0, np.asarray(place.is_valid())])[ends], pa.int32())
            lists = [pa.ListArray.from_arrays(starts, values.filter(place.is_valid())) for values in (place, batch.column(4).flatten())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=batch.schema.names)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(run, f"{kept}, terms array<int>, tfs array<int>")


def _best(asked: DataFrame, rows: DataFrame, words: pa.Array | None, avgdl: float, k: int, digits: int, k1: float, b: float, counted: bool) -> DataFrame:
    known = Weights(asked.toArrow())
    place = None if words is None else np.asarray(pc.index_in(words, value_set=known.terms).fill_null(-1), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((known, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        best, weights, counts = Best(len(known.keys), k), np.ascontiguousarray(known.common(known.weights).T), known.common(known.counts).T if counted else None
        n, texts = weights.shape
        slack, each = 10.0**-digits, np.diff(known.first)
        for batch in batches if texts else ():
            ids = np.array(batch.column(0).to_pylist())
            owner = np.array([-1 if o == "" else known.names.get(o, -2) for o in batch.column(1).to_pylist()], np.int64)
            lengths = np.asarray(batch.column(3).value_lengths(), np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            flat = batch.column(3).flatten()
            term = place[np.asarray(flat, np.int64)] if place is not None else np.asarray(pc.index_in(flat, value_set=known.terms).fill_null(-1), np.int64)
            tf = np.asarray(batch.column(4).flatten(), np.float64)
            dl = np.repeat(np.asarray(batch.column(2), np.float64), lengths)
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            for low in range(0, len(ids), ROWS):
                high = min(low + ROWS, len(ids))
                own = slice(starts[low], starts[high])
                row = np.repeat(np.arange(high - low), lengths[low:high])
                met = term[own] >= 0
                at, row, up = term[own][met], row[met], gain[own][met]
                few = at >= n
                often = np.zeros((high - low, n))
                often[row[~few], at[~few]] = up[~few]
                scores = often @ weights
                known.add_rare(scores.T, known.weights, at[few], row[few], up[few])
                # Scores are rounded where they may be among the best of one of the text's queries.
                least = np.maximum(np.minimum.reduceat(best.least, known.first[:-1]) - slack, slack / 4)
                hit = np.flatnonzero(np.ascontiguousarray((scores >= least).T))
                text, c = hit // (high - low), hit % (high - low)
                q, c = np.repeat(known.first[text], each[text]), np.repeat(c, each[text])
                if len(q) > len(hit):
                    q += np.arange(len(q)) - np.repeat(np.cumsum(each[text]) - each[text], each[text])
                text = np.repeat(text, each[text])
                found = np.round(scores[c, text], digits)
                seen = (found > 0) & (found >= best.least[q]) & ((owner[low:high][c] == -1) | (owner[low:high][c] == known.callers[q]))
                q, c, text, found = q[seen], c[seen], text[seen], found[seen]
                matched = None
                if counted:
                    whole = (often > 0) @ counts
                    known.add_rare(whole.T, known.counts, at[few], row[few], np.ones(few.sum()))
                    matched = whole[c, text]
                if len(q) and len(known.keys) > texts:
                    by = np.argsort(q, kind="stable")
                    q, c, found, matched = q[by], c[by], found[by], None if matched is None else matched[by]
                best.push(q, c, found, ids[low:high], matched)
        q, c, scores, matched = best.rows()
        if len(q):
            told = np.zeros(len(q)) if matched is None else matched
            asked_by = pa.array(known.keys, types[0]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([asked_by, pa.array(c.tolist(), types[1]), pa.array(scores, pa.float64()), pa.array(np.rint(told).astype(np.int64))], names=["query_id", "chunk_id", "score", "matched"])

    kinds = asked.schema["query_id"].dataType, rows.schema["chunk_id"].dataType
    types = [to_arrow_type(kind) for kind in kinds]
    return rows.select("chunk_id", "owner", "dl", "terms", "tfs").mapInArrow(run, f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double, matched long")
