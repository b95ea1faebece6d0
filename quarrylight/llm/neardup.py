"""Near-duplicate groups from bottom-k sketches of word shingles under one hash function.

1. Every document's shingles are hashed; the ``K`` smallest values are its sketch. Documents
   with equal shingle sets form a class; one row per class goes on, whatever ids its rows have.
2. Inverted lists of retained values give candidates. A linked pair shares at least a ``SHARE``
   of its sketches, so it also shares one of the values that are left when the most frequent
   ones are set aside: each class enters the lists of its rarest values only, which keeps
   common passages from joining unrelated texts.
3. Lists longer than a block are linked through representatives first, in at most ``STARS``
   rounds: the member that shares most values with others is compared with all members, and
   members linked to it need not be compared with one another. This is linear in the list.
4. Within a list, sketches of both sides, cut at the smaller of their largest values, are a
   sketch of the union; pairs estimated under ``ESTIMATE`` are dropped, as are pairs that are
   connected already. A pair is looked at in the list of its smallest common value only. Lists
   are cut into blocks, so that no task holds more than two blocks, however long a list is;
   in a long list, only blocks of members that no representative took meet the other blocks.
5. What is left is verified in its lists on full shingle sets: exact Jaccard, and no
   pair that the list's links already connect. Links are joined to components.

Steps 2 to 4 can lose a link only where a sketch is far from the pair's similarity: less than
1e-8 for a pair at the threshold; sets of at most ``K`` shingles are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import Scratch, write_shared
from quarrylight.operators.components import components

WORDS, PERCENT = 5, 80
K, SHARE, ESTIMATE = 48, 0.36, 0.4
#: Rows of a block of a list; rounds of representatives.
BLOCK, STARS = 512, 2
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
MEMO = 400_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.memo: dict[bytes, int] = {}
        self.factors = np.array([xxhash.xxh64_intdigest(f"factor {k}") | 1 for k in range(words)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for word in {*found}.difference(memo):
            memo[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        if len(hashes) < self.words:
            mixed = (hashes * self.factors[: len(hashes)]).sum(keepdims=True) + np.uint64(len(hashes))
        else:
            n = len(hashes) - self.words + 1
            mixed = sum(hashes[k : k + n] * f for k, f in enumerate(self.factors))
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        return np.unique(mixed ^ (mixed >> np.uint64(31)))


def sketches(docs: DataFrame, *, words: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, n (shingles), digest of the whole set and sketch (ascending as unsigned) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            counts, digests, kept = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                counts.append(len(found))
                digests.append(xxhash.xxh128_digest(found.tobytes()))
                kept.append(found[:k].view(np.int64))
            offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def _runs(work: Callable[[pa.Table], list[list] | None], names: list[str], types: list[pa.DataType]):
    """An mapInArrow function that calls ``work`` on each run of rows with equal (value, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []
        carried_key = None
        out: list[list] = [[] for _ in names]

        def take(table: pa.Table) -> None:
            for column, more in zip(out, work(table) or ()):
                column.extend(more)

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            for start, end in zip(bounds, bounds[1:]):
                key = tuple(keys[start])
                if carried and key != carried_key:
                    take(pa.Table.from_batches(carried))
                    carried = []
                if end == len(keys):
                    carried.append(batch.slice(start, end - start))
                    carried_key = key
                elif carried:
                    take(pa.Table.from_batches([*carried, batch.slice(start, end - start)]))
                    carried = []
                elif end - start > 1:
                    take(pa.Table.from_batches([batch.slice(start, end - start)]))
            if len(out[0]) > 5000:
                yield batch_out()
        if carried:
            take(pa.Table.from_batches(carried))
        yield batch_out()

    return run


def _matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    """Value lists as rows of ``k`` unsigned values, padded at the end by TOP."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(lengths), k), TOP, np.uint64)
    out[np.arange(k)[None, :] < lengths[:, None]] = column.flatten().to_numpy().view(np.uint64)
    return out


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each left row shares with each right row; TOP is no value."""
    values, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    inverse = inverse.reshape(-1, left.shape[1])
    times = np.bincount(inverse.ravel(), minlength=len(values))
    slot = np.where((times > 1) & (values != TOP), np.cumsum((times > 1) & (values != TOP)), 0)
    inverse = slot[inverse]
    spread = np.zeros((len(inverse), slot.max() + 1 if len(slot) else 1), np.float32)
    spread[np.arange(len(inverse))[:, None], inverse] = 1
    spread = spread[:, 1:]
    return spread[: len(left)] @ spread[len(left) :].T


def similar_by_sketch(left: np.ndarray, n: np.ndarray, right: np.ndarray, m: np.ndarray, k: int, percent: int, estimate: float) -> np.ndarray:
    """Pairs of a left and a right set whose union sketch puts their similarity at ``estimate`` or more and whose sizes allow a link."""
    common = _shared(left, right)

    def largest(sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(size <= k, TOP, sketch[:, k - 1])

    def within(sketch: np.ndarray, size: np.ndarray, tops: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(np.searchsorted(row, tops, side="right"), held) for row, held in zip(sketch, np.minimum(size, k))])

    union = within(left, n, largest(right, m)) + within(right, m, largest(left, n)).T - common
    sizes = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    return (common >= estimate * union) & sizes


def _flag(k: int, percent: int, estimate: float):
    """Members of a list's block pair that look linked to another one they are not connected with."""

    def work(table: pa.Table) -> list[list] | None:
        value = np.uint64(table["value"][0].as_py() & 0xFFFFFFFFFFFFFFFF)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sketch, n, label, block = _matrix(table["sketch"], k), table["n"].to_numpy(), table["label"].to_numpy(), table["block"].to_numpy()
        passed = np.zeros((len(n), len(n)), bool)
        if i == j:
            passed[:] = similar_by_sketch(sketch, n, sketch, n, k, percent, estimate)
        else:
            own, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(own) or not len(other):
                return None
            passed[np.ix_(own, other)] = similar_by_sketch(sketch[own], n[own], sketch[other], n[other], k, percent, estimate)
            passed |= passed.T
        passed &= label[:, None] != label[None, :]
        if not passed.any():
            return None
        prefix = _matrix(table["prefix"], k)
        passed &= _shared(np.where(prefix < value, prefix, TOP), np.where(prefix < value, prefix, TOP)) == 0
        at = np.flatnonzero(passed.any(1))
        return [[table["value"][0].as_py()] * len(at), [i] * len(at), [j] * len(at), table["doc"].to_numpy()[at].tolist(), block[at].tolist(), label[at].tolist()]

    return work


def _flag_star(k: int, percent: int, estimate: float):
    """Members of a block that look linked to the representative, and the representative if there are any."""

    def work(table: pa.Table) -> list[list] | None:
        sketch, n, docs = _matrix(table["sketch"], k), table["n"].to_numpy(), table["doc"].to_numpy()
        rep = table["value"][0].as_py()
        at = int(np.flatnonzero(docs == rep)[0])
        passed = similar_by_sketch(sketch[at : at + 1], n[at : at + 1], sketch, n, k, percent, estimate)[0]
        passed[at] = True
        found = docs[passed].tolist()
        return [[rep] * len(found), [table["i"][0].as_py()] * len(found), [0] * len(found), found] if len(found) > 1 else None

    return work


def _verify_star(percent: int):
    """Links of a block's members with the representative, by exact Jaccard."""

    def work(table: pa.Table) -> list[list] | None:
        docs, rep = table["doc"].to_numpy(), table["value"][0].as_py()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
        own = sets[int(np.flatnonzero(docs == rep)[0])]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(size)])])
        found = docs[(100 * both >= percent * (len(own) + size - both)) & (docs != rep)].tolist()
        return [[rep] * len(found), found]

    return work


def _verify(percent: int):
    def work(table: pa.Table) -> list[list] | None:
        ids, block = table["doc"].to_numpy(), table["block"].to_numpy()
        across = table["i"][0].as_py() != table["j"][0].as_py()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
        size = np.array([len(s) for s in sets])
        order = np.argsort(ids, kind="stable")
        _, root = np.unique(table["label"].to_numpy(), return_inverse=True)
        found: list[list] = [[], []]
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *size])
        for at, p in enumerate(order):
            others = order[at + 1 :]
            others = others[root[others] != root[p]]
            others = others[100 * np.minimum(size[others], size[p]) >= percent * np.maximum(size[others], size[p])]
            if across:
                others = others[block[others] != block[p]]
            if not len(others):
                continue
            pool = flat if len(others) > len(ids) // 2 else np.concatenate([sets[q] for q in others])
            place = np.searchsorted(sets[p], pool)
            hit = sets[p][np.minimum(place, size[p] - 1)] == pool
            total = np.concatenate([[0], np.cumsum(hit)])
            if pool is flat:
                both = total[starts[others + 1]] - total[starts[others]]
            else:
                ends = np.cumsum(size[others])
                both = total[ends] - total[ends - size[others]]
            linked = others[100 * both >= percent * (size[p] + size[others] - both)]
            found[0] += [int(ids[p])] * len(linked)
            found[1] += ids[linked].tolist()
            root[np.isin(root, root[linked])] = root[p]
        return found

    return work


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """doc and shingles (the whole set, packed) of the classes in ``wanted`` (doc, rep, n, digest), from the texts of their least ids."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            sets = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["rep", "digest", "shingles"])

    wanted = scratch.limited(wanted.select("rep", "digest", "doc"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi")
    return texts.mapInArrow(whole, "rep long, digest binary, shingles binary").join(wanted, ["rep", "digest"]).select("doc", "shingles").dropDuplicates(["doc"])


def _star_links(entered: DataFrame, long: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, k: int, estimate: float, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, labels, mains): links of the long lists' members with representatives, the component of each
    linked member (doc, label), and of each list's first representative (value, main)."""
    members = scratch.write(entered.select("doc", "weight", F.explode("prefix").alias("value")).join(scratch.limited(long, "long-lists"), "value"), "members")
    entries, lists = members.count(), long.count()
    edges = labels = firsts = mains = None
    for _ in range(STARS):
        if edges is None:
            labelled = members.withColumn("label", F.col("doc"))
            open_ = labelled
        else:
            labelled = members.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
            open_ = scratch.write(labelled.join(scratch.limited(mains, "mains"), "value").filter("label <> main"), "open")
            open_ = open_.join(scratch.limited(open_.groupBy("value").count().filter(F.col("count") > block).select("value"), "open-lists"), "value", "left_semi")
        best = F.max(F.struct("weight", (-F.col("doc")).alias("minus"), "label"))
        reps = scratch.write(open_.groupBy("value").agg(best.alias("best")).select("value", (-F.col("best.minus")).alias("rep"), F.col("best.label").alias("own")), "representatives", lists)
        if reps.isEmpty():
            break
        pairs = scratch.write(labelled.join(scratch.limited(reps, "representatives"), "value").filter("label <> own").select("rep", "doc").distinct(), "stars", entries)
        blocks = pairs.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        blocks = scratch.limited(scratch.write(blocks, "star-blocks", lists), "star-blocks")
        dealt = pairs.join(blocks, "rep").select(F.col("rep").alias("value"), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("i"), "doc")
        dealt = dealt.unionByName(blocks.select(F.col("rep").alias("value"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("rep").alias("doc")))
        dealt = dealt.withColumn("j", F.lit(0)).join(entered.select("doc", "n", "sketch"), "doc").select("value", "i", "j", "doc", "n", "sketch")
        names, types = ["value", "i", "j", "doc"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        flagged = scratch.write(_grouped(dealt).mapInArrow(_runs(_flag_star(k, percent, estimate), names, types), "value long, i int, j int, doc long"), "star-flagged")
        verified = _grouped(flagged.join(sets(flagged), "doc").select("value", "i", "j", "doc", "shingles"))
        found = verified.mapInArrow(_runs(_verify_star(percent), ["a", "b"], [pa.int64(), pa.int64()]), "a long, b long")
        edges = scratch.write(found if edges is None else found.unionByName(edges), "star-links")
        labels = components(edges).select(F.col("vertex").alias("doc"), F.col("component").alias("label"))
        firsts = firsts if firsts is not None else reps.select("value", F.col("rep").alias("doc"))
        mains = scratch.write(firsts.join(labels, "doc", "left").select("value", F.coalesce("label", "doc").alias("main")), "mains", lists)
    return edges, labels, mains


def links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], *, percent: int = PERCENT, k: int = K, share: float = SHARE, estimate: float = ESTIMATE, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Edges (a, b) that connect all linked classes (doc, n, sketch); ``sets`` gives the whole sets of a table's docs.

    The edges are read from tables of ``scratch``.
    """
    scratch = scratch or Scratch()
    values = classes.select("doc", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = values.join(often, "value").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    length = F.size("sketch")
    kept = length - F.greatest(F.lit(1), F.floor(F.lit(share) * length).cast("int")) + 1 - (length - F.size("found"))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda total, x: total + x["df"])
    entered = classes.join(shared, "doc").withColumn("left", kept).filter("left > 0")
    entered = scratch.write(entered.select("doc", "n", "sketch", weight.alias("weight"), F.transform(F.slice("found", F.lit(1), F.col("left")), lambda x: x["value"]).alias("prefix")), "prefixes")
    narrow = entered.select("doc", F.explode("prefix").alias("value"))
    sizes = scratch.write(narrow.groupBy("value").agg(F.count("*").alias("rows")).filter("rows > 1"), "lists")
    long = sizes.filter(F.col("rows") > block).select("value")
    stars = None if long.isEmpty() else _star_links(entered, long, sets, percent, k, estimate, block, scratch)
    one = F.lit(1)
    if stars:
        edges, labels, mains = stars
        labels, mains = scratch.limited(labels, "labels"), scratch.limited(mains, "mains")
        open_ = narrow.join(labels, "doc", "left").join(mains, "value").select("value", (F.coalesce("label", "doc") == F.col("main")).alias("taken"))
        cut = open_.groupBy("value").agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("open"))
        lists = sizes.join(cut, "value", "left").join(mains, "value", "left")
        lists = lists.select("value", "main", F.ceil(F.coalesce("open", "rows") / block).cast("int").alias("opens"), F.ceil(F.coalesce("taken", F.lit(0)) / block).cast("int").alias("takens")).filter("opens > 0")
        entries = entered.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    else:
        lists = sizes.select("value", F.lit(None).cast("long").alias("main"), one.alias("opens"), F.lit(0).alias("takens"))
        entries = entered.withColumn("label", F.col("doc"))
    entries = entries.select("doc", "n", "sketch", "label", F.sort_array("prefix").alias("prefix"), F.explode("prefix").alias("value")).join(lists, "value")
    taken = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    number = F.xxhash64("doc")
    entries = entries.withColumn("taken", taken).withColumn("block", F.when(F.col("taken"), F.col("opens") + F.pmod(number, F.greatest("takens", one))).otherwise(F.pmod(number, F.col("opens"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("taken"), F.col("opens")).otherwise(F.col("opens") + F.col("takens")) - 1)).alias("other")
    dealt = entries.select("*", other).select("value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "n", "sketch", "prefix", "block", "label")
    names, types = ["value", "i", "j", "doc", "block", "label"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    flagged = scratch.write(_grouped(dealt).mapInArrow(_runs(_flag(k, percent, estimate), names, types), "value long, i int, j int, doc long, block int, label long"), "flagged")
    verified = _grouped(flagged.join(sets(flagged), "doc").select("value", "i", "j", "doc", "block", "label", "shingles"))
    found = verified.mapInArrow(_runs(_verify(percent), ["a", "b"], [pa.int64(), pa.int64()]), "a long, b long")
    return found.unionByName(edges) if stars else found


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id), one row per row of ``docs``.

    A document with fewer than ``words`` words has its whole sequence as one shingle. Null, empty
    and blank texts have no shingles and link with nothing. Rows without an id link with nothing
    and have a null component; repeated rows of one id share theirs, with or without a text, and different
    texts of one id are linked through it. Texts are read whole, however long; an empty table gives no rows. Other
    columns are not read.
    """
    known = write_shared(sketches(docs, words=words), "shingles")
    linkable = known.filter("n > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    # numbered as they are written, so that every reader sees the same numbers
    classes = write_shared(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    owned, scratch = docs.filter(F.col("doc_id").isNotNull()), Scratch()

    def sets(flagged: DataFrame) -> DataFrame:
        return _sets(owned, classes.join(scratch.limited(flagged.select("doc").distinct(), "flagged-docs"), "doc", "left_semi"), words, scratch)

    several = linkable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id")
    own = linkable.join(scratch.limited(several, "several-texts"), "doc_id", "left_semi").select("doc_id", "n", "digest").distinct().join(classes, ["n", "digest"]).select("doc_id", "doc")
    of_one_id = own.groupBy("doc_id").agg(F.min("doc").alias("a")).join(own, "doc_id").select("a", F.col("doc").alias("b")).filter("a <> b")
    found = components(links(classes.select("doc", "n", "sketch"), sets, percent=percent, scratch=scratch).unionByName(of_one_id))
    scratch.drop()
    labelled = classes.select("n", "digest", "rep", "doc").join(found, classes["doc"] == found["vertex"], "left").select("n", "digest", "rep", F.coalesce("component", "doc").alias("group"))
    # stored, so that it is broadcast or, beyond that, meets plain shuffled rows, which Spark can split where a group is large
    least = scratch.limited(labelled.groupBy("group").agg(F.min("rep").alias("component")), "groups")
    labelled = labelled.join(least, "group").select("n", "digest", "component")
    joined = known.filter("n > 0").select("doc_id", "n", "digest").join(labelled, ["n", "digest"], "left").select("doc_id", "n", "component")
    blank = known.filter("n = 0").select("doc_id", "n")
    of_id = joined.join(blank.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
    joined = joined.unionByName(blank.join(of_id, "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; rows that repeat an id stay or go together."""
    gone = Scratch().limited(near_duplicates(docs, words=words, percent=percent).filter("NOT kept").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
