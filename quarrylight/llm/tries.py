"""Prefix trie of conversations by smallest-member ownership.

Each distinct sequence of a conversation's first turns is a node, and a node belongs to its smallest
member. A conversation that owns a node owns all deeper ones of its path, so it owns a suffix of
the path, and (owner, depth) names a node. From that, all sums over subtrees are sums over members:

* tokens that sharing saves are the members' tokens less those of owned nodes. A member that owns
  from depth k on adds its tokens between the node and k;
* leaves are members that own a childless last node;
* children are members that own from the node's next depth on.

So nothing walks the tree: windows mark the owners, and one group-by of the prefixes sums.

Nodes are told apart by depth and 128 bits: every turn's hash (of its depth, role and SHA-256 of its text)
is added up along the path, which running sums do. Every step is dealt so that no conversation,
node or group of copies must meet in one task: turns are put in order by range partitions, running
sums go by blocks of ``BLOCK`` turns, owners by ``SALTS`` parts of a node, ids by chunks of ``CHUNK``.

Turns go by ``turn``, null first; of equal turns, by role, then by the SHA-256 of the text. A null
role or text is empty; repeated rows are turns of their own; rows without a conv_id are left out.
An empty table has no nodes, not even a root. Texts of any length are read once, for digest and
length. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import drop_shared, write_shared
from quarrylight.operators.numbering import dealt_in_order

#: Turns of a block of running sums; parts of a node that is looked through for its owner; ids of a chunk that is hashed at once.
BLOCK, SALTS, CHUNK = 8192, 1024, 512
#: Donors are conversations divisible by FAMILY; a conversation takes under SHARES of the donor's turns.
FAMILY, SHARES = 5, 9
#: Rows of some 60 bytes that are broadcast at most.
BROADCAST_ROWS = 200_000
NODE = ("owner", "depth")


def _if_small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if its count is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, digest and n (UTF-8 bytes) of every turn."""
    text = F.coalesce("text", F.lit(""))
    turns = write_shared(conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n")), "turns")
    placed = dealt_in_order(turns, "conv_id", F.asc_nulls_first("turn"), "role", "digest")
    drop_shared(turns)
    parts = placed.groupBy("conv_id", "__part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A partition begins with at most one conversation that an earlier one holds rows of: no more rows than partitions.
    begun = parts.withColumn("before", F.sum("rows").over(before)).filter("before > 0").select("conv_id", "__part", "before")
    local = F.row_number().over(Window.partitionBy("conv_id", "__part").orderBy("__row"))
    return placed.withColumn("local", local).join(F.broadcast(begun), ["conv_id", "__part"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "role", "digest", "n")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, block, depth, role, digest and n: each conversation with a donor's first turns for its own, and its root at depth 0.

    Conversation c takes the first h turns of c - c % FAMILY (all, if they are fewer), h = crc32(c) % SHARES,
    then its own after the first h. ``turns`` is a stored table.
    """
    shares = F.crc32(F.col("conv_id").cast("string")) % SHARES
    block = lambda at: F.floor((at - 1) / BLOCK)
    first = F.col("pos") < SHARES
    donors = turns.filter((F.col("conv_id") % FAMILY == 0) & first).groupBy(F.col("conv_id").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "digest", "n"))).alias("first_turns"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("length")).withColumns({"h": shares, "donor": F.col("conv_id") - F.col("conv_id") % FAMILY})
    taken = F.filter(F.col("first_turns"), lambda t: t["pos"] <= F.col("h"))
    heads = write_shared(convs.join(donors, "donor", "left").select("conv_id", "length", F.coalesce(taken, F.array().cast("array<struct<pos:bigint,role:string,digest:binary,n:bigint>>")).alias("head")), "heads")
    dealt = heads.select("conv_id", F.size("head").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("length")))).alias("block"))
    own = turns.withColumns({"h": shares, "block": block(F.col("pos"))}).filter("pos > h").join(dealt, ["conv_id", "block"]).select("conv_id", "block", (F.col("pos") - F.col("h") + F.col("m")).cast("long").alias("depth"), "role", "digest", "n")
    donated = heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.lit(0).cast("long").alias("block"), F.col("t.pos").cast("long").alias("depth"), "t.role", "t.digest", "t.n")
    roots = heads.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n"))
    return own.unionByName(donated).unionByName(roots)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n, bytes (of all texts so far) and the node's identity x, y of each depth of each rebuilt conversation."""
    low = F.lit((1 << 32) - 1)
    mixed = {f"h{k}": F.xxhash64(F.lit(k), "depth", "role", "digest") for k in (0, 1)}
    halves = {f"s{k}{part}": F.when(F.col("depth") == 0, 0).otherwise(value) for k in (0, 1) for part, value in (("l", F.col(f"h{k}").bitwiseAND(low)), ("u", F.shiftrightunsigned(f"h{k}", 32)))}
    sums = [*halves, "bytes"]
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    hashed = rebuilt(turns).withColumns(mixed).withColumns(halves | {"bytes": F.col("n")})
    local = write_shared(hashed.select("conv_id", "block", "depth", "n", *(F.sum(s).over(so_far).alias(s) for s in sums)), "blocks")
    # No term is negative, so a block's totals are its largest sums. Only conversations of several blocks are carried on.
    totals = local.groupBy("conv_id", "block").agg(*(F.max(s).alias(s) for s in sums))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = write_shared(totals.select("conv_id", "block", *(F.sum(s).over(earlier).alias(f"{s}_") for s in sums)).filter("block > 0 AND bytes_ IS NOT NULL"), "carried")
    whole = {s: F.col(s) + F.coalesce(f"{s}_", F.lit(0)) for s in sums}
    joined = local.join(_if_small(carried), ["conv_id", "block"], "left").select("conv_id", "depth", "n", *(v.alias(s) for s, v in whole.items()))
    identity = lambda k: F.shiftleft(F.col(f"s{k}u").bitwiseAND(low), 32).bitwiseOR(F.col(f"s{k}l").bitwiseAND(low))
    return joined.select("conv_id", "depth", "n", "bytes", identity(0).alias("x"), identity(1).alias("y"))


def owned(occurrences: DataFrame) -> DataFrame:
    """conv_id, depth, n, bytes and owner, the smallest member of the node.

    A window finds the smallest member of each part of a node, another that of the parts' smallest.
    """
    node, part = ["depth", "x", "y"], ["depth", "x", "y", "salt"]
    dealt = occurrences.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    marked = write_shared(dealt.withColumn("least", F.min("conv_id").over(Window.partitionBy(*part))), "marked")
    owners = marked.filter("conv_id = least").select(*part, F.min("conv_id").over(Window.partitionBy(*node)).alias("owner"))
    return marked.join(owners, part).select("conv_id", "depth", "n", "bytes", "owner")


def path_suffixes(marked: DataFrame) -> DataFrame:
    """Per conversation: length, last_owner (of its last node), and depth, owner and bytes of the deepest node that it does not own: meets, parent and shared."""
    foreign = F.max(F.when(F.col("owner") != F.col("conv_id"), F.struct("depth", "owner", "bytes")))
    rows = marked.groupBy("conv_id").agg(F.max(F.struct("depth", "owner")).alias("last"), foreign.alias("foreign"))
    return rows.select("conv_id", F.col("last.depth").alias("length"), F.col("last.owner").alias("last_owner"), F.col("foreign.depth").alias("meets"), F.col("foreign.owner").alias("parent"), F.col("foreign.bytes").alias("shared"))


def ends(suffixes: DataFrame) -> DataFrame:
    """owner, depth and sha: the digest of the ascending ids of the conversations that end at a node.

    Ids are sorted by range and joined in chunks; a task streams a node's chunks through the digest, one batch at a time.
    """
    placed = dealt_in_order(suffixes.select(F.col("last_owner").alias("owner"), F.col("length").alias("depth"), "conv_id"), *NODE, "conv_id")
    chunks = placed.groupBy(*NODE, "__part", F.floor(F.col("__row") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, depth) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _ends_batch(done)
        if node is not None:
            yield _ends_batch([(*node, digest.hexdigest())])

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "__part", "chunk").select(*NODE, "ids").mapInArrow(digested, "owner long, depth long, sha string")


def _ends_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "sha"])


def _part(df: DataFrame, **given: Column) -> DataFrame:
    """Rows of one kind for the group-by of nodes, the other kinds' columns filled."""
    blank = {"convs": F.lit(0), "saved": F.lit(0), "leaves": F.lit(0), "children": F.lit(0)}
    columns = [given.get(c, v).cast("long").alias(c) for c, v in blank.items()]
    return df.select(*NODE, *columns, given.get("parent", F.lit(None)).cast("long").alias("parent"), given.get("sha", F.lit(None)).cast("string").alias("sha"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = write_shared(ordered_turns(conversations), "ordered-turns")
    marked = write_shared(owned(paths(turns)), "owned")
    suffixes = write_shared(path_suffixes(marked), "suffixes")
    # A conversation that owns no node, a copy of the beginning of another, adds no child.
    meeting = suffixes.filter("meets < length").select(F.col("parent").alias("owner"), F.col("meets").alias("depth"))
    ended = ends(suffixes)

    branched = meeting.distinct().select(F.col("owner").alias("conv_id"), F.col("depth").alias("length"), F.lit(True).alias("branched"))
    leaf = (F.col("last_owner") == F.col("conv_id")) & F.col("branched").isNull()
    known = suffixes.join(branched, ["conv_id", "length"], "left").select("conv_id", "length", "meets", "parent", "shared", leaf.cast("long").alias("leaf"))
    block = lambda at: F.floor(at / BLOCK)
    known = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("length")))))
    members = marked.withColumn("block", block(F.col("depth"))).join(known, ["conv_id", "block"])

    own = F.col("owner") == F.col("conv_id")
    parent = F.when(own & (F.col("depth") > 0), F.when(F.col("depth") == F.col("meets") + 1, F.col("parent")).otherwise(F.col("conv_id")))
    occurrences = _part(
        members,
        convs=F.lit(1),
        saved=F.when(own, 0).otherwise(F.col("shared") - F.col("bytes") + F.col("n")),
        leaves=F.col("leaf"),
        children=(own & (F.col("length") > F.col("depth"))).cast("long"),
        parent=parent,
    )
    rows = occurrences.unionByName(_part(meeting, children=F.lit(1))).unionByName(_part(ended, sha=F.col("sha")))
    sums = rows.groupBy(*NODE).agg(*(F.sum(c).alias(c) for c in ("convs", "saved", "leaves", "children")), F.max("parent").alias("parent"), F.max("sha").alias("sha"))
    return sums.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
