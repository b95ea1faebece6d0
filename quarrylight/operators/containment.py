"""Which strings stand in which texts: each needle's rarest q-grams meet an inverted list of the texts' q-grams, then the text is looked at.

A needle of 2q - 1 characters or more holds, wherever it stands, one of the text's blocks of q characters cut from its
beginning. So texts list only their blocks, one q-th of their characters, and of each needle one gram is chosen for each of
the q ways in which it may lie over the blocks: the one that the fewest texts list. Shorter needles use all the texts'
grams of their own length (``SHORT`` at most) and choose one gram. Lists hold only grams that some needle has.
No text meets a needle without sharing such a gram, and nothing is left out: candidates are verified on the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.sources.shared import bounded, write_shared

#: Block lengths for long needles; grams of short ones.
BLOCKS, SHORT = (32, 16, 8), 6
#: Grams or needles that are broadcast at most, by count of rows (needles: by bytes too).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def _gram_length(needle: Column) -> Column:
    """q of a needle; negative where all grams are listed instead of blocks. Characters beyond 16 bits never use blocks."""
    length = F.length(needle)
    short = -F.least(length, F.lit(SHORT))
    blocks = reduce(lambda rest, q: F.when(length >= 2 * q - 1, q).otherwise(rest), sorted(BLOCKS), short)
    return F.when(needle.rlike("[\\x{10000}-\\x{10FFFF}]"), short).otherwise(blocks)


def _grams(text: Column, q: int, blocks: bool) -> Column:
    """All overlapping grams of a text, or its blocks, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{q}}}"), F.lit(0)) if blocks else F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def candidates(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle_id and text_id of pairs that share a chosen gram: all pairs that can match, and some others.

    needles: needle_id, needle (not empty); texts: text_id, text; both stored tables.
    """
    sized = needles.withColumn("q", _gram_length(F.col("needle")))
    found = None
    # At most len(BLOCKS) + SHORT values.
    for q in sorted(r["q"] for r in sized.select("q").distinct().collect()):
        blocks, size = q > 0, abs(q)
        own = sized.filter(F.col("q") == q).select("needle_id", F.posexplode(_grams(F.col("needle"), size, False)).alias("at", "gram"))
        own = own.select("needle_id", (F.col("at") % size if blocks else F.lit(0)).alias("residue"), "gram").distinct()
        wanted = write_shared(own.select("gram").distinct(), "wanted-grams")
        few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        listed = texts.select("text_id", F.explode(F.array_distinct(_grams(F.col("text"), size, blocks))).alias("gram"))
        lists = write_shared(listed.join(F.broadcast(wanted) if few else wanted, "gram", "left_semi"), "gram-lists")
        frequency = lists.groupBy("gram").agg(F.count("*").alias("n"))
        # A gram in no text shows that the needle does not lie that way in any.
        ranked = own.join(frequency, "gram", "left").select("needle_id", "residue", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
        chosen = ranked.groupBy("needle_id", "residue").agg(F.min("g").alias("g")).filter("g.n > 0").select("needle_id", F.col("g.gram").alias("gram"))
        pairs = chosen.distinct().join(lists, "gram").select("needle_id", "text_id")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return needles.select("needle_id").join(texts.select("text_id").limit(0))
    return found.distinct()


def contained(needles: DataFrame, rows: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """Each distinct string of ``needle`` beside each row whose ``text`` contains it: column ``needle`` and the columns of ``rows`` but ``text``, and ``text_id``, the row's number.

    Null and empty needles stand nowhere; a null text contains nothing. Repeated rows each match.
    """
    own = write_shared(needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct().withColumn("needle_id", F.monotonically_increasing_id()), "needles")
    held = write_shared(rows.filter(F.col(text).isNotNull()).withColumn("text_id", F.monotonically_increasing_id()), "texts")
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("bytes")).first()
    if size["n"] == 0:
        return held.drop(text).join(own.select("needle").limit(0)).select("needle", *(c for c in held.columns if c != text))
    few = size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    pairs = bounded(write_shared(candidates(own, held.select("text_id", F.col(text).alias("text"))), "needle-pairs"))
    asked = held.join(pairs, "text_id").join(F.broadcast(own) if few else own, "needle_id")
    return asked.filter(F.contains(F.col(text), F.col("needle"))).select("needle", *(c for c in held.columns if c != text))
