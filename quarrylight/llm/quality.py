"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger holds the measurements and one bit per
failed rule. A policy is a named, versioned mask: a document is kept if no bit of the mask is
set, so policies are compared, and rules ablated, by bit operations on counts of distinct
masks, without reading a text again.

Words are runs of anything but space and tab to carriage return. A null text has no words.
The checks are built-in column expressions only and stay in one row each: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \\t-\\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "A-Z"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """A rule's bit and the test over the measurements that a failing document meets."""

    bit: int
    name: str
    fails: str


#: Order and bits are part of the ledger's format: new rules take new bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "capitals", "100 * n_capitals > 50 * word_chars"),
    Rule(5, "short_words", "2 * word_chars < 4 * n_words"),
    Rule(6, "long_words", "word_chars > 20 * n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies: rules that reject.
POLICIES = {
    "base": BASE_RULES,
    "v1": tuple(rule.name for rule in RULES),
}


def mask_of(names: tuple[str, ...] | list[str]) -> int:
    """The bits of the named rules; an unknown name is an error."""
    bits = {rule.name: 1 << rule.bit for rule in RULES}
    return reduce(lambda mask, name: mask | bits[name], names, 0)


def _count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def _covered_by_repeats(words: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice.

    Windows are sorted by hash, then neighbours compared by their words; starts that match a
    neighbour are put in order, and each covers three words less what the next one covers.
    """
    windows = F.sort_array(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    )

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & reduce(lambda x, y: x & y, [F.get(words, a["i"] + k) == F.get(words, b["i"] + k) for k in range(3)])

    def starts(found: Column) -> Column:
        return F.sort_array(F.transform(F.filter(found, lambda w, k: F.coalesce(same(w, F.get(found, k + 1)), F.lit(False)) | F.coalesce(same(w, F.get(found, k - 1)), F.lit(False))), lambda w: w["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(_let(windows, starts), covered)).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def measure(docs: DataFrame, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and one long column per measurement.

    Null and empty texts measure 0 throughout. Columns of ``docs`` that are not in ``keep``
    are dropped, so names that clash with a measurement do no harm unless kept.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    n_lines = F.size(lines)
    measures = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(text) - _count_of(text, BLANKS),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _let(F.col("__words"), _covered_by_repeats),
        "n_lines": n_lines.cast("long"),
        "n_capitals": _count_of(text, CAPITALS),
    }
    staged = docs.select(*keep, F.col(text_column), words.alias("__words"))
    return staged.select(*keep, *[column.alias(name) for name, column in measures.items()])


def ledger(docs: DataFrame, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements plus ``failed``, the bits of all rules that a document fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in RULES])
    return measure(docs, text_column=text_column, keep=keep).withColumn("failed", bits)


def apply_policy(ledger_rows: DataFrame, policy: str = "v1", *, column: str = "kept") -> DataFrame:
    """The ledger with a boolean ``column``: true where no rule of the policy failed."""
    return ledger_rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay if it is left out.

    The ledger is first counted by distinct mask (at most 2 to the number of rules), combined
    map-side before the shuffle. An empty ledger gives no rows.
    """
    names = POLICIES[policy]
    mask = mask_of(names)
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask_of([n])).cast("long").alias("bit")) for n in names]))
    return (
        counts.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep_clean(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return apply_policy(ledger(packed, keep=("row",)), policy).filter("kept").select("row.*")
