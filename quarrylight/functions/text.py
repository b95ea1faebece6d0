"""Text functions: token estimate, normalisers, tokenizer, needle cover, table cells."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it plus the four information separators.
BLANKS = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What makes a token, a part of one, and where case parts it.
TOKEN = r"[A-Za-z0-9]+(?:[._\-@/#][A-Za-z0-9]+)*"
SEPARATORS = r"[._\-@/#]+"
COMPOUND = r"[._\-@/#]|[a-z0-9][A-Z]"
#: A needle counts as partly found from this share of its prefix; quotes from this many characters.
PARTIAL, QUOTE_CHARS = 0.5, 12


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def count_tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, one at least; null for null."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def squash(text: Column) -> Column:
    """Lower-case ASCII letters and digits only: the normaliser of needles, quotes and cells."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " "))


def is_numeric(cell: Column) -> Column:
    """Whether a cell reads as a number once spaces, commas, percent signs and final dots are gone."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), f"[{BLANKS},%]", ""), r"\.+$", "")
    number = r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
    return F.lower(bare).rlike(rf"^({number}|[+-]?(inf|infinity|nan))$")


def clean_heading(heading: Column) -> Column:
    """A heading without emphasis marks and edge punctuation; empty with fewer than three letters or digits."""
    plain = F.regexp_replace(F.coalesce(heading, F.lit("")), r"\*\*|__|\*|_|`", "")
    bare = F.regexp_replace(collapse(plain), r"^[ :#|{}-]+|[ :#|{}-]+$", "")
    return F.when(F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")) < 3, "").otherwise(bare)


def tokenize(text: Column) -> Column:
    """Search tokens in order: each whole token in lower case, its separated parts, its camel-case pieces.

    Parts are added if there are several, pieces likewise; pieces are cut from the raw token.
    """

    def several(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.transform(parts, lambda p: F.lower(p))).otherwise(F.array().cast("array<string>"))

    def pieces(token: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(token, "(?<=[a-z0-9])(?=[A-Z])", "\n"), "\n"), lambda p: p != "")

    def expand(token: Column) -> Column:
        parts = F.filter(F.split(token, SEPARATORS), lambda p: p != "")
        return F.concat(F.array(F.lower(token)), several(parts), several(pieces(token)))

    return F.flatten(F.transform(words(text), lambda t: F.when(t.rlike(COMPOUND), expand(t)).otherwise(F.array(F.lower(t)))))


def words(text: Column) -> Column:
    """The whole tokens that ``tokenize`` starts from, in order and raw."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


#: ``words`` of one text, for callers that count them within a task.
whole_words = re.compile(TOKEN).findall
_compound = re.compile(COMPOUND).search


def word_tokens(word: str) -> list[str]:
    """What ``tokenize`` makes of one raw token, for callers that look at each distinct one once."""
    if not _compound(word):
        return [word.lower()]
    parts = [p for p in re.split(SEPARATORS, word) if p]
    pieces = [p for p in re.sub("(?<=[a-z0-9])(?=[A-Z])", "\n", word).split("\n") if p]
    return [p.lower() for p in (word, *(parts if len(parts) > 1 else ()), *(pieces if len(pieces) > 1 else ()))]


def found_prefix(needle: Column, text: Column) -> Column:
    """Length of the longest prefix of ``needle`` that ``text`` contains, by bisection (both squashed)."""

    def halve(s: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        hit = F.contains(text, F.substring(needle, F.lit(1), middle))
        return F.struct(F.when(hit, middle).otherwise(s["lo"]).alias("lo"), F.when(hit, s["hi"]).otherwise(middle - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.length(needle).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.length(needle) + 1)).cast("int"))
    return F.aggregate(steps, start, lambda s, _: F.when(s["lo"] < s["hi"], halve(s)).otherwise(s), lambda s: s["lo"])


def cover(needle: Column, text: Column) -> Column:
    """Share of a needle's prefix found in a text: 1.0 if it is contained, 0.0 for an empty needle; both squashed."""
    return F.when(F.length(needle) == 0, F.lit(0.0)).when(F.contains(text, needle), F.lit(1.0)).otherwise(found_prefix(needle, text) / F.length(needle))


def cover_state(share: Column) -> Column:
    """contained, partial or absent by the best share over all texts."""
    return F.when(share >= 1.0, "contained").when(share >= PARTIAL, "partial").otherwise("absent")


def fixed_slices(text: Column, size: int, overlap: int) -> Column:
    """Word windows of about ``size`` tokens, neighbours sharing about ``overlap``; tokens a word as in this text."""
    clean = collapse(text)
    words = F.filter(F.split(clean, " "), lambda w: w != "")

    def cut(w: Column) -> Column:
        ratio = F.greatest(count_tokens(text) / F.size(w), F.lit(1e-6))
        width = F.greatest(F.floor(size / ratio).cast("int"), F.lit(1))
        step = F.greatest(width - F.floor(overlap / ratio).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1, step), lambda i: F.array_join(F.slice(w, i + 1, width), " "))

    return let(words, lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(F.array().cast("array<string>")))


def first_filled_row(rows: Column) -> Column:
    """The first row of a table with a non-empty cell, cells collapsed; null if there is none."""
    clean = F.transform(rows, lambda r: F.transform(r, collapse))
    return F.get(F.filter(clean, lambda r: F.exists(r, lambda c: c != "")), 0)


def header_plausible(rows: Column) -> Column:
    """False if a table has no filled row, or if half or more of its first filled row's cells are numbers."""

    def labels(row: Column) -> Column:
        filled = F.filter(row, lambda c: c != "")
        return F.size(F.filter(filled, is_numeric)) < F.greatest(F.lit(1), F.floor(F.size(filled) / 2))

    return let(first_filled_row(rows), lambda row: F.coalesce(F.when(row.isNotNull(), labels(row)), F.lit(False)))


def corrupt_cells(rows: Column, page_text: Column) -> Column:
    """Numeric cells whose text the page does not show, with or without their spaces."""
    cells = F.transform(F.flatten(rows), collapse)
    return let(collapse(page_text), lambda page: F.filter(cells, lambda c: (c != "") & is_numeric(c) & ~F.contains(page, c) & ~F.contains(page, F.replace(c, F.lit(" "), F.lit("")))))


def markdown_table(rows: Column) -> Column:
    """Rows as a markdown table padded to the widest; empty for no rows."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def build(width: Column) -> Column:
        padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        rule = line(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.concat(F.array(line(F.get(padded, 0)), rule), F.transform(F.slice(padded, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")

    return F.when(F.size(rows) <= 0, "").otherwise(let(F.array_max(F.transform(rows, lambda r: F.size(r))), build))


def breadcrumb_prefix(title: Column, headings: Column) -> Column:
    """Title and headings joined by " > " and a blank line, each that another contains left out.

    A longer form takes the place of the first part that it contains.
    """

    def norm(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))

    def add(parts: Column, candidate: Column) -> Column:
        plain = norm(candidate)
        hit = F.array_position(F.transform(parts, lambda p: F.contains(norm(p), plain) | F.contains(plain, norm(p))), F.lit(True))
        shorter = F.contains(plain, norm(F.get(parts, hit.cast("int") - 1))) & ~F.contains(norm(F.get(parts, hit.cast("int") - 1)), plain)
        grown = F.when(hit == 0, F.concat(parts, F.array(candidate))).when(shorter, F.transform(parts, lambda p, k: F.when(k == hit - 1, candidate).otherwise(p))).otherwise(parts)
        return F.when(plain == "", parts).otherwise(grown)

    every = F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(headings, F.array().cast("array<string>")))
    stripped = F.transform(every, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{BLANKS}]+|[{BLANKS}]+$", ""))
    parts = F.aggregate(stripped, F.array().cast("array<string>"), add)
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " > "), F.lit("\n\n"))).otherwise("")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
