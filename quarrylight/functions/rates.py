"""Rates that carry their sample size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items from which a rate is stated, and the normal quantile of its interval.
MIN_ITEMS, Z = 10, 1.96


def rate(hits: Column, n: Column) -> Column:
    """n, hits, rate, sufficient, low, high, label; rate and Wilson interval only from MIN_ITEMS on."""
    n, hits = n.cast("long"), hits.cast("long")
    enough = n >= MIN_ITEMS
    p = hits / n
    base = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / base
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / base
    text = F.when(n == 0, "no items").when(~enough, F.concat(hits.cast("string"), F.lit(" of "), n.cast("string"))).otherwise(F.concat(hits.cast("string"), F.lit("/"), n.cast("string"), F.lit(" = "), F.round(100 * p, 0).cast("long").cast("string"), F.lit("%")))
    return F.struct(
        n.alias("n"),
        hits.alias("hits"),
        F.when(enough, F.round(p, 3)).alias("rate"),
        enough.alias("sufficient"),
        F.when(enough, F.round(F.greatest(F.lit(0.0), centre - half), 3)).alias("low"),
        F.when(enough, F.round(F.least(F.lit(1.0), centre + half), 3)).alias("high"),
        text.alias("label"),
    )


def scope_label(label: Column, present: Column, declared: Column, thin: Column) -> Column:
    """A rate's label with how many strata it rests on and which of them are thin."""
    some = F.when(present < declared, F.concat(F.lit(" on "), present.cast("string"), F.lit(" of "), declared.cast("string"), F.lit(" strata"))).otherwise("")
    return F.concat(label, some, F.when(F.size(thin) > 0, F.concat(F.lit(" ("), F.array_join(thin, ", "), F.lit(" thin)"))).otherwise(""))
