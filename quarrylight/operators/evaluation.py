"""Golden items, scoring, aggregates, agreement, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.rates import MIN_ITEMS, rate
from quarrylight.functions.text import cover, cover_state, squash
from quarrylight.operators.containment import contained
from quarrylight.operators.numbering import numbered
from quarrylight.sources.shared import write_shared

#: Question strata; needle lengths; gate tolerance and judge limits; page text that makes a window.
STRATA = ("simple_factual", "multi_hop", "aggregative", "out_of_scope", "ambiguous", "exact_identifier", "table_or_image")
NEEDLE_CHARS, WINDOW_CHARS = (14, 160), 200
TOLERANCE, KAPPA, JUDGE_ITEMS = 0.03, 0.6, 30
#: Failure point of each cause.
FAILURE_POINTS = {"partial": "FP2", "starved": "FP2", "no_candidates": "FP2", "absent": "FP3", "present": "FP4", "miss_answered": "FP2"}


def windows(blocks: DataFrame, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """Page texts of at least 200 characters with hints; ``identifiers`` are the caller's marks of pages that hold codes. blocks: source_id, doc_type, page, ordinal, kind, text, asset_path."""
    filled = F.length(F.trim("text")) > 0
    ordered = F.sort_array(F.collect_list(F.when(filled, F.struct("ordinal", "text"))))
    text = F.trim(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n"))
    grouped = blocks.groupBy("source_id", "doc_type", "page").agg(text.alias("text"), F.bool_or(F.col("kind") == "table").alias("has_table"), F.min_by("asset_path", F.when(F.col("asset_path").isNotNull(), F.col("ordinal"))).alias("asset_path"))
    marks = F.lit(False)
    for mark in identifiers:
        marks = marks | F.contains("text", F.lit(mark))
    return grouped.filter(F.length("text") >= WINDOW_CHARS).withColumn("has_identifier", marks)


def occurrences(needles: DataFrame, pages: DataFrame) -> DataFrame:
    """item_id, needle, source_id and page of every window that contains a needle, both squashed.

    needles: item_id, needle; pages: source_id, page, text. Needles meet the windows that list their rarest grams.
    """
    asked = needles.select("item_id", F.col("needle").alias("__own"), squash(F.col("needle")).alias("needle"))
    held = pages.select("source_id", "page", squash(F.col("text")).alias("text"))
    return asked.join(contained(asked, held), "needle").select("item_id", F.col("__own").alias("needle"), "source_id", "page")


def verify_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """Per item: needles kept, too short or long, not in its own source, occurrences, unique, kept.

    items: item_id, source_id, needle (one row a needle); found: occurrences of the needles.
    """
    n = found.groupBy("item_id", "needle").agg(F.count("*").alias("n"), F.collect_set("source_id").alias("__sources"))
    rows = items.select("item_id", "source_id", "needle").join(n, ["item_id", "needle"], "left")
    located = F.coalesce(F.array_contains("__sources", F.col("source_id")), F.lit(False))
    rows = rows.select("item_id", "needle", F.length("needle").between(*NEEDLE_CHARS).alias("fits"), located.alias("located"), F.coalesce("n", F.lit(0)).alias("n"))
    good = F.col("fits") & F.col("located")
    return rows.groupBy("item_id").agg(
        F.sum(good.cast("long")).alias("n_good"),
        F.sum((~F.col("fits")).cast("long")).alias("n_length"),
        F.sum((F.col("fits") & ~F.col("located")).cast("long")).alias("n_unlocatable"),
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("n_occurrences"),
        F.coalesce(F.bool_and(F.when(good, F.col("n") == 1)), F.lit(True)).alias("is_unique"),
    ).withColumn("kept", F.col("n_good") > 0)


def answerable(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Per question: windows that hold all but one (two at least) of its four longest words of over five letters."""
    words = F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace("question", r"\s+", " "), " "), lambda w: F.length(w) > 5), lambda w: F.lower(F.regexp_replace(w, r"^[?,.]+|[?,.]+$", ""))))
    longest = F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w")))), lambda x: x["w"]), 1, 4)
    asked = questions.select("question_id", longest.alias("__words"))
    # A word of stops alone is empty once they are cut off, and stands in every window.
    needed = F.greatest(F.lit(2), F.size("__words") - 1) - F.array_contains("__words", "").cast("int")
    words = asked.select("question_id", needed.alias("needed"), F.explode("__words").alias("needle"))
    hits = words.join(contained(words, pages.select(F.lower("text").alias("text"))), "needle").groupBy("question_id", "text_id").agg(F.count("*").alias("n"), F.max("needed").alias("needed"))
    counts = hits.filter("n >= needed").groupBy("question_id").agg(F.count("*").alias("n_windows"))
    return asked.select("question_id").join(counts, "question_id", "left").select("question_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.col("n_windows").isNotNull().alias("rejected"))


def select_windows(pages: DataFrame, target: int) -> DataFrame:
    """A bounded, strided choice: all images, tables to a half, identifiers to a quarter, the rest evenly; ``target`` in all.

    Windows are numbered by ranges, so no bucket is sorted in one task.
    """
    bucket = F.when(F.col("doc_type") == "image", 0).when(F.col("has_table"), 1).when(F.col("has_identifier"), 2).otherwise(3)
    narrow = write_shared(pages.select("source_id", "page", bucket.alias("bucket")), "windows")
    rows = numbered(narrow, "bucket", "source_id", F.coalesce("page", F.lit(0)), within="bucket").withColumn("at", F.col("number") - 1)
    sizes = rows.groupBy().pivot("bucket", [0, 1, 2, 3]).count().na.fill(0)
    sizes = sizes.select(F.col("0").alias("n0"), F.least(F.col("1"), F.lit(target // 2)).alias("n1"), F.least(F.col("2"), F.lit(target // 4)).alias("n2"), F.col("3").alias("n3"))
    need = F.greatest(F.lit(target) - F.col("n0") - F.col("n1") - F.col("n2"), F.lit(0))
    sizes = sizes.select(need.alias("need"), F.greatest(F.floor(F.col("n3") / F.greatest(need, F.lit(1))), F.lit(1)).alias("step"))
    need, step = sizes.select("need").scalar(), sizes.select("step").scalar()
    taken = F.when(F.col("bucket") == 0, True).when(F.col("bucket") == 1, F.col("at") < target // 2).when(F.col("bucket") == 2, F.col("at") < target // 4).otherwise((F.col("at") % step == 0) & (F.floor(F.col("at") / step) < need))
    picked = rows.filter(taken)
    return picked.orderBy("bucket", "source_id", F.coalesce("page", F.lit(0))).limit(target).select("source_id", "page", "bucket")


def score_items(items: DataFrame, delivered: DataFrame) -> DataFrame:
    """Per item and unit: needles contained, strict, partial, source hit, rank of the first accepted source.

    items: item_id, needle, accept (sources); delivered: item_id, unit, rank, source_id, text. Every
    needle's best cover over the delivered texts counts; an item with nothing delivered fails. Where
    ``items`` name a unit, that holds for each item and unit.
    """
    asked, given = items.withColumn("__needle", squash(F.col("needle"))), delivered.withColumn("__text", squash(F.col("text"))).drop("text")
    met = asked.join(given, ["item_id", "unit"] if "unit" in items.columns else "item_id", "left")
    share = F.max(F.when(F.col("__text").isNotNull(), cover(F.col("__needle"), F.col("__text"))))
    per_needle = met.groupBy("item_id", "unit", "needle").agg(F.coalesce(share, F.lit(0.0)).alias("share"), F.min(F.when(F.array_contains("accept", F.col("source_id")), F.col("rank"))).alias("first_hit"))
    state = cover_state(F.col("share"))
    return per_needle.groupBy("item_id", "unit").agg(
        F.round(F.avg((state == "contained").cast("double")), 6).alias("needle_fraction"),
        F.bool_and(state == "contained").alias("strict"),
        F.bool_or(state != "absent").alias("partial"),
        F.min("first_hit").isNotNull().alias("source_hit"),
        F.min("first_hit").alias("rank_first_hit"),
    )


def aggregate_items(results: DataFrame, by: list[str]) -> DataFrame:
    """Headline and slices of scored items in one pass: rates per grouping set, mean tokens, empty deliveries.

    results: boolean strict, partial, source_hit, skipped, quarantined, tokens, no_delivery and the
    columns ``by``. Skipped and quarantined items count in no average. ``slice`` names the grouping.
    """
    kept = results.filter(~F.col("skipped") & ~F.col("quarantined"))
    n = F.count("*")
    measures = [rate(F.sum(F.col(c).cast("long")), n).alias(c) for c in ("strict", "partial", "source_hit")]
    agg = kept.groupingSets([[], *[[c] for c in by]], *by).agg(F.grouping_id().alias("__g"), n.alias("n_items"), *measures, F.round(F.avg("tokens"), 0).cast("long").alias("mean_tokens"), F.sum(F.col("no_delivery").cast("long")).alias("n_no_delivery"))
    name = F.lit("headline")
    for c in by:
        name = F.when(F.col("__g") == ((1 << len(by)) - 1) & ~(1 << (len(by) - 1 - by.index(c))), c).otherwise(name)
    value = F.coalesce(*[F.col(c).cast("string") for c in by], F.lit(""))
    return agg.select(name.alias("slice"), value.alias("value"), "n_items", "mean_tokens", "n_no_delivery", *[F.col(m)[f].alias(f"{m}_{f}") for m in ("strict", "partial", "source_hit") for f in ("hits", "rate", "low", "high", "label")])


def coverage(results: DataFrame, declared: tuple[str, ...] = STRATA) -> DataFrame:
    """Per declared stratum: items, whether present and whether thin (1 to 9 items)."""
    want = results.sparkSession.createDataFrame([(s,) for s in declared], "stratum string")
    n = results.groupBy("stratum").agg(F.count("*").alias("n"))
    return want.join(n, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"), (F.coalesce("n", F.lit(0)).between(1, MIN_ITEMS - 1)).alias("thin"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: one row with kappa, agreements, n, dominant share and its warnings; no row for no pair."""
    table = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("c"))
    sides = table.select(F.explode(F.array(F.struct(F.col("x").alias("label"), F.col("c").alias("l"), F.lit(0).cast("long").alias("r")), F.struct(F.col("y").alias("label"), F.lit(0).cast("long").alias("l"), F.col("c").alias("r")))).alias("s")).groupBy("s.label").agg(F.sum("s.l").alias("l"), F.sum("s.r").alias("r"))
    whole = table.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("c"))), F.lit(0)).alias("same")).filter("n > 0")
    margins = sides.agg(F.sum(F.col("l") * F.col("r")).alias("lr"), F.max("l").alias("top"))
    po, pe = F.col("same") / F.col("n"), F.col("lr") / (F.col("n") * F.col("n"))
    value = F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    top = F.col("top") / F.col("n")
    return whole.join(F.broadcast(margins), F.lit(True)).select(F.round(value, 3).alias("kappa"), F.round(po, 3).alias("raw_agreement"), F.round(pe, 3).alias("chance_agreement"), "n", F.round(top, 3).alias("dominant_class_share"), (top > 0.8).alias("prevalence_warning"), (F.col("n") >= JUDGE_ITEMS).alias("sufficient"))


def rated(labels: DataFrame, verdicts: DataFrame, key: str = "item_id") -> DataFrame:
    """key, label and verdict of items that a person labelled and the judge decided; failed verdicts pair with nothing.

    labels: key, label; verdicts: key, verdict, failed. The tables are kept apart until here, so labels are made blind.
    """
    decided = verdicts.filter(~F.coalesce(F.col("failed"), F.lit(True)) & F.col("verdict").isNotNull())
    return labels.select(key, "label").join(decided.select(key, "verdict"), key)


def unjudged(items: DataFrame, verdicts: DataFrame, key: str = "item_id") -> DataFrame:
    """The items that a resumed run still has to judge: those without a verdict that did not fail."""
    return items.join(verdicts.filter(~F.coalesce(F.col("failed"), F.lit(True))).select(key), key, "left_anti")


def judge_gate(agreement: DataFrame, judge: str, generator: str) -> DataFrame:
    """Whether judged metrics may be shown: kappa and items suffice and no model grades itself."""
    ok = (F.col("kappa") >= KAPPA) & (F.col("n") >= JUDGE_ITEMS)
    return agreement.select("kappa", "n", ok.alias("validated"), F.lit(judge == generator).alias("collision"), (ok & F.lit(judge != generator)).alias("may_emit"))


def judged_score(verdicts: DataFrame, by: str) -> DataFrame:
    """Per slice and in all: answered, abstained, starved and failed; faithful answers over answers only.

    verdicts: faithfulness, abstained, starved, failed and ``by``; failed ones count in no rate.
    """
    valid = ~F.col("failed")
    answered = valid & ~F.col("abstained")
    sets = verdicts.groupingSets([[], [by]], by).agg(
        F.count("*").alias("n"),
        F.sum((~valid).cast("long")).alias("n_failed"),
        rate(F.sum((answered & (F.col("faithfulness") == "supported")).cast("long")), F.sum(answered.cast("long"))).alias("f"),
        rate(F.sum((valid & F.col("abstained")).cast("long")), F.sum(valid.cast("long"))).alias("a"),
        F.sum((valid & F.col("starved")).cast("long")).alias("n_starved"),
    )
    return sets.select(F.coalesce(F.col(by).cast("string"), F.lit("all")).alias("slice"), "n", "n_failed", "n_starved", F.col("f.label").alias("faithful"), F.col("f.rate").alias("faithful_rate"), F.col("a.label").alias("abstained"), F.col("a.rate").alias("abstained_rate"))


def abstention_cause(ranked: Column, delivered: Column, contained: Column, partly: Column, needles: Column) -> Column:
    """Why an item was not answered, by its counts."""
    return F.when(ranked == 0, "no_candidates").when(delivered == 0, "starved").when(contained == needles, "present").when(contained + partly > 0, "partial").otherwise("absent")


def failure_histogram(lists: list[DataFrame]) -> DataFrame:
    """Failure points with counts and shares; an item in several lists counts in the first. Rows: question, cause.

    A cause without a failure point is an error.
    """
    union = None
    for order, rows in enumerate(lists):
        part = rows.select("question", "cause", F.lit(order).alias("order"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy("question").agg(F.min_by("cause", F.struct("order", "cause")).alias("cause"))
    point = F.create_map(*[F.lit(x) for kv in FAILURE_POINTS.items() for x in kv])[F.col("cause")]
    known = first.select(F.coalesce(point, F.raise_error(F.concat(F.lit("unknown cause "), F.col("cause")))).alias("point"))
    counts = known.groupBy("point").agg(F.count("*").alias("n"))
    return counts.select("point", "n", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 3).alias("share"))


def balanced_sample(items: DataFrame, cls: str, quota: int, seed: int, key: str = "item_id") -> DataFrame:
    """Up to ``quota`` items a class by the hash of id and seed: the same on every run and partitioning."""
    order = Window.partitionBy(cls).orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256), key)
    return items.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= quota)


def sample_limits(items: DataFrame) -> DataFrame:
    """One row: items, hard cases (repaired tables and captions) and whether they suffice. items: text_source."""
    hard = F.contains("text_source", F.lit("page_text_clip")) | F.contains("text_source", F.lit("caption"))
    n_hard = F.coalesce(F.sum(hard.cast("long")), F.lit(0))
    return items.agg(F.count("*").alias("n"), n_hard.alias("n_hard"), (n_hard >= MIN_ITEMS).alias("hard_sufficient"))


def regression_gate(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per metric: rates, drop and whether it holds. Both: metric, rate, n; a metric of too few items fails."""
    joined = current.join(baseline.select("metric", F.col("rate").alias("base"), F.col("n").alias("base_n")), "metric", "full_outer")
    drop = F.round(F.col("base") - F.col("rate"), 6)
    enough = (F.coalesce("n", F.lit(0)) >= MIN_ITEMS) & (F.coalesce("base_n", F.lit(0)) >= MIN_ITEMS)
    return joined.select("metric", "rate", "base", drop.alias("drop"), F.coalesce(enough & (drop <= tolerance), F.lit(False)).alias("holds"))


def smallest_budget(swept: DataFrame) -> DataFrame:
    """Per item the smallest budget that passes (null if none does). swept: item_id, budget, passes."""
    return swept.groupBy("item_id").agg(F.min(F.when(F.col("passes"), F.col("budget"))).alias("smallest_budget"), F.count("*").alias("n_budgets"))


def index_provenance(chunks: DataFrame) -> DataFrame:
    """One row: the chunks' pipeline fingerprint, or MIXED, and how many there are."""
    print_ = F.coalesce("pipeline_fingerprint", F.lit(""))
    sums = chunks.agg(F.count_distinct(print_).cast("int").alias("n_fingerprints"), F.min(print_).alias("p"))
    return sums.select("n_fingerprints", F.when(F.col("n_fingerprints") > 1, "MIXED").otherwise(F.coalesce("p", F.lit(""))).alias("fingerprint"))


def refuse_mixed(chunks: DataFrame) -> DataFrame:
    """``chunks``, or an error if they come from several pipelines or only some of them have context.

    Evaluation and baselines go through this: rates over a mixed index would describe neither half.
    """
    told = chunks.agg(F.count_distinct("pipeline_fingerprint").alias("n"), F.count_distinct(F.when((F.col("role") == "child") & (F.col("text_provenance") != "model_generated"), F.col("has_contextual_prefix"))).alias("c")).first()
    if told["n"] > 1 or told["c"] > 1:
        raise ValueError(f"the index is mixed: {told['n']} pipelines, {told['c']} states of context")
    return chunks


def baseline(current: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of ``current`` (metric, rate, n) stamped with the one fingerprint of an unmixed index."""
    print_ = index_provenance(refuse_mixed(chunks)).first()["fingerprint"]
    return current.select("metric", "rate", "n", F.lit(print_).alias("fingerprint"))


def ab_grid(arms: DataFrame, a: str, b: str, metric: str = "strict") -> DataFrame:
    """Hits and items by cost basis and budget, one pair of columns an arm; an error if both arms have one fingerprint.

    arms: arm, fingerprint, basis, budget and a boolean ``metric``.
    """
    told = arms.filter(F.col("arm").isin(a, b)).agg(F.count_distinct("fingerprint").alias("n"), F.count_distinct("arm").alias("arms")).first()
    if told["arms"] == 2 and told["n"] < 2:
        raise ValueError("both arms have the same fingerprint: there is nothing to compare")
    hits = F.sum(F.col(metric).cast("long"))
    return arms.groupBy("basis", "budget").pivot("arm", [a, b]).agg(hits.alias("hits"), F.count(F.lit(1)).alias("n")).na.fill(0)


def require_comparable(stamps: DataFrame) -> DataFrame:
    """One row that says whether artifacts may be pooled: one fingerprint, one budget, none missing."""
    return stamps.agg(
        F.count("*").alias("n"),
        (F.coalesce(F.bool_and(F.col("fingerprint").isNotNull() & F.col("budget").isNotNull()), F.lit(False)) & (F.count_distinct("fingerprint") == 1) & (F.count_distinct("budget") == 1)).alias("comparable"),
    )
