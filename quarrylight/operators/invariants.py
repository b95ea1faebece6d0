"""Executed invariants as one table of checks: HOLDS, FAILS or NOT_MEASURED, each with its n."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.retrieval import MAX_ITEMS, ranked_modes
from quarrylight.sources.shared import write_shared


def check(measured: DataFrame, name: str, rule: str, holds: Column, n: Column, observed: Column, fingerprint: str = "") -> DataFrame:
    """One check from a one-row frame. A check that holds over nothing was not measured."""
    state = F.when(n.isNull() | (n == 0), "NOT_MEASURED").when(holds, "HOLDS").otherwise("FAILS")
    return measured.select(F.lit(name).alias("name"), F.lit(rule).alias("rule"), observed.cast("string").alias("observed"), state.alias("state"), n.cast("long").alias("n"), F.lit(fingerprint).alias("fingerprint"))


def index_checks(children: DataFrame, vectors: DataFrame, parents: DataFrame) -> DataFrame:
    """Parity of chunks and vectors, orphans, uniform provenance, ownership. children: as index.build_report plus owner."""
    from quarrylight.operators.index import build_report

    missing = children.join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("bad"))
    extra = vectors.join(children.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("more"))
    n = children.agg(F.count("*").alias("n"))
    parity = n.join(F.broadcast(missing), F.lit(True)).join(F.broadcast(extra), F.lit(True))
    report = build_report(children, vectors, parents)
    fault = ((F.col("origin") == "upload") & (F.col("owner") == "")) | ((F.col("origin") == "corpus") & (F.col("owner") != ""))
    owned = children.agg(F.count("*").alias("n"), F.coalesce(F.sum(fault.cast("long")), F.lit(0)).alias("bad"))
    parts = [
        check(parity, "index_parity", "every child has a vector and every vector a child", (F.col("bad") == 0) & (F.col("more") == 0), F.col("n"), F.col("bad") + F.col("more")),
        check(report, "no_orphans", "every child's parent is known", F.col("n_orphans") == 0, F.col("n_children"), F.col("n_orphans")),
        check(report, "uniform_provenance", "children of one index are prefixed alike", F.col("uniform_provenance"), F.col("n_children"), F.col("n_provenances")),
        check(owned, "ownership", "uploads have an owner, the corpus has none", F.col("bad") == 0, F.col("n"), F.col("bad")),
    ]
    return reduce(DataFrame.unionByName, parts)


def budget_check(filled: DataFrame, budget: int) -> DataFrame:
    """No query is delivered more than its budget. filled: query_id, spent."""
    most = filled.agg(F.count_distinct("query_id").alias("n"), F.coalesce(F.max("spent"), F.lit(0)).alias("most"))
    return check(most, "budget_respected", f"at most {budget} tokens", F.col("most") <= budget, F.col("n"), F.col("most"))


def scoring_check(results: DataFrame) -> DataFrame:
    """Partial hits are no fewer than strict ones. results: strict, partial."""
    sums = results.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("strict").cast("long")), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("partial").cast("long")), F.lit(0)).alias("p"))
    return check(sums, "partial_covers_strict", "partial >= strict", F.col("p") >= F.col("s"), F.col("n"), F.col("p") - F.col("s"))


def isolation_checks(chunks: DataFrame, vectors: DataFrame, index, owner_a: str, owner_b: str) -> DataFrame:
    """Over all modes: A and the public never see B's chunks although they ask with B's own text and vector; B does (control).

    chunks: chunk_id, owner, text; vectors: chunk_id, vec, of some of the chunks; index: postings, terms, corpus stats.
    B asks with those of its chunks that have a vector.
    """
    ranked = chunks.join(vectors, "chunk_id", "left")
    target = ranked.filter((F.col("owner") == owner_b) & F.col("vec").isNotNull())
    callers = (("cross_session", owner_a, False), ("public", None, False), ("own", owner_b, True))
    asked = reduce(DataFrame.unionByName, [target.select(F.concat(F.lit(f"{who}:"), F.col("chunk_id").cast("string")).alias("query_id"), F.col("vec").alias("query_vec"), F.col("text").alias("query_text"), F.lit(caller).cast("string").alias("caller")) for who, caller, _ in callers])
    modes = ranked_modes(asked, ranked.select("chunk_id", "vec", "owner"), index, MAX_ITEMS)
    hits = reduce(DataFrame.unionByName, [found.select(F.substring_index("query_id", ":", 1).alias("who"), F.lit(mode).alias("mode"), "chunk_id") for mode, found in modes.items()])
    mine = F.coalesce(F.sum((F.col("owner") == owner_b).cast("long")), F.lit(0))
    counts = write_shared(hits.join(chunks.select("chunk_id", "owner"), "chunk_id").groupBy("who", "mode").agg(F.count("*").alias("n"), mine.alias("seen")), "seen")
    parts = []
    for who, _, control in callers:
        for mode in modes:
            seen = counts.filter((F.col("who") == who) & (F.col("mode") == mode)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "seen")))
            holds = F.col("seen") > 0 if control else F.col("seen") == 0
            parts.append(check(seen, f"isolation_{who}_{mode}", "own chunks are found" if control else "no chunk of another owner", holds, F.col("n"), F.col("seen")))
    return reduce(DataFrame.unionByName, parts)


def prefix_checks(chunks: DataFrame) -> DataFrame:
    """No parent begins with its breadcrumb and no parent has children of which only some are prefixed."""
    from quarrylight.operators.chunking import prefix_leaks

    n = chunks.agg(F.count("*").alias("n"))
    leaks = prefix_leaks(chunks).agg(F.coalesce(F.sum((F.col("fault") == "breadcrumb in body").cast("long")), F.lit(0)).alias("body"), F.coalesce(F.sum((F.col("fault") != "breadcrumb in body").cast("long")), F.lit(0)).alias("uneven"))
    both = n.join(F.broadcast(leaks), F.lit(True))
    return check(both, "prefix_containment", "breadcrumbs stay out of parents", F.col("body") == 0, F.col("n"), F.col("body")).unionByName(check(both, "prefix_uniform", "siblings are prefixed alike", F.col("uneven") == 0, F.col("n"), F.col("uneven")))


def round_trip_check(left: DataFrame, right: DataFrame, keys: list[str], name: str, rule: str) -> DataFrame:
    """Every key of one table is in the other and the other way round: manifest and chunks, assets and blocks, uploads and index.

    Null keys are equal to nothing and count as faults.
    """
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    lost, extra = a.join(b, keys, "left_anti").agg(F.count("*").alias("lost")), b.join(a, keys, "left_anti").agg(F.count("*").alias("extra"))
    told = a.agg(F.count("*").alias("n")).join(F.broadcast(lost), F.lit(True)).join(F.broadcast(extra), F.lit(True))
    return check(told, name, rule, F.col("lost") + F.col("extra") == 0, F.col("n") + F.col("extra"), F.col("lost") + F.col("extra"))


def artifact_checks(names: DataFrame, required: list[str]) -> DataFrame:
    """One check an artifact: it exists and has rows. names: name, n."""
    want = names.sparkSession.createDataFrame([(r,) for r in required], "name string")
    joined = want.join(names, "name", "left")
    state = F.when(F.col("n").isNull(), "NOT_MEASURED").when(F.col("n") > 0, "HOLDS").otherwise("FAILS")
    return joined.select(F.concat(F.lit("artifact_"), F.col("name")).alias("name"), F.lit("the artifact has rows").alias("rule"), F.coalesce(F.col("n").cast("string"), F.lit("absent")).alias("observed"), state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit("").alias("fingerprint"))


def deferrals(metrics: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Per deferred decision: whether its expiry condition, an SQL predicate over the one row of ``metrics``, is met."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("decision"), F.lit(v).alias("condition"), F.coalesce(F.expr(v).cast("boolean"), F.lit(False)).alias("expired")) for k, v in predicates.items()]))
    return metrics.select(each.alias("d")).select("d.*")
