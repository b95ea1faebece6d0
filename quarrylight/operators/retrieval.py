"""Ranking, fusion, budget fill and parent resolution, for many queries at once.

Hits have query_id, chunk_id, score and rank (from 0). Visibility is a filter below the
ranking: a caller sees chunks without owner and those of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import count_tokens, tokenize
from quarrylight.operators import lexical
from quarrylight.operators.matrix import best_of_blocks
from quarrylight.sources.shared import write_shared

#: BM25 saturation and length weight, fusion constant, pools and limits.
K1, B, RRF_K = 1.5, 0.75, 60
POOL, MAX_ITEMS, MAX_SOURCES, BUDGET, HEADLINE_BUDGET = 200, 200, 6, 12_000, 1500
SWEEP = (250, 500, 1000, 1500, 3000, 6000, 12_000)
DIGITS = 9


def visible(owner: Column, caller: Column) -> Column:
    """Whether a chunk of ``owner`` may be ranked for ``caller`` (null: public only)."""
    return (owner == "") | owner.eqNullSafe(caller)


def top_k(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each query by score, ties to the smaller key, with rank from 0."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def dense(queries: DataFrame, chunks: DataFrame, k: int = POOL) -> DataFrame:
    """Exact cosine top-k. queries: query_id, query_vec, caller; chunks: chunk_id, vec (unit), owner.

    Scores are rounded to 9 digits before ranking, so that the order of sums decides no tie. A zero query has no
    hits, a chunk without a vector of the queries' length is no hit; an empty side gives none.
    """
    return top_k(best_of_blocks(queries, chunks, k, DIGITS), k)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, caller, term and how often the query has it."""
    tokens = queries.select("query_id", "caller", F.explode(tokenize(F.col("query_text"))).alias("term"))
    return tokens.groupBy("query_id", "caller", "term").agg(F.count("*").alias("qtf"))


def sparse(queries: DataFrame, posted: DataFrame, terms: DataFrame, stats: DataFrame, owners: DataFrame | None = None, k: int = POOL, counted: bool = True) -> DataFrame:
    """BM25 top-k with the number of matched query tokens (0 if not ``counted``). queries: query_id, query_text, caller.

    posted, terms and stats are the index; ``posted`` has a row a posting, or one a text with lists of terms and tfs.
    ``owners`` (chunk_id, owner), or the owner that such a row carries, hides chunks before the
    ranking. Document frequencies count all owners' chunks. Texts that share no term have no hit.
    """
    rows = posted if "terms" in posted.columns else lexical.packed(posted)
    if owners is not None:
        rows = rows.drop("owner").join(owners.select("chunk_id", "owner"), "chunk_id")
    elif "owner" not in rows.columns:
        rows = rows.withColumn("owner", F.lit(""))
    asked = query_terms(queries).join(terms.select("term", "idf"), "term")
    return top_k(lexical.best_texts(asked, rows, stats.first()["avgdl"], k, DIGITS, K1, B, counted), k)


def rrf(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of named rankings: score, rank and each leg's rank from 1 (null where absent).

    A chunk counts once a leg, at its best rank. Order: score, best leg rank, id.
    """
    weights = weights or {}
    parts = [df.groupBy("query_id", "chunk_id").agg((F.min("rank") + 1).alias("leg_rank")).withColumn("leg", F.lit(name)).withColumn("weight", F.lit(float(weights.get(name, 1.0)))) for name, df in legs.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    own = [F.min(F.when(F.col("leg") == name, F.col("leg_rank"))).alias(f"{name}_rank") for name in legs]
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("leg_rank"))), 12).alias("score"), F.min("leg_rank").alias("best"), F.count("*").alias("n_legs"), *own)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best", "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("best")
    return (ranked.filter(F.col("rank") <= limit) if limit else ranked).withColumn("rank", F.col("rank") - 1)


def leg_contribution(fused: DataFrame, legs: list[str], top: int = 50) -> DataFrame:
    """Per query over the fused top: for each leg the hits it is in, those only it has and their share; hits of all legs."""
    head = fused.filter(F.col("rank") < top)
    total = F.count("*")
    out = [total.alias("n_fused")]
    for leg in legs:
        inside = F.col(f"{leg}_rank").isNotNull()
        alone = F.sum((inside & (F.col("n_legs") == 1)).cast("long"))
        out += [F.sum(inside.cast("long")).alias(f"{leg}_in_fused"), alone.alias(f"{leg}_only"), F.round(alone / F.greatest(total, F.lit(1)), 3).alias(f"{leg}_share_unique")]
    return head.groupBy("query_id").agg(*out, F.sum((F.col("n_legs") == len(legs)).cast("long")).alias("both_legs"))


def costed(hits: DataFrame, chunks: DataFrame, parents: DataFrame | None = None, *, unit: str = "child", basis: str = "delivered") -> DataFrame:
    """Hits with ``target`` (the unit delivered) and ``cost`` in tokens.

    chunks: chunk_id, parent_id, display_text, embed_text; parents: parent_id and parent_text, or its
    size as parent_tokens. A child costs its display text (delivered) or its embedding text (indexed). A parent is charged at its
    first child in rank order; a child without a known parent stands for it.
    """
    text = F.col("display_text" if basis == "delivered" else "embed_text")
    joined = hits.join(chunks.select("chunk_id", "parent_id", count_tokens(text).alias("__tokens")), "chunk_id")
    if unit == "child":
        return joined.select("query_id", "rank", "chunk_id", F.col("chunk_id").cast("string").alias("target"), F.col("__tokens").alias("cost"))
    size = F.col("parent_tokens") if "parent_tokens" in parents.columns else count_tokens(F.col("parent_text"))
    known = parents.select("parent_id", size.alias("__parent_tokens"))
    resolved = joined.join(known, "parent_id", "left").withColumn("target", F.when(F.col("__parent_tokens").isNull(), F.concat(F.lit("child:"), F.col("chunk_id").cast("string"))).otherwise(F.concat(F.lit("parent:"), F.col("parent_id").cast("string"))))
    first = F.row_number().over(Window.partitionBy("query_id", "target").orderBy("rank")) == 1
    return resolved.select("query_id", "rank", "chunk_id", "target", F.when(first, F.coalesce("__parent_tokens", "__tokens")).otherwise(0).alias("cost"))


def fill(ranked: DataFrame, budget: int, max_items: int = MAX_ITEMS) -> DataFrame:
    """Ranked units up to the first that would overflow the budget, with the running total ``spent``.

    Costs are not negative, so the running total only grows and a filter equals stopping.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.filter(F.col("rank") < max_items).withColumn("spent", F.sum("cost").over(order)).filter(F.col("spent") <= budget)


def sweep(ranked: DataFrame, budgets: tuple[int, ...] = SWEEP, max_items: int = MAX_ITEMS) -> DataFrame:
    """Per query and budget: units delivered and tokens; one ranking, one running total, many cut-offs."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.filter(F.col("rank") < max_items).withColumn("spent", F.sum("cost").over(order)).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    inside = F.col("spent") <= F.col("budget")
    return run.groupBy("query_id", "budget").agg(F.sum(inside.cast("long")).alias("n_delivered"), F.coalesce(F.max(F.when(inside, F.col("spent"))), F.lit(0)).alias("tokens"))


def resolve_parents(hits: DataFrame) -> DataFrame:
    """Distinct targets of filled hits, best rank first, numbered from 0."""
    best = hits.groupBy("query_id", "target").agg(F.min("rank").alias("child_rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("child_rank")) - 1)


def starvation(ranked: DataFrame, budget: int, max_items: int = MAX_ITEMS) -> DataFrame:
    """Per query: units ranked and delivered, cheapest ranked unit, and whether the budget starved it."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.filter(F.col("rank") < max_items).withColumn("spent", F.sum("cost").over(order))
    counts = run.groupBy("query_id").agg(F.count("*").alias("n_ranked"), F.sum((F.col("spent") <= budget).cast("long")).alias("n_delivered"), F.min(F.when(F.col("cost") > 0, F.col("cost"))).alias("min_unit_tokens"))
    return counts.withColumn("starved", (F.col("n_ranked") > 0) & (F.col("n_delivered") == 0))


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query of ``truth``: share of its chunks among the found ones."""
    both = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


def ndcg(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """NDCG at ``k`` with binary gains per query of ``relevant`` (query_id, chunk_id); our own standard definition."""
    gained = hits.filter(F.col("rank") < k).join(relevant.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 2)).alias("dcg"))
    ideal = relevant.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n")).withColumn("ideal", F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return ideal.join(gained, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def ranked_ids(mode: str, queries: DataFrame, chunks: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame] | None = None, pool: int = POOL) -> DataFrame:
    """The ranking of one mode: dense, sparse or rrf, each leg to ``pool``. ``index``: postings, terms, corpus stats.

    Postings that carry an owner, of these chunks, are not joined with the chunks to learn it.
    """
    if mode == "dense":
        return dense(queries, chunks, pool).select("query_id", "chunk_id", "score", "rank")
    posted, terms, stats = index
    found = sparse(queries, posted, terms, stats, None if "owner" in posted.columns else chunks.select("chunk_id", "owner"), pool, counted=False)
    if mode == "sparse":
        return found.select("query_id", "chunk_id", "score", "rank")
    if mode == "rrf":
        return rrf({"dense": dense(queries, chunks, pool), "sparse": found}).select("query_id", "chunk_id", "score", "rank")
    raise ValueError(f"unknown mode {mode!r}")


def ranked_modes(queries: DataFrame, chunks: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], pool: int = POOL) -> dict[str, DataFrame]:
    """The rankings of all modes; each leg runs once and is stored, for its own mode and for the fusion."""
    legs = {mode: write_shared(ranked_ids(mode, queries, chunks, index, pool), f"{mode}-leg") for mode in ("dense", "sparse")}
    return legs | {"rrf": rrf(legs).select("query_id", "chunk_id", "score", "rank")}
