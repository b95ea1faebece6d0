"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights by dimension. Queries and candidates are dealt into blocks;
each pair of blocks is one task's group. There, the candidates' postings by dimension are
built once; every query row adds its weight times each posting into a dense score array,
and a partition selects the block's best k, ties to the smaller id. The blocks' winners, k
a query and block, are merged by rank. Scores are 64-bit integers, so sums are exact.

Vectors that are null or hold a null or non-finite component, and rows without an id, take no
part. Shorter vectors count as 0 in the dimensions they lack. A candidate with the query's id
is the query's own row. Repeated rows of one query id are answered once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Rows of a block, and the rows from which a small table is split further to use all cores.
QUERY_ROWS, CANDIDATE_ROWS, LEAST_ROWS = 16_384, 32_768, 2048
SCHEMA = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def weights(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(SCALE * x) of each component as integers, one row a vector, short ones padded by 0."""
    rows = [np.asarray(v, np.float64) for v in vectors.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = np.floor(SCALE * row)
    return out


def accumulate(query: np.ndarray, postings: list[tuple[np.ndarray | slice, np.ndarray]], n: int) -> np.ndarray:
    """Scores of ``n`` candidates: the query's non-zero terms scatter their weighted postings."""
    scores = np.zeros(n, np.int64)
    for term in np.flatnonzero(query[: len(postings)]):
        rows, weight = postings[term]
        scores[rows] += query[term] * weight
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _postings(matrix: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    out: list[tuple[np.ndarray | slice, np.ndarray]] = []
    for column in np.ascontiguousarray(matrix.T):
        rows = np.flatnonzero(column)
        out.append((slice(None), column) if len(rows) == len(column) else (rows, column[rows]))
    return out


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, *, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best candidates of each query, or all if fewer.

    Both tables have vec_id and embedding. An empty table on either side gives no rows.
    """
    spark = candidates.sparkSession

    def part(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    queries, candidates = part(queries).dropDuplicates(["vec_id"]), part(candidates)
    n_queries, n_candidates = queries.count(), candidates.count()
    across = max(1, -(-n_queries // query_rows))
    down = max(1, -(-n_candidates // candidate_rows), min(spark.sparkContext.defaultParallelism, n_candidates // LEAST_ROWS))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(own)
        return df.select("vec_id", "embedding", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).groupBy("q", "c")

    def best(asked: pa.Table, offered: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if asked.num_rows and offered.num_rows:
            ids, postings = np.asarray(offered["vec_id"]), _postings(weights(offered["embedding"]))
            for query, row in zip(asked["vec_id"].to_pylist(), weights(asked["embedding"])):
                scores = accumulate(row, postings, len(ids))
                others = np.flatnonzero(ids != query)
                at = others[select(scores[others], ids[others], k)]
                found[0] += [query] * len(at)
                found[1] += ids[at].tolist()
                found[2] += scores[at].tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), found)})

    blocks = dealt(queries, "q", across, "c", down).cogroup(dealt(candidates, "c", down, "q", across)).applyInArrow(best, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return blocks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
