"""Index building: vectors, provenance, postings, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import tokenize
from quarrylight.operators import lexical
from quarrylight.sources.shared import write_shared

#: Fixed value: vectors shorter than this are empty and leave the index.
LEAST_NORM = 1e-6


def norm(vector: Column) -> Column:
    """Euclidean length, in double."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def truncate(vector: Column, dim: int) -> Column:
    """The first ``dim`` components at unit length; an error for a shorter vector."""
    cut = F.slice(F.transform(vector, lambda x: x.cast("double")), 1, dim)
    checked = F.when(F.size(vector) >= dim, cut).otherwise(F.raise_error(F.lit(f"a vector has fewer than {dim} components")).cast("array<double>"))
    return F.get(F.transform(F.array(checked), lambda v: F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))), 0)


def usable_vectors(vectors: DataFrame, vector: str = "vec") -> DataFrame:
    """Rows whose vector is not empty."""
    return vectors.filter(F.col(vector).isNotNull() & (norm(F.col(vector)) > LEAST_NORM))


def build_report(children: DataFrame, vectors: DataFrame, parents: DataFrame) -> DataFrame:
    """One row: children, zero vectors, orphans, provenance and contextual uniformity.

    children: chunk_id, parent_id, text_provenance, has_contextual_prefix, origin. A child whose
    parent_id is null is no orphan.
    """
    known = parents.select(F.col("parent_id").alias("__parent")).distinct()
    marked = children.join(known, children["parent_id"] == known["__parent"], "left").join(vectors.select("chunk_id", (norm(F.col("vec")) <= LEAST_NORM).alias("zero")), "chunk_id", "left")
    own = F.col("text_provenance") != "model_generated"
    return marked.agg(
        F.count("*").alias("n_children"),
        F.coalesce(F.sum(F.coalesce(F.col("zero"), F.lit(True)).cast("long")), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum((F.col("parent_id").isNotNull() & F.col("__parent").isNull()).cast("long")), F.lit(0)).alias("n_orphans"),
        F.count_distinct(F.when(own, F.col("text_provenance"))).alias("n_provenances"),
        (F.count_distinct(F.when(own, F.col("text_provenance"))) <= 1).alias("uniform_provenance"),
        (F.count_distinct(F.when(own & (F.col("origin") == "corpus"), F.col("has_contextual_prefix"))) <= 1).alias("uniform_contextualization"),
    )


def postings(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, term, tf and the text's token count dl; texts without tokens have no rows."""
    tokens = texts.select(key, tokenize(F.col(text)).alias("tokens")).select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(texts: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: n texts and their mean token count avgdl (0 for none); texts without tokens count.

    Token counts come from the postings of all terms. A reader of n alone does not compute them.
    """
    total = posted.agg(F.coalesce(F.sum(F.when(F.col("dl") > 0, F.col("tf"))), F.lit(0))).scalar()
    n = texts.agg(F.count("*").alias("n"))
    return n.select("n", F.when(F.col("n") > 0, total / F.col("n")).otherwise(0.0).alias("avgdl"))


def reached(texts: DataFrame, only: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings of the terms of ``only``, corpus statistics of all texts): texts are tokenized once for both.

    Other tokens leave before the shuffle. Each text sends one row of its length along under the empty
    term, which no token equals. The aggregate is stored, so that the texts are read and tokenized once for all its readers.
    """
    tokens = texts.select(key, tokenize(F.col(text)).alias("tokens")).select(key, F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    wanted = only.select("term").unionByName(only.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    whole = F.max(F.col("term") == "")
    rows = tokens.join(wanted, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.when(whole, F.sum("dl")).otherwise(F.max("dl")).alias("dl"), whole.alias("whole"))
    rows = write_shared(rows, "reached")
    stats = rows.filter("whole").agg(F.coalesce(F.sum(F.when(F.col("dl").isNotNull(), F.col("tf"))), F.lit(0)).alias("n"), F.sum("dl").alias("total"))
    return rows.filter("NOT whole").drop("whole"), stats.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("avgdl"))


def reached_texts(texts: DataFrame, only: DataFrame, key: str = "chunk_id", text: str = "text", carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """As ``reached``, with one stored row a text (key, ``carried``, dl, terms, tfs) instead of one a posting.

    Terms are counted within the row and no token is shuffled. Where keys repeat, the texts of one are one, as in ``postings``,
    with a row for each of their ``carried``; ``twin`` marks all of these but one.
    """
    rows = write_shared(lexical.counted_texts(texts, only, key, text, carried), "reached")
    if not rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        posted, stats = reached(texts, only, key, text)
        packed = lexical.packed(posted.withColumnRenamed(key, "chunk_id")).withColumnRenamed("chunk_id", key)
        twin = F.row_number().over(Window.partitionBy(key).orderBy(key, *carried)) > 1
        return packed.join(texts.select(key, *carried).distinct().withColumn("twin", twin), key), stats
    n = F.count("*")
    return rows.filter(F.size("terms") > 0), rows.agg(n.alias("n"), F.when(n > 0, F.sum("dl") / n).otherwise(0.0).alias("avgdl"))


def term_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df and idf (never negative), of postings or of rows that list each text's terms."""
    if "terms" in posted.columns:
        df = (posted.filter("NOT twin") if "twin" in posted.columns else posted).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    else:
        df = posted.groupBy("term").agg(F.count(F.when((F.col("dl") > 0) & (F.col("tf") > 0), 1)).alias("df"))
    n = stats.select("n").scalar()
    return df.select("term", "df", F.greatest(F.lit(0.0), F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


def vocabulary_report(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: vocabulary, mean length, terms seen in one text and their share."""
    counts = terms.agg(F.count("*").alias("vocab"), F.coalesce(F.sum((F.col("df") == 1).cast("long")), F.lit(0)).alias("singletons"))
    share = F.round(F.col("singletons") / F.greatest(F.col("vocab"), F.lit(1)), 3)
    return counts.join(F.broadcast(stats), F.lit(True)).select("n", "vocab", F.round("avgdl", 1).alias("avgdl"), "singletons", share.alias("singleton_share"))


def truncation_equivalence(pairs: DataFrame, dim: int, least: float = 0.999) -> DataFrame:
    """One row: pairs, least cosine of a cut long vector and the short one made directly, and whether it suffices.

    pairs: long, short. No pairs: not equivalent.
    """
    cosine = dot(truncate(F.col("long"), dim), truncate(F.col("short"), dim))
    told = pairs.agg(F.count("*").alias("n"), F.round(F.min(cosine), 9).alias("least_cosine"))
    return told.withColumn("equivalent", F.coalesce(F.col("least_cosine") > least, F.lit(False)))
