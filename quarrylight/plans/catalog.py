"""The query catalogue: each operator over the driver's tables, with DuckDB SQL that restates it.

Stand-ins: a document is a child chunk, the documents of a source with ids of one hundred its parent, Spanish documents have an owner;
an embedding is the vector of the document with its id; benchmark texts are questions and needles;
labels are two raters; conversation turns and events stand for turns, requests and spend.
Dense queries are the vectors whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import ids, rates, text
from quarrylight.operators import answers, chunking, evaluation, geometry, index, invariants, lifecycle, retrieval, segments, tables
from quarrylight.plans import ask, evaluate, ingest, library
from quarrylight.sources import artifacts, uploads
from quarrylight.sources.shared import bounded, shared_dir, write_shared
from quarrylight.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins -------------------------------------------------------------------------------


def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    owner = F.when(F.col("lang") == "es", "es").otherwise("")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("parent_id"), F.col("source").alias("source_id"), owner.alias("owner"), F.col("text").alias("display_text"), F.concat("source", F.lit("\n\n"), "text").alias("embed_text"), "lang", "text")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return child_chunks(spark, sf_dir).join(vectors, "chunk_id")


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its vector where it has one: the lexical leg ranks all, the dense leg those with a vector."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return child_chunks(spark, sf_dir).join(vectors, "chunk_id", "left")


def vector_queries(chunks: DataFrame) -> DataFrame:
    caller = F.when(F.col("lang") == "es", "es")
    return chunks.filter((F.col("chunk_id") % 50 == 0) & F.col("vec").isNotNull()).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("text").alias("query_text"), caller.alias("caller"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.lit(None).cast("string").alias("caller"))


def text_index(chunks: DataFrame, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole index, or the part of it that ``queries`` reach, a row a text with its owner."""
    if queries is None:
        posted = index.postings(chunks)
        stats = index.corpus_stats(chunks, posted)
    else:
        posted, stats = index.reached_texts(chunks, retrieval.query_terms(queries), carried=("owner",))
    return posted, index.term_stats(posted, stats), stats


def parent_costs(chunks: DataFrame) -> DataFrame:
    """parent_id and the tokens of its text: all its children in order, a blank line between them. The text itself is not built."""
    joined = F.coalesce(F.sum(F.length("display_text")) + 2 * (F.count("display_text") - 1), F.lit(0))
    return chunks.groupBy("parent_id").agg(F.greatest(F.lit(1), F.floor(joined / 4)).cast("long").alias("parent_tokens"))


def section_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Children and parents that chunking makes of each document, whole texts, under its source and owner."""
    es = F.col("lang") == "es"
    docs = read(spark, sf_dir, "documents").select(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "source").alias("source_id"), F.col("source").alias("title"), "text", F.when(es, "es").otherwise("").alias("owner"), F.when(es, "upload").otherwise("corpus").alias("origin"))
    rows = chunking.chunk_documents(docs).withColumn("source_id", F.get(F.split("source_id", "\x1f", 2), F.lit(1)))
    children = rows.filter("role = 'child'").select("chunk_id", "parent_id", "source_id", "owner", "display_text", "embed_text", F.col("display_text").alias("text"))
    return children, rows.filter("role = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("display_text").alias("parent_text"))


def sparse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ranking of the benchmark's questions; few hits are broadcast, so that documents which meet them are not shuffled."""
    chunks, queries = child_chunks(spark, sf_dir), text_queries(spark, sf_dir)
    return bounded(write_shared(retrieval.sparse(queries, *text_index(chunks, queries), counted=False), "hits"))


TOKENS = r"""list_reduce(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+(?:[._\-@/#][A-Za-z0-9]+)*'), lambda t:
    [lower(t)]
    || (CASE WHEN len(list_filter(regexp_split_to_array(t, '[._\-@/#]+'), lambda p: p <> '')) > 1 THEN list_transform(list_filter(regexp_split_to_array(t, '[._\-@/#]+'), lambda p: p <> ''), lambda p: lower(p)) ELSE [] END)
    || (CASE WHEN len(string_split(regexp_replace(t, '([a-z0-9])([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10))) > 1 THEN list_transform(string_split(regexp_replace(t, '([a-z0-9])([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda p: lower(p)) ELSE [] END)
    ), lambda a, b: a || b, []::VARCHAR[])"""
SQUASH = "regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"
CHUNKS_SQL = "chunks AS (SELECT doc_id AS chunk_id, concat_ws('/', source, doc_id // 100) AS parent_id, source AS source_id, CASE WHEN lang = 'es' THEN 'es' ELSE '' END AS owner, text, lang FROM documents)"
VECTORS_SQL = f"""{CHUNKS_SQL},
vchunks AS (SELECT c.*, list_transform(e.embedding, lambda x: x::DOUBLE) AS vec FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id),
vq AS (SELECT chunk_id AS query_id, vec AS qvec, text AS query_text, CASE WHEN lang = 'es' THEN 'es' END AS caller FROM vchunks WHERE chunk_id % 50 = 0)"""
DENSE_SQL = """dense_all AS (
  SELECT q.query_id, c.chunk_id, round(list_dot_product(q.qvec, c.vec) / sqrt(list_dot_product(q.qvec, q.qvec)), 9) AS score
  FROM vq q JOIN vchunks c ON c.owner = '' OR c.owner IS NOT DISTINCT FROM q.caller),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM dense_all) WHERE rank < 200)"""
INDEX_SQL = """tok AS (SELECT chunk_id, {tokens} AS ts FROM {base}),
stats AS (SELECT count(*) AS n, coalesce(avg(len(ts)), 0) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, greatest(0, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM post, stats GROUP BY term)"""
SPARSE_SQL = """qt AS (SELECT query_id, caller, term, count(*) AS qtf FROM (SELECT query_id, caller, unnest({tokens}) AS term FROM {queries}) GROUP BY ALL),
sparse_all AS (
  SELECT qt.query_id, p.chunk_id, round(sum(qtf * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl)))), 9) AS score, sum(qtf)::BIGINT AS matched
  FROM qt JOIN terms USING (term) JOIN post p USING (term) JOIN chunks c ON c.chunk_id = p.chunk_id, stats
  WHERE c.owner = '' OR c.owner IS NOT DISTINCT FROM qt.caller GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sparse_all WHERE score > 0) WHERE rank < 200)"""


def index_sql(base: str = "chunks") -> str:
    return INDEX_SQL.format(tokens=TOKENS.format(c="text"), base=base)


def sparse_sql(queries: str) -> str:
    return SPARSE_SQL.format(tokens=TOKENS.format(c="query_text"), queries=queries)


TQ_SQL = "tq AS (SELECT item_id AS query_id, text AS query_text, NULL::VARCHAR AS caller FROM benchmark)"

# ---- scalar functions --------------------------------------------------------------------------


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def c1_count_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, sha256({SQUASH.format(c='text')}) AS squashed FROM documents")
def d1_squash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.squash(F.col("text")), 256).alias("squashed"))


BLANK_SQL = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, '{BLANK_SQL}+', ' ', 'g'))) AS cell FROM documents")
def d2_normalize_cell(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("cell"))


@query(r"""
WITH w AS (SELECT doc_id, lower(rtrim(regexp_replace(c, '[,%]', '', 'g'), '.')) AS c FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS c FROM documents))
SELECT doc_id, count(*)::BIGINT AS n_cells, count(*) FILTER (regexp_full_match(c, '([+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)|([+-]?(inf|infinity|nan))'))::BIGINT AS n_numeric FROM w GROUP BY doc_id
""")
def d4_numeric_cells(spark, sf_dir):
    cells = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(cells).cast("long").alias("n_cells"), F.size(F.filter(cells, text.is_numeric)).cast("long").alias("n_numeric"))


@query(rf"""
WITH h AS (SELECT doc_id, trim(trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '\*\*|__|\*|_|`', '', 'g'), '{BLANK_SQL}+', ' ', 'g')), ' :#-|{{}}') AS h FROM documents)
SELECT doc_id, CASE WHEN length(regexp_replace(h, '[^\p{{L}}\p{{N}}]', '', 'g')) < 3 THEN '' ELSE h END AS heading FROM h
""")
def s7_clean_heading(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_heading(F.get(F.split("text", "\n"), F.lit(0))).alias("heading"))


@query(f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, sha256(array_to_string(ts, ' ')) AS tokens FROM (SELECT doc_id, {TOKENS.format(c='text')} AS ts FROM documents)")
def r6_tokenize(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("ts"))
    return tokens.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.sha2(F.array_join("ts", " "), 256).alias("tokens"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents),
r AS (SELECT *, greatest(greatest(1, length(text) // 4)::DOUBLE / len(ws), 1e-6) AS ratio FROM w WHERE len(ws) > 0),
p AS (SELECT *, greatest(floor(300 / ratio)::INT, 1) AS win, greatest(greatest(floor(300 / ratio)::INT, 1) - floor(36 / ratio)::INT, 1) AS step FROM r),
s AS (SELECT doc_id, list_transform(range(0, len(ws), step), lambda i: array_to_string(ws[i + 1 : i + win], ' ')) AS cut FROM p)
SELECT w.doc_id, coalesce(len(cut), 0)::BIGINT AS n_slices, sha256(coalesce(array_to_string(cut, chr(1)), '')) AS slices FROM w LEFT JOIN s ON w.doc_id = s.doc_id
""")
def c3_fixed_slices(spark, sf_dir):
    cut = read(spark, sf_dir, "documents").select("doc_id", text.fixed_slices(F.col("text"), 300, 36).alias("cut"))
    return cut.select("doc_id", F.size("cut").cast("long").alias("n_slices"), F.sha2(F.array_join("cut", "\x01"), 256).alias("slices"))


@query("SELECT doc_id, substr(sha256('child|' || source || '|' || doc_id || '|' || sha256(text)), 1, 24) AS chunk_id FROM documents")
def f15_chunk_id(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ids.chunk_id(F.lit("child"), F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || text || chr(0)) AS cache_key FROM documents")
def c13_cache_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ids.cache_key(F.col("source"), F.col("lang"), F.col("text")).alias("cache_key"))


@query("""SELECT source, lang, substr(sha256('{"chunker":"' || lang || '","embed_dim":64,"embed_model":"stub","parser":"' || source || '"}'), 1, 16) AS fingerprint FROM (SELECT DISTINCT source, lang FROM documents)""")
def f14_fingerprint(spark, sf_dir):
    pairs = read(spark, sf_dir, "documents").select("source", "lang").distinct()
    return pairs.select("source", "lang", ids.fingerprint({"parser": F.col("source"), "chunker": F.col("lang"), "embed_model": F.lit("stub"), "embed_dim": F.lit(64)}).alias("fingerprint"))


@query("SELECT page_id, lower(regexp_extract(url, '([^/]*)/*$', 1)) AS source_id, CASE WHEN page_id % 3 = 0 THEN 'p. ' || page_id ELSE 'pp. ' || page_id || '-' || (page_id + 1) END AS page_label FROM pages")
def f12_source_ids(spark, sf_dir):
    last = F.when(F.col("page_id") % 3 == 0, F.col("page_id")).otherwise(F.col("page_id") + 1)
    return read(spark, sf_dir, "pages").select("page_id", ids.normalize_id(F.col("url"), "/corpus/raw").alias("source_id"), ids.page_label(F.col("page_id"), last).alias("page_label"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN source || '  p' || doc_id || '-' || (doc_id + 2) WHEN lang = 'de' THEN source || '  Two > Three' ELSE source || '  image: ' || lang END AS locator,
CASE WHEN lang = 'es' THEN 'assistant_reading' WHEN lang = 'fr' THEN 'structure_inferred' WHEN lang = 'de' THEN 'quoted' ELSE 'found_not_quoted' END AS evidence_kind FROM documents""")
def f4_f5_locator_and_evidence(spark, sf_dir):
    lang = F.col("lang")
    page = F.when(lang == "fr", F.col("doc_id") + 0)
    headings = F.when(lang == "de", F.array(*map(F.lit, ("One", "Two", "Three")))).otherwise(F.array().cast("array<string>"))
    asset = F.when(~lang.isin("fr", "de"), lang)
    kind = ids.evidence_kind(F.when(lang == "es", "model_generated").otherwise("verbatim"), F.when(lang == "fr", "page_text_clip"), F.when(lang == "de", "verified"))
    docs = read(spark, sf_dir, "documents").withColumn("page", page)
    place = F.when((lang == "fr") & (F.col("doc_id") == 0), F.concat("source", F.lit("  p0-2"))).otherwise(ids.locator(F.col("source"), F.col("page"), F.col("page") + 2, headings, asset))
    return docs.select("doc_id", place.alias("locator"), kind.alias("evidence_kind"))


@query("SELECT event_id, CASE WHEN regexp_full_match(s, '[A-Za-z0-9_-]{22}') AND s <> 'PUBLICPUBLICPUBLICPUBL' THEN s END AS session FROM (SELECT event_id, substr(md5(user_id::VARCHAR), 1, 20 + event_id % 4) AS s FROM events)")
def f10_session_ids(spark, sf_dir):
    raw = F.substring(F.md5(F.col("user_id").cast("string")), F.lit(1), (20 + F.col("event_id") % 4).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", ids.session_ok(raw, "PUBLICPUBLICPUBLICPUBL").alias("session"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'doc' || user_id END AS slug, CASE WHEN event_id % 2 = 0 THEN event_id::INT END AS page FROM events""")
def f8_asset_origin(spark, sf_dir):
    name = F.concat(F.lit("Doc"), F.col("user_id").cast("string"), F.lit("_p"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".png").otherwise(".csv"))
    return read(spark, sf_dir, "events").withColumn("origin", ids.asset_slug(name)).select("event_id", F.col("origin.slug").alias("slug"), F.col("origin.page").alias("page"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Guide Part ' || page_id || ' > Use' || chr(10) || chr(10) WHEN page_id % 4 = 1 THEN 'The Guide Part' || chr(10) || chr(10) WHEN page_id % 4 = 2 THEN 'Guide Part' || chr(10) || chr(10) ELSE '' END AS prefix FROM pages""")
def c5_breadcrumbs(spark, sf_dir):
    part, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    title = F.when(part == 3, " -- ").otherwise("Guide Part")
    headings = F.when(part == 0, F.array(F.concat(F.lit("Guide Part "), n), F.lit("Use"))).when(part == 1, F.array(F.lit("guide  part!"), F.lit("The Guide Part"))).when(part == 2, F.array(F.lit("part"), F.lit(""))).otherwise(F.array(F.lit("")))
    return read(spark, sf_dir, "pages").select("page_id", text.breadcrumb_prefix(title, headings).alias("prefix"))


@query("""SELECT n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' |  |' AS md FROM nation""")
def s8_markdown_table(spark, sf_dir):
    rows = F.array(F.array("n_name", F.col("n_regionkey").cast("string")), F.array(F.col("n_nationkey").cast("string")))
    return read(spark, sf_dir, "nation").select("n_nationkey", text.markdown_table(rows).alias("md"))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, k <> 1 AS header_ok, CASE WHEN k = 2 THEN 1 ELSE 0 END AS n_corrupt FROM t""")
def d5_d6_table_detectors(spark, sf_dir):
    k, price = F.col("o_orderkey") % 3, F.format_string("%.2f", F.col("o_totalprice"))
    blank = F.array(F.lit(" "), F.lit("\n"))
    rows = F.when(k == 1, F.array(blank, F.array(price, F.lit("12%")))).otherwise(F.array(blank, F.array(F.lit("Price"), F.lit("Rate")), F.array(price, F.lit("12 %"))))
    page = F.when(k == 2, F.concat(F.lit("Price and Rate 12% "), F.lit("of nothing"))).otherwise(F.concat(F.lit("Price  Rate\n"), price, F.lit(" 12%")))
    found = tables.detected(read(spark, sf_dir, "orders").select("o_orderkey", rows.alias("rows"), page.alias("page_text")))
    return found.select("o_orderkey", "header_ok", "n_corrupt")


LINES_SQL = """SELECT l_orderkey::VARCHAR AS source_id, l_linenumber AS page, 1 AS table_no, (l_quantity % 3)::INT AS n_cols, (l_discount * 1000)::DOUBLE AS bottom, (l_tax * 2000)::DOUBLE AS top, l_returnflag <> 'R' AS ok FROM lineitem"""


@query(f"""WITH t AS ({LINES_SQL}),
p AS (SELECT c.source_id, c.page, b.table_no AS previous_no, c.table_no, 1 + (c.n_cols = b.n_cols)::INT + (c.n_cols = b.n_cols AND abs(c.top - b.top) <= 6)::INT + (b.bottom <= 80)::INT + (NOT c.ok)::INT AS signals
  FROM t c JOIN t b ON b.source_id = c.source_id AND b.page = c.page - 1 WHERE c.top <= 120)
SELECT *, signals >= 3 AS suspect FROM p""")
def d8_continuations(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    n = (F.col("l_quantity") % 3).cast("int")
    top = F.col("l_tax") * 2000
    rows = items.select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").alias("page"), F.lit(1).alias("table_no"), n.alias("n_cols"), F.array_repeat(top, n + 1).alias("col_xs"), (F.col("l_discount") * 1000).alias("bottom_gap"), top.alias("top_gap"), (F.col("l_returnflag") != "R").alias("header_ok"))
    return tables.continuations(rows)


RULED_SQL = """l AS (
  SELECT l_orderkey::VARCHAR AS source_id, ((l_linenumber + 1) // 2)::INT AS page, 50.0::DOUBLE + l_partkey % 4 AS x, l_tax * 2000 + (l_linenumber % 2) * 400 AS y,
    (1 + l_quantity % 3)::INT AS c, (1 + l_suppkey % 2)::INT AS r, l_returnflag <> 'R' AS closed FROM lineitem),
s AS (
  SELECT source_id, page, TRUE AS flat, y + 20 * unnest(range(0, r + 1)) AS place, x AS low, x + 30 * c AS high FROM l
  UNION ALL SELECT source_id, page, TRUE, y + 20 * unnest(range(0, r + 1)), x + 30 * c + 1, x + 60 * c FROM l
  UNION ALL SELECT source_id, page, FALSE, x + 60 * unnest(range(0, CASE WHEN closed THEN c + 1 ELSE 1 END)), y, y + 20 * r FROM l),
rules AS (SELECT *, row_number() OVER () AS id FROM s),
e AS (
  SELECT a.id AS a, b.id AS b FROM rules a JOIN rules b ON a.source_id = b.source_id AND a.page = b.page AND a.flat AND NOT b.flat
    AND b.place BETWEEN a.low - 3 AND a.high + 3 AND a.place BETWEEN b.low - 3 AND b.high + 3
  UNION ALL SELECT a.id, b.id FROM rules a JOIN rules b ON a.source_id = b.source_id AND a.page = b.page AND a.flat = b.flat AND round(a.place, 1) = round(b.place, 1) AND a.id < b.id AND b.low <= a.high + 3 AND a.low <= b.high + 3),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT id, id AS other FROM rules UNION SELECT reach.id, u.b FROM reach JOIN u ON u.a = reach.other),
m AS (SELECT source_id, page, flat, place, part FROM rules JOIN (SELECT id, min(other) AS part FROM reach GROUP BY id) USING (id)),
f AS (SELECT *, coalesce(place - lag(place) OVER (PARTITION BY source_id, page, part, flat ORDER BY place) > 3, TRUE) AS first FROM (SELECT DISTINCT * FROM m)),
p AS (SELECT source_id, page, part, list(place ORDER BY place) FILTER (NOT flat AND first) AS xs, list(place ORDER BY place) FILTER (flat AND first) AS ys FROM f GROUP BY ALL HAVING len(xs) > 1 AND len(ys) > 1),
t AS (SELECT source_id, page, row_number() OVER (PARTITION BY source_id, page ORDER BY ys[1], xs[1])::INT AS table_no, (len(ys) - 1)::INT AS n_rows, (len(xs) - 1)::INT AS n_cols,
  round(xs[1], 1) AS first_x, round(xs[-2], 1) AS last_x, round(792 - ys[-1], 1) AS bottom_gap, round(ys[1], 1) AS top_gap FROM p)"""


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of pages that hold a grid for each order line, two to a page, rules in two pieces; lines that were returned lack all but the first upright."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.floor((F.col("l_linenumber") + 1) / 2).cast("int").alias("page"), (50.0 + F.col("l_partkey") % 4).alias("x"), (F.col("l_tax") * 2000 + F.col("l_linenumber") % 2 * 400).alias("y"), (1 + F.col("l_quantity") % 3).cast("int").alias("c"), (1 + F.col("l_suppkey") % 2).cast("int").alias("r"), (F.col("l_returnflag") != "R").alias("closed"))
    place = lambda side, step, k: F.col(side) + step * k
    line = lambda x0, y0, x1, y1: F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    middle, right, bottom = place("x", 30, F.col("c")), place("x", 60, F.col("c")), place("y", 20, F.col("r"))
    counted = lambda n: F.sequence(F.lit(0), n)
    flat = F.flatten(F.transform(counted(F.col("r")), lambda k: F.array(line(F.col("x"), place("y", 20, k), middle, place("y", 20, k)), line(middle + 1, place("y", 20, k), right, place("y", 20, k)))))
    upright = F.transform(counted(F.when(F.col("closed"), F.col("c")).otherwise(0)), lambda k: line(place("x", 60, k), F.col("y"), place("x", 60, k), bottom))
    segments_ = items.select("source_id", "page", F.explode(F.concat(flat, upright)).alias("s")).select("source_id", "page", "s.*")
    pages = items.select("source_id", "page").distinct().withColumn("height", F.lit(792.0))
    return geometry.ruled_tables(segments_, pages)


@query(f"WITH RECURSIVE {RULED_SQL} SELECT * FROM t")
def d9_ruled_tables(spark, sf_dir):
    found = ruled(spark, sf_dir)
    return found.withColumns({"first_x": F.get("col_xs", F.lit(0)), "last_x": F.element_at("col_xs", -1)}).drop("col_xs")


@query(f"""WITH RECURSIVE {RULED_SQL},
q AS (SELECT c.source_id, c.page, b.table_no AS previous_no, c.table_no, 1 + (c.n_cols = b.n_cols)::INT + (c.n_cols = b.n_cols AND abs(c.first_x - b.first_x) <= 6)::INT + (b.bottom_gap <= 80)::INT + (c.n_rows = 1)::INT AS signals
  FROM t c JOIN t b ON b.source_id = c.source_id AND b.page = c.page - 1 WHERE c.top_gap <= 120)
SELECT *, signals >= 3 AS suspect FROM q""")
def d9_d8_continued_tables(spark, sf_dir):
    """Continuations among the tables found; a table of one row counts as one without a header."""
    return tables.continuations(ruled(spark, sf_dir).withColumn("header_ok", F.col("n_rows") > 1))


@query("""SELECT source AS source_id, repaired, labelled, problem IS NULL AS ok, problem FROM (
  SELECT *, CASE WHEN repaired > 0 AND labelled = 0 THEN 'repairs without a label' WHEN repaired = 0 AND labelled > 0 THEN 'labels without a repair' WHEN labelled < repaired THEN 'fewer labels than repairs' END AS problem
  FROM (SELECT source, count(*) FILTER (lang = 'fr') AS repaired, count(*) FILTER (lang = 'de') AS labelled FROM documents GROUP BY source))""")
def d10_provenance_propagation(spark, sf_dir):
    files = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.sum((F.col("lang") == "fr").cast("long")).alias("repaired"), F.sum((F.col("lang") == "de").cast("long")).alias("labelled"))
    return tables.provenance_propagation(files)


# ---- chunking ------------------------------------------------------------------------------------


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("title"), "text", F.lit("").alias("owner"), F.lit("corpus").alias("origin"))
    return chunking.chunk_documents(docs)


@query()
def c8_chunks(spark, sf_dir):
    return document_chunks(spark, sf_dir).drop("heading_path")


@query()
def c9_prefix_leaks(spark, sf_dir):
    return invariants.prefix_checks(document_chunks(spark, sf_dir))


@query()
def c10_chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(document_chunks(spark, sf_dir))


@query()
def c12_cost_estimate(spark, sf_dir):
    return chunking.cost_estimate(document_chunks(spark, sf_dir))


@query("SELECT count(*) AS n, count(*) FILTER (lang = 'es') AS n_violations FROM documents")
def c14_ownership(spark, sf_dir):
    rows = child_chunks(spark, sf_dir).withColumn("origin", F.lit("corpus"))
    return chunking.ownership_violations(rows)


# ---- index and retrieval ---------------------------------------------------------------------------


@query("SELECT vec_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 9)) AS vec FROM (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings)")
def r1_truncate(spark, sf_dir):
    cut = index.truncate(F.col("embedding"), 16)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(cut, lambda x: F.round(x, 9)).alias("vec"))


@query("""SELECT count(*) AS n_children, count(*) FILTER (e.vec_id IS NULL) AS n_zero, count(*) FILTER (d.source = 'src3') AS n_orphans, 2::BIGINT AS n_provenances, false AS uniform_provenance, true AS uniform_contextualization
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def r2_index_report(spark, sf_dir):
    provenance = F.when(F.col("lang") == "es", "model_generated").when(F.col("lang") == "fr", "prefixed").otherwise("verbatim")
    children = child_chunks(spark, sf_dir).select("chunk_id", "parent_id", provenance.alias("text_provenance"), F.lit(True).alias("has_contextual_prefix"), F.lit("corpus").alias("origin"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    parents = children.select("parent_id").filter("NOT startswith(parent_id, 'src3/')").distinct()
    return index.build_report(children, vectors, parents)


@query(f"WITH {VECTORS_SQL}, {DENSE_SQL} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM dense WHERE rank < 10")
def r5_dense_top_k(spark, sf_dir):
    chunks = vector_chunks(spark, sf_dir)
    return retrieval.dense(vector_queries(chunks), chunks, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS_SQL}, {index_sql()} SELECT term, df, round(idf, 9) AS idf FROM terms")
def r8_term_stats(spark, sf_dir):
    return text_index(child_chunks(spark, sf_dir))[1].select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {CHUNKS_SQL}, {index_sql()} SELECT chunk_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, any_value(dl)::INT AS dl FROM post GROUP BY chunk_id")
def r7_postings(spark, sf_dir):
    posted = index.postings(child_chunks(spark, sf_dir))
    return posted.groupBy("chunk_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("dl").alias("dl"))


@query(f"WITH {CHUNKS_SQL}, {index_sql()} SELECT any_value(n) AS n, count(*) AS vocab, round(any_value(avgdl), 1) AS avgdl, count(*) FILTER (df = 1) AS singletons, round(count(*) FILTER (df = 1) / greatest(count(*), 1), 3) AS singleton_share FROM terms, stats")
def r22_vocabulary(spark, sf_dir):
    posted, terms, stats = text_index(child_chunks(spark, sf_dir))
    return index.vocabulary_report(terms, stats)


@query(f"WITH {CHUNKS_SQL}, {TQ_SQL}, {index_sql()}, {sparse_sql('tq')} SELECT query_id, chunk_id, rank::INT AS rank, matched, round(score, 6) AS score FROM sparse WHERE rank < 10")
def r10_sparse_top_k(spark, sf_dir):
    chunks, queries = child_chunks(spark, sf_dir), text_queries(spark, sf_dir)
    hits = retrieval.sparse(queries, *text_index(chunks, queries), k=10)
    return hits.select("query_id", "chunk_id", "rank", "matched", F.round("score", 6).alias("score"))


def stored_index(spark: SparkSession) -> segments.Index:
    """A new stored index in the shared folder."""
    return segments.load(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


def maintained_index(spark: SparkSession, sf_dir: str) -> segments.Index:
    """All chunks, by way of adding most, removing some of these and some absent ones, adding the others, adding the removed again and replacing a few."""
    chunks = child_chunks(spark, sf_dir).select("chunk_id", "owner", "text")
    part = F.col("chunk_id") % 10
    shortened = chunks.filter(part == 3).withColumn("text", F.lit("a text that is replaced"))
    index = segments.add(stored_index(spark), chunks.filter(part.isin(0, 1, 2, 4, 5, 6)).unionByName(shortened))
    index = segments.remove(index, chunks.filter(part.isin(2, 8, 9)).select("chunk_id"))
    return segments.add(index, chunks.filter(part.isin(2, 3, 7, 8, 9)))


def stored_hits(index: segments.Index, spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.search(index, text_queries(spark, sf_dir), 10).select("query_id", "chunk_id", "rank", "matched", F.round("score", 6).alias("score"))


@query(SQL["r10_sparse_top_k"])
def r10_stored_top_k(spark, sf_dir):
    """The same rows from a stored index, by blocks with bounds."""
    return stored_hits(segments.add(stored_index(spark), child_chunks(spark, sf_dir).select("chunk_id", "owner", "text")), spark, sf_dir)


@query(SQL["r10_sparse_top_k"])
def m4_maintained_top_k(spark, sf_dir):
    """The same rows from an index that was changed in three steps."""
    return stored_hits(maintained_index(spark, sf_dir), spark, sf_dir)


@query(SQL["r8_term_stats"])
def m3_maintained_terms(spark, sf_dir):
    """The same term statistics after the changed index is merged."""
    return segments.merge(maintained_index(spark, sf_dir)).terms().select("term", "df", F.round("idf", 9).alias("idf"))


RRF_SQL = """legs AS (SELECT 'dense' AS leg, query_id, chunk_id, rank + 1 AS r FROM dense UNION ALL SELECT 'sparse', query_id, chunk_id, rank + 1 FROM sparse),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, min(r) AS best, count(*) AS n_legs, min(r) FILTER (leg = 'dense') AS dense_rank, min(r) FILTER (leg = 'sparse') AS sparse_rank FROM legs GROUP BY query_id, chunk_id),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, chunk_id) - 1 AS rank FROM fused)"""
FUSED_SQL = f"WITH {VECTORS_SQL}, {DENSE_SQL}, {index_sql()}, {sparse_sql('vq')}, {RRF_SQL}"


def fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = all_chunks(spark, sf_dir)
    queries = vector_queries(chunks)
    legs = {"dense": retrieval.dense(queries, chunks), "sparse": retrieval.sparse(queries, *text_index(child_chunks(spark, sf_dir), queries), counted=False)}
    return chunks, retrieval.rrf(legs)


@query(f"{FUSED_SQL} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 9) AS score, n_legs, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank FROM rrf")
def r12_rrf(spark, sf_dir):
    return fused(spark, sf_dir)[1].select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "n_legs", "dense_rank", "sparse_rank")


@query(f"""{FUSED_SQL} SELECT query_id, count(*) AS n_fused, count(dense_rank) AS dense_in_fused, count(*) FILTER (dense_rank IS NOT NULL AND n_legs = 1) AS dense_only, round(count(*) FILTER (dense_rank IS NOT NULL AND n_legs = 1) / count(*), 3) AS dense_share_unique,
count(sparse_rank) AS sparse_in_fused, count(*) FILTER (sparse_rank IS NOT NULL AND n_legs = 1) AS sparse_only, round(count(*) FILTER (sparse_rank IS NOT NULL AND n_legs = 1) / count(*), 3) AS sparse_share_unique, count(*) FILTER (n_legs = 2) AS both_legs
FROM rrf WHERE rank < 50 GROUP BY query_id""")
def r13_leg_contribution(spark, sf_dir):
    return retrieval.leg_contribution(fused(spark, sf_dir)[1], ["dense", "sparse"])


COST_SQL = "greatest(1, length({c}) // 4)"
CHILD_FILL_SQL = f"""costed AS (SELECT h.query_id, h.rank, h.chunk_id, {COST_SQL.format(c="c.text")} AS cost FROM {{hits}} h JOIN chunks c ON c.chunk_id = h.chunk_id),
run AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM costed WHERE rank < 200)"""
SPARSE_HITS_SQL = f"WITH {CHUNKS_SQL}, {TQ_SQL}, {index_sql()}, {sparse_sql('tq')}"
PARENT_FILL_SQL = f"""parents AS (SELECT parent_id, greatest(1, length(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id), '')) // 4) AS tokens FROM chunks GROUP BY parent_id),
targets AS (SELECT h.query_id, h.rank, h.chunk_id, 'parent:' || c.parent_id AS target, p.tokens FROM sparse h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN parents p ON p.parent_id = c.parent_id),
costed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, target ORDER BY rank) = 1 THEN tokens ELSE 0 END AS cost FROM targets),
run AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM costed WHERE rank < 200)"""


@query(f"{SPARSE_HITS_SQL}, {CHILD_FILL_SQL.format(hits='sparse')} SELECT query_id, chunk_id, rank::INT AS rank, cost, spent::BIGINT AS spent FROM run WHERE spent <= 1500")
def r14_budget_fill(spark, sf_dir):
    filled = retrieval.fill(retrieval.costed(sparse_hits(spark, sf_dir), child_chunks(spark, sf_dir)), 1500)
    return filled.select("query_id", "chunk_id", "rank", "cost", "spent")


@query(f"{SPARSE_HITS_SQL}, {PARENT_FILL_SQL} SELECT query_id, chunk_id, rank::INT AS rank, target, cost::BIGINT AS cost, spent::BIGINT AS spent FROM run WHERE spent <= 12000")
def r15_parent_fill(spark, sf_dir):
    chunks = child_chunks(spark, sf_dir)
    filled = retrieval.fill(retrieval.costed(sparse_hits(spark, sf_dir), chunks, parent_costs(chunks), unit="parent"), retrieval.BUDGET)
    return filled.select("query_id", "chunk_id", "rank", "target", "cost", "spent")


@query(f"{SPARSE_HITS_SQL}, costed AS (SELECT h.query_id, h.rank, h.chunk_id, {COST_SQL.format(c='(c.source_id || chr(10) || chr(10) || c.text)')} AS cost FROM sparse h JOIN chunks c ON c.chunk_id = h.chunk_id), run AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM costed WHERE rank < 200) SELECT query_id, count(*) FILTER (spent <= 3000) AS n_delivered, coalesce(max(spent) FILTER (spent <= 3000), 0)::BIGINT AS tokens FROM run GROUP BY query_id")
def r16_indexed_cost(spark, sf_dir):
    ranked = retrieval.costed(sparse_hits(spark, sf_dir), child_chunks(spark, sf_dir), basis="indexed")
    return retrieval.sweep(ranked, (3000,)).select("query_id", "n_delivered", "tokens")


@query(f"{SPARSE_HITS_SQL}, {PARENT_FILL_SQL}, best AS (SELECT query_id, target, min(rank) AS child_rank FROM run WHERE spent <= 12000 GROUP BY ALL) SELECT query_id, target, child_rank::INT AS child_rank, (row_number() OVER (PARTITION BY query_id ORDER BY child_rank) - 1)::INT AS rank FROM best")
def r17_parents(spark, sf_dir):
    chunks = child_chunks(spark, sf_dir)
    filled = retrieval.fill(retrieval.costed(sparse_hits(spark, sf_dir), chunks, parent_costs(chunks), unit="parent"), retrieval.BUDGET)
    return retrieval.resolve_parents(filled)


@query(f"{SPARSE_HITS_SQL}, {CHILD_FILL_SQL.format(hits='sparse')} SELECT query_id, count(*) AS n_ranked, count(*) FILTER (spent <= 100) AS n_delivered, min(cost) FILTER (cost > 0) AS min_unit_tokens, count(*) > 0 AND count(*) FILTER (spent <= 100) = 0 AS starved FROM run GROUP BY query_id")
def r18_starvation(spark, sf_dir):
    return retrieval.starvation(retrieval.costed(sparse_hits(spark, sf_dir), child_chunks(spark, sf_dir)), 100)


@query(f"""{FUSED_SQL}, truth AS (SELECT query_id, chunk_id FROM dense WHERE rank < 10), found AS (SELECT query_id, chunk_id FROM rrf WHERE rank < 10)
SELECT query_id, round(count(f.chunk_id) / count(*), 6) AS recall FROM truth t LEFT JOIN found f USING (query_id, chunk_id) GROUP BY query_id""")
def r21_recall_at_k(spark, sf_dir):
    chunks, ranked = fused(spark, sf_dir)
    return retrieval.recall_at_k(ranked.filter("rank < 10"), retrieval.dense(vector_queries(chunks), chunks, 10))


@query(f"{SPARSE_HITS_SQL}, {CHILD_FILL_SQL.format(hits='sparse')}, b AS (SELECT unnest([250, 500, 1000, 1500, 3000, 6000, 12000]) AS budget) SELECT query_id, budget, count(*) FILTER (spent <= budget) AS n_delivered, coalesce(max(spent) FILTER (spent <= budget), 0)::BIGINT AS tokens FROM run, b GROUP BY query_id, budget")
def e5_budget_sweep(spark, sf_dir):
    return retrieval.sweep(retrieval.costed(sparse_hits(spark, sf_dir), child_chunks(spark, sf_dir)))


@query(f"""{FUSED_SQL}, modes AS (SELECT 'dense' AS mode, query_id, chunk_id, rank FROM dense UNION ALL SELECT 'sparse', query_id, chunk_id, rank FROM sparse UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM rrf),
run AS (SELECT mode, query_id, rank, sum({COST_SQL.format(c="c.text")}) OVER (PARTITION BY mode, query_id ORDER BY rank) AS spent FROM modes m JOIN chunks c ON c.chunk_id = m.chunk_id WHERE rank < 200),
b AS (SELECT unnest([500, 1500, 3000]) AS budget)
SELECT mode, budget, count(DISTINCT query_id) AS n_queries, count(*) FILTER (spent <= budget) AS n_delivered FROM run, b GROUP BY mode, budget""")
def a19_mode_grid(spark, sf_dir):
    chunks = all_chunks(spark, sf_dir)
    queries = vector_queries(chunks)
    built = text_index(child_chunks(spark, sf_dir), queries)
    out = None
    for mode, hits in retrieval.ranked_modes(queries, chunks, built).items():
        swept = retrieval.sweep(retrieval.costed(hits, chunks), (500, 1500, 3000))
        part = swept.groupBy("budget").agg(F.count_distinct("query_id").alias("n_queries"), F.sum("n_delivered").alias("n_delivered")).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out.select("mode", "budget", "n_queries", "n_delivered")


@query(f"""{SPARSE_HITS_SQL}, rel AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains({SQUASH.format(c='d.text')}, {SQUASH.format(c='b.text')})),
g AS (SELECT query_id, sum(1 / log2(rank + 2)) AS dcg FROM sparse JOIN rel USING (query_id, chunk_id) WHERE rank < 5 GROUP BY query_id),
i AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda k: 1 / log2(k + 1))) AS ideal FROM rel GROUP BY query_id)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN g USING (query_id)""")
def a24_ndcg(spark, sf_dir):
    found = write_shared(needle_hits(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("page").alias("chunk_id")), "relevant")
    return retrieval.ndcg(sparse_hits(spark, sf_dir), found)


# ---- golden items and evaluation -------------------------------------------------------------------


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark text, squashed."""
    return read(spark, sf_dir, "benchmark").select("item_id", text.squash(F.col("text")).alias("needle"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"), "text")


def needle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.occurrences(needles(spark, sf_dir), pages_of(spark, sf_dir))


NEEDLE_SQL = f"""nd AS (SELECT item_id, {SQUASH.format(c='text')} AS needle FROM benchmark),
occ AS (SELECT item_id, needle, d.source AS source_id, d.doc_id AS page FROM nd JOIN (SELECT source, doc_id, {SQUASH.format(c='text')} AS t FROM documents) d ON contains(d.t, nd.needle))"""


@query(f"WITH {NEEDLE_SQL} SELECT item_id, source_id, page FROM occ")
def j6_needle_windows(spark, sf_dir):
    return needle_hits(spark, sf_dir).select("item_id", "source_id", "page")


@query(f"""WITH {NEEDLE_SQL}, it AS (SELECT item_id, needle, 'src' || (item_id % 20) AS source_id FROM nd),
r AS (SELECT it.item_id, length(it.needle) BETWEEN 14 AND 160 AS fits, bool_or(o.source_id = it.source_id) IS TRUE AS located, count(o.page) AS n FROM it LEFT JOIN occ o ON o.item_id = it.item_id GROUP BY ALL)
SELECT item_id, (fits AND located)::BIGINT AS n_good, (NOT fits)::BIGINT AS n_length, (fits AND NOT located)::BIGINT AS n_unlocatable, CASE WHEN fits AND located THEN n ELSE 0 END AS n_occurrences, NOT (fits AND located) OR n = 1 AS is_unique, fits AND located AS kept FROM r""")
def e2_verify_items(spark, sf_dir):
    items = needles(spark, sf_dir).withColumn("source_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return evaluation.verify_items(items, needle_hits(spark, sf_dir))


@query(f"""WITH {NEEDLE_SQL}, it AS (SELECT item_id, needle, 'src' || (item_id % 20) AS source_id FROM nd),
r AS (SELECT it.item_id, length(it.needle) BETWEEN 14 AND 160 AS fits, bool_or(o.source_id = it.source_id) IS TRUE AS located, count(o.page) AS n FROM it LEFT JOIN occ o ON o.item_id = it.item_id GROUP BY ALL)
SELECT count(*) AS n_items, count(*) FILTER (fits AND located) AS n_kept, count(*) FILTER (NOT fits) AS n_length, count(*) FILTER (fits AND NOT located) AS n_unlocatable, count(*) FILTER (fits AND located AND n > 1) AS n_ambiguous FROM r""")
def a13_a14_golden_summary(spark, sf_dir):
    rows = e2_verify_items(spark, sf_dir)
    return rows.agg(F.count("*").alias("n_items"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum("n_length").alias("n_length"), F.sum("n_unlocatable").alias("n_unlocatable"), F.sum((F.col("kept") & ~F.col("is_unique")).cast("long")).alias("n_ambiguous"))


def delivered_texts(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """What the ranking delivers at 1500 tokens, stored for its readers; ``hits`` is the ranking where a caller has it already."""
    chunks = child_chunks(spark, sf_dir)
    filled = write_shared(retrieval.fill(retrieval.costed(sparse_hits(spark, sf_dir) if hits is None else hits, chunks), 1500), "filled")
    return write_shared(bounded(filled).join(chunks.select("chunk_id", "source_id", "text"), "chunk_id"), "delivered")


SCORE_SQL = f"""{SPARSE_HITS_SQL}, {CHILD_FILL_SQL.format(hits='sparse')}, {NEEDLE_SQL},
acc AS (SELECT item_id, list(DISTINCT source_id) AS accept FROM occ GROUP BY item_id),
del AS (SELECT query_id AS item_id, rank, c.source_id, {SQUASH.format(c='c.text')} AS t, run.cost FROM run JOIN chunks c ON c.chunk_id = run.chunk_id WHERE spent <= 1500),
cov AS (SELECT nd.item_id, any_value(nd.needle) AS needle, count(del.rank) AS n_delivered, coalesce(sum(del.cost), 0)::BIGINT AS tokens,
  coalesce(max(CASE WHEN contains(del.t, nd.needle) THEN 1.0::DOUBLE ELSE list_max([0] || list_filter(range(1, length(nd.needle) + 1), lambda k: contains(del.t, left(nd.needle, k::INT)))) / length(nd.needle) END), 0.0) AS share,
  min(del.rank) FILTER (list_contains(acc.accept, del.source_id)) AS first_hit
  FROM nd LEFT JOIN acc USING (item_id) LEFT JOIN del ON del.item_id = nd.item_id GROUP BY nd.item_id),
scored AS (SELECT item_id, n_delivered, tokens, share >= 1 AS strict, share >= 0.5 AS partial, first_hit IS NOT NULL AS source_hit, first_hit FROM cov)"""


def scored_items(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    accept = needle_hits(spark, sf_dir).groupBy("item_id").agg(F.collect_set("source_id").alias("accept"))
    items = needles(spark, sf_dir).join(accept, "item_id", "left")
    given = delivered_texts(spark, sf_dir, hits).select(F.col("query_id").alias("item_id"), F.lit("child").alias("unit"), "rank", "source_id", "text", "cost")
    sums = given.groupBy("item_id").agg(F.count("*").alias("n_delivered"), F.sum("cost").alias("tokens"))
    scored = evaluation.score_items(items, given.drop("cost"))
    return scored.join(sums, "item_id", "left").na.fill(0, ["n_delivered", "tokens"])


@query(f"{SCORE_SQL} SELECT item_id, strict, partial, source_hit, first_hit::INT AS rank_first_hit, n_delivered, tokens FROM scored")
def e4_score_items(spark, sf_dir):
    return scored_items(spark, sf_dir).select("item_id", "strict", "partial", "source_hit", "rank_first_hit", "n_delivered", "tokens")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = F.array(*map(F.lit, evaluation.STRATA))
    stratum = F.get(strata, (F.col("item_id") % 6).cast("int"))
    return scored_items(spark, sf_dir).withColumns({"stratum": stratum, "anchor": F.when(F.col("item_id") % 9 == 0, "asset").otherwise("needle"), "skipped": stratum == "out_of_scope", "quarantined": F.col("item_id") % 13 == 5, "no_delivery": F.col("n_delivered") == 0})


def rate_sql(hits: str, name: str, n: str = "n_items") -> str:
    p = f"({hits} / {n})"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 1.96 * 1.96 / (4 * {n} * {n})) / (1 + 1.96 * 1.96 / {n})"
    centre = f"({p} + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n})"
    label = f"CASE WHEN {n} = 0 THEN 'no items' WHEN {n} < 10 THEN {hits} || ' of ' || {n} ELSE {hits} || '/' || {n} || ' = ' || round(100 * {p})::BIGINT || '%' END"
    return f"{hits} AS {name}_hits, CASE WHEN {n} >= 10 THEN round({p}, 3) END AS {name}_rate, CASE WHEN {n} >= 10 THEN round(greatest(0, {centre} - {half}), 3) END AS {name}_low, CASE WHEN {n} >= 10 THEN round(least(1, {centre} + {half}), 3) END AS {name}_high, {label} AS {name}_label"


RESULTS_SQL = f"""{SCORE_SQL}, res AS (SELECT *, ['simple_factual', 'multi_hop', 'aggregative', 'out_of_scope', 'ambiguous', 'exact_identifier'][1 + item_id % 6] AS stratum, CASE WHEN item_id % 9 = 0 THEN 'asset' ELSE 'needle' END AS anchor FROM scored)"""


@query(f"""{RESULTS_SQL},
g AS (SELECT CASE WHEN grouping(stratum) = 0 THEN 'stratum' WHEN grouping(anchor) = 0 THEN 'anchor' ELSE 'headline' END AS slice, coalesce(stratum, anchor, '') AS value, count(*) AS n_items, round(avg(tokens))::BIGINT AS mean_tokens, count(*) FILTER (n_delivered = 0) AS n_no_delivery,
  count(*) FILTER (strict) AS s, count(*) FILTER (partial) AS p, count(*) FILTER (source_hit) AS h FROM res WHERE stratum <> 'out_of_scope' AND item_id % 13 <> 5 GROUP BY GROUPING SETS ((), (stratum), (anchor)))
SELECT slice, value, n_items, mean_tokens, n_no_delivery, {rate_sql('s', 'strict')}, {rate_sql('p', 'partial')}, {rate_sql('h', 'source_hit')} FROM g""")
def a1_a3_headline_and_slices(spark, sf_dir):
    return evaluation.aggregate_items(results(spark, sf_dir), ["stratum", "anchor"])


@query(f"""{RESULTS_SQL}, want AS (SELECT unnest(['simple_factual', 'multi_hop', 'aggregative', 'out_of_scope', 'ambiguous', 'exact_identifier', 'table_or_image']) AS stratum)
SELECT want.stratum, count(item_id) AS n, count(item_id) > 0 AS present, count(item_id) BETWEEN 1 AND 9 AS thin FROM want LEFT JOIN res ON res.stratum = want.stratum GROUP BY want.stratum""")
def a6_coverage(spark, sf_dir):
    return evaluation.coverage(results(spark, sf_dir))


@query(f"""{RESULTS_SQL}, c AS (SELECT count(DISTINCT stratum) AS present FROM res), h AS (SELECT count(*) AS n, count(*) FILTER (strict) AS s FROM res),
t AS (SELECT coalesce(list_sort(list(stratum)), []) AS thin FROM (SELECT stratum FROM res GROUP BY stratum HAVING count(*) < 10))
SELECT (CASE WHEN n = 0 THEN 'no items' WHEN n < 10 THEN s || ' of ' || n ELSE s || '/' || n || ' = ' || round(100 * (s / n))::BIGINT || '%' END) || CASE WHEN present < 7 THEN ' on ' || present || ' of 7 strata' ELSE '' END || CASE WHEN len(thin) > 0 THEN ' (' || array_to_string(thin, ', ') || ' thin)' ELSE '' END AS label FROM c, h, t""")
def f16_scope_label(spark, sf_dir):
    rows = write_shared(results(spark, sf_dir).select("item_id", "stratum", "strict"), "results")
    cover = evaluation.coverage(rows)
    head = rows.agg(rates.rate(F.sum(F.col("strict").cast("long")), F.count("*"))["label"].alias("label"))
    about = cover.agg(F.sum(F.col("present").cast("long")).alias("present"), F.count("*").alias("declared"), F.sort_array(F.collect_list(F.when(F.col("thin"), F.col("stratum")))).alias("thin"))
    return head.join(F.broadcast(about), F.lit(True)).select(rates.scope_label(F.col("label"), F.col("present"), F.col("declared"), F.col("thin")).alias("label"))


@query(f"""{SCORE_SQL} SELECT 'partial_covers_strict' AS name, 'partial >= strict' AS rule, (count(*) FILTER (partial) - count(*) FILTER (strict))::VARCHAR AS observed, CASE WHEN count(*) FILTER (partial) >= count(*) FILTER (strict) THEN 'HOLDS' ELSE 'FAILS' END AS state, count(*) AS n, '' AS fingerprint FROM scored""")
def a5_partial_covers_strict(spark, sf_dir):
    return invariants.scoring_check(scored_items(spark, sf_dir))


@query(f"""{SCORE_SQL} SELECT item_id, CASE WHEN n_ranked = 0 THEN 'no_candidates' WHEN n_delivered = 0 THEN 'starved' WHEN strict THEN 'present' WHEN partial THEN 'partial' ELSE 'absent' END AS cause
FROM scored LEFT JOIN (SELECT query_id, count(*) AS n_ranked FROM sparse GROUP BY query_id) r ON r.query_id = item_id""")
def a12_abstention_causes(spark, sf_dir):
    hits = sparse_hits(spark, sf_dir)
    ranked = hits.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n_ranked"))
    rows = scored_items(spark, sf_dir, hits).join(ranked, "item_id", "left")
    cause = evaluation.abstention_cause(F.coalesce("n_ranked", F.lit(0)), F.col("n_delivered"), F.col("strict").cast("int"), (F.col("partial") & ~F.col("strict")).cast("int"), F.lit(1))
    return rows.select("item_id", cause.alias("cause"))


KAPPA_SQL = """t AS (SELECT x, y, count(*) AS c FROM pairs GROUP BY x, y), w AS (SELECT sum(c) AS n, sum(c) FILTER (x = y) AS same FROM t),
m AS (SELECT sum(l * r) AS lr, max(l) AS top FROM (SELECT label, sum(l) AS l, sum(r) AS r FROM (SELECT x AS label, c AS l, 0 AS r FROM t UNION ALL SELECT y, 0, c FROM t) GROUP BY label)),
k AS (SELECT n, coalesce(same, 0) / n AS po, lr / (n * n) AS pe, top / n AS top FROM w, m)"""


@query(f"""WITH pairs AS (SELECT quality AS x, toxic AS y FROM labels), {KAPPA_SQL}
SELECT round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 3) AS kappa, round(po, 3) AS raw_agreement, round(pe, 3) AS chance_agreement, n::BIGINT AS n, round(top, 3) AS dominant_class_share, top > 0.8 AS prevalence_warning, n >= 30 AS sufficient FROM k""")
def a7_kappa(spark, sf_dir):
    return evaluation.kappa(read(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""WITH pairs AS (SELECT quality AS x, toxic AS y FROM labels), {KAPPA_SQL}, r AS (SELECT round((po - pe) / (1 - pe), 3) AS kappa, n::BIGINT AS n FROM k)
SELECT kappa, n, kappa >= 0.6 AND n >= 30 AS validated, false AS collision, kappa >= 0.6 AND n >= 30 AS may_emit FROM r""")
def g8_judge_gate(spark, sf_dir):
    return evaluation.judge_gate(a7_kappa(spark, sf_dir), "judge", "generator")


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality = toxic) AS agree FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a8_agreement_by_slice(spark, sf_dir):
    joined = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("quality") == F.col("toxic")).cast("long")).alias("agree"))


@query(f"""WITH v AS (SELECT lang, quality = 1 AS supported, toxic = 1 AS abstained, doc_id % 7 = 0 AS failed, doc_id % 11 = 0 AS starved FROM labels JOIN documents USING (doc_id)),
g AS (SELECT coalesce(lang, 'all') AS slice, count(*) AS n, count(*) FILTER (failed) AS n_failed, count(*) FILTER (NOT failed AND starved) AS n_starved, count(*) FILTER (NOT failed AND NOT abstained AND supported) AS fh, count(*) FILTER (NOT failed AND NOT abstained) AS fn, count(*) FILTER (NOT failed AND abstained) AS ah, count(*) FILTER (NOT failed) AS an FROM v GROUP BY GROUPING SETS ((), (lang))),
x AS (SELECT slice, n, n_failed, n_starved, {rate_sql('fh', 'f', 'fn')}, {rate_sql('ah', 'a', 'an')} FROM g)
SELECT slice, n, n_failed, n_starved, f_label AS faithful, f_rate AS faithful_rate, a_label AS abstained, a_rate AS abstained_rate FROM x""")
def a9_judged_score(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    verdicts = rows.select("lang", F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("faithfulness"), (F.col("toxic") == 1).alias("abstained"), (F.col("doc_id") % 7 == 0).alias("failed"), (F.col("doc_id") % 11 == 0).alias("starved"))
    return evaluation.judged_score(verdicts, "lang")


@query("""WITH u AS (SELECT doc_id::VARCHAR AS q, 0 AS o, CASE WHEN toxic = 1 THEN 'partial' ELSE 'absent' END AS cause FROM labels WHERE quality = 0 UNION ALL SELECT doc_id::VARCHAR, 1, 'present' FROM labels WHERE toxic = 1),
f AS (SELECT q, arg_min(cause, o) AS cause FROM u GROUP BY q), c AS (SELECT CASE cause WHEN 'partial' THEN 'FP2' WHEN 'absent' THEN 'FP3' ELSE 'FP4' END AS point, count(*) AS n FROM f GROUP BY 1)
SELECT point, n, round(n / sum(n) OVER (), 3) AS share FROM c""")
def a11_failure_histogram(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").withColumn("question", F.col("doc_id").cast("string"))
    low = labels.filter("quality = 0").select("question", F.when(F.col("toxic") == 1, "partial").otherwise("absent").alias("cause"))
    return evaluation.failure_histogram([low, labels.filter("toxic = 1").select("question", F.lit("present").alias("cause"))])


@query("SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY sha256(doc_id || '|7'), doc_id) AS pick FROM labels) WHERE pick <= 30")
def a22_balanced_sample(spark, sf_dir):
    return evaluation.balanced_sample(read(spark, sf_dir, "labels"), "toxic", 30, 7, "doc_id").select("doc_id", "toxic")


@query("SELECT count(*) AS n, count(*) FILTER (lang IN ('de', 'es')) AS n_hard, count(*) FILTER (lang IN ('de', 'es')) >= 10 AS hard_sufficient FROM documents")
def a23_sample_limits(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.when(F.col("lang") == "de", "mixed:page_text_clip+text_layer").when(F.col("lang") == "es", "caption").otherwise("text_layer").alias("text_source"))
    return evaluation.sample_limits(rows)


AB_SQL = "(SELECT 'strict' AS metric, avg(quality) AS rate, count(*) AS n FROM labels UNION ALL SELECT 'partial', avg(toxic), count(*) FROM labels UNION ALL SELECT 'thin', 0.5, 5)"


@query(f"""WITH c AS (SELECT metric, round(rate, 6) AS rate, n FROM {AB_SQL}), b AS (SELECT metric, CASE metric WHEN 'strict' THEN round(rate + 0.02, 6) ELSE round(rate + 0.2, 6) END AS base FROM {AB_SQL})
SELECT metric, rate, base, round(base - rate, 6) AS drop, n >= 10 AND round(base - rate, 6) <= 0.03 AS holds FROM c JOIN b USING (metric)""")
def e8_regression_gate(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    row = labels.agg(F.avg("quality").alias("strict"), F.avg("toxic").alias("partial"), F.count("*").alias("n"))
    current = row.select(F.explode(F.array(F.struct(F.lit("strict").alias("metric"), F.round("strict", 6).alias("rate"), "n"), F.struct(F.lit("partial").alias("metric"), F.round("partial", 6).alias("rate"), "n"), F.struct(F.lit("thin").alias("metric"), F.lit(0.5).alias("rate"), F.lit(5).cast("long").alias("n")))).alias("x")).select("x.*")
    base = current.withColumn("rate", F.round(F.col("rate") + F.when(F.col("metric") == "strict", 0.02).otherwise(0.2), 6))
    return evaluation.regression_gate(current, base)


@query(f"""{SPARSE_HITS_SQL}, {CHILD_FILL_SQL.format(hits='sparse')}, b AS (SELECT unnest([250, 500, 1000, 1500, 3000, 6000, 12000]) AS budget), s AS (SELECT query_id, budget, count(*) FILTER (spent <= budget) AS n FROM run, b GROUP BY ALL)
SELECT query_id AS item_id, min(budget) FILTER (n >= 3) AS smallest_budget, count(*) AS n_budgets FROM s GROUP BY query_id""")
def w8_smallest_budget(spark, sf_dir):
    swept = e5_budget_sweep(spark, sf_dir)
    return evaluation.smallest_budget(swept.select(F.col("query_id").alias("item_id"), "budget", (F.col("n_delivered") >= 3).alias("passes")))


@query("SELECT count(DISTINCT source)::INT AS n_fingerprints, CASE WHEN count(DISTINCT source) > 1 THEN 'MIXED' ELSE any_value(source) END AS fingerprint FROM documents")
def e7_index_provenance(spark, sf_dir):
    return evaluation.index_provenance(read(spark, sf_dir, "documents").withColumn("pipeline_fingerprint", F.col("source")))


@query("SELECT count(*) AS n, count(DISTINCT lang) = 1 AND bool_and(lang IS NOT NULL) AS comparable FROM documents")
def e17_comparable(spark, sf_dir):
    return evaluation.require_comparable(read(spark, sf_dir, "documents").select(F.col("lang").alias("fingerprint"), F.lit(1500).alias("budget")))


@query("""SELECT source AS source_id, 'pdf' AS doc_type, (doc_id // 5)::INT AS page, bool_or(lang = 'fr') AS has_table, length(trim(string_agg(CASE WHEN length(trim(text, ' ')) > 0 THEN text END, chr(10) || chr(10) ORDER BY doc_id), ' '))::BIGINT AS chars FROM documents GROUP BY source, doc_id // 5 HAVING chars >= 200""")
def e1_windows(spark, sf_dir):
    blocks = read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.lit("pdf").alias("doc_type"), F.floor(F.col("doc_id") / 5).cast("int").alias("page"), F.col("doc_id").alias("ordinal"), F.when(F.col("lang") == "fr", "table").otherwise("text").alias("kind"), "text", F.lit(None).cast("string").alias("asset_path"))
    return evaluation.windows(blocks).select("source_id", "doc_type", "page", "has_table", F.length("text").cast("long").alias("chars"))


@query("""WITH w AS (SELECT source AS source_id, doc_id AS page, CASE WHEN lang = 'es' THEN 0 WHEN lang = 'fr' THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END AS bucket FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY source_id, page) - 1 AS pos, count(*) OVER (PARTITION BY bucket) AS size FROM w),
k AS (SELECT greatest(400 - count(*) FILTER (bucket = 0) - least(count(*) FILTER (bucket = 1), 200) - least(count(*) FILTER (bucket = 2), 100), 0) AS need, count(*) FILTER (bucket = 3) AS rest FROM w),
p AS (SELECT source_id, page, bucket FROM r, k WHERE bucket = 0 OR (bucket = 1 AND pos < 200) OR (bucket = 2 AND pos < 100) OR (bucket = 3 AND pos % greatest(rest // greatest(need, 1), 1) = 0 AND pos // greatest(rest // greatest(need, 1), 1) < need))
SELECT source_id, page, bucket FROM p ORDER BY bucket, source_id, page LIMIT 400""")
def l2_select_windows(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"), F.when(F.col("lang") == "es", "image").otherwise("pdf").alias("doc_type"), (F.col("lang") == "fr").alias("has_table"), (F.col("lang") == "de").alias("has_identifier"))
    return evaluation.select_windows(pages, 400)


@query(r"""WITH q AS (SELECT item_id AS question_id, list_transform(list_sort(list_transform(list_distinct(list_transform(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: length(w) > 5), lambda w: lower(regexp_replace(w, '^[?,.]+|[?,.]+$', '', 'g')))), lambda w: {'k': -length(w), 'w': w})), lambda x: x.w)[1:4] AS ws FROM benchmark),
h AS (SELECT question_id, count(*) AS n FROM q JOIN (SELECT lower(text) AS t FROM documents) d ON len(list_filter(ws, lambda w: contains(t, w))) >= greatest(2, len(ws) - 1) GROUP BY question_id)
SELECT q.question_id, coalesce(n, 0) AS n_windows, n IS NOT NULL AS rejected FROM q LEFT JOIN h ON h.question_id = q.question_id""")
def e3_out_of_scope(spark, sf_dir):
    questions = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return evaluation.answerable(questions, pages_of(spark, sf_dir))


# ---- answers --------------------------------------------------------------------------------------


def sample_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each benchmark text as an answer that quotes it under three labels; sent are the documents that hold it, then others."""
    turns = read(spark, sf_dir, "benchmark")
    quote = F.col("text")
    cites = F.array(*[F.struct(F.lit(label).alias("label"), q.alias("quote")) for label, q in (("1", quote), ("2", F.upper(quote)), ("x", quote), ("9", quote), ("1", F.lit("short")))])
    none = F.array().cast("array<struct<label:string,quote:string>>")
    claims = F.array(F.struct(F.lit("documents").alias("source"), cites.alias("citations")), F.struct(F.when(F.col("item_id") % 3 == 0, "conversation").otherwise("documents").alias("source"), none.alias("citations")))
    whole = F.when(F.col("item_id") % 2 == 0, F.array(F.struct(F.lit("documents").alias("source"), F.array(F.struct(F.lit("1").alias("label"), quote.alias("quote"))).alias("citations")))).otherwise(claims)
    answered = turns.select(F.col("item_id").alias("answer_id"), (F.col("item_id") % 5 == 0).alias("abstained"), whole.alias("claims"))
    sent = turns.select(F.col("item_id").alias("answer_id"), F.explode(F.array(F.struct(F.lit(1).alias("label"), F.concat(F.lit("a "), "text").alias("t")), F.struct(F.lit(2).alias("label"), F.when(F.col("item_id") % 4 == 0, "").otherwise(F.reverse("text")).alias("t")))).alias("s"))
    return answered, sent.select("answer_id", "s.label", F.concat_ws("-", F.col("answer_id"), F.col("s.label")).alias("chunk_id"), F.col("s.t").alias("verbatim_text"), F.lit("verbatim").alias("text_provenance"))


CITE_SQL = f"""cl AS (SELECT item_id AS answer_id, text, 0 AS claim_index, k - 1 AS citation_index, CASE WHEN item_id % 2 = 0 THEN ['1'][k] ELSE ['1', '2', 'x', '9', '1'][k] END AS raw, CASE k WHEN 2 THEN upper(text) WHEN 5 THEN 'short' ELSE text END AS quote
  FROM benchmark, (SELECT unnest(range(1, 6)) AS k) WHERE item_id % 2 = 1 OR k = 1),
ck AS (SELECT answer_id, claim_index, citation_index, try_cast(raw AS INTEGER) AS label, quote, CASE try_cast(raw AS INTEGER) WHEN 1 THEN 'a ' || text WHEN 2 THEN CASE WHEN answer_id % 4 = 0 THEN '' ELSE reverse(text) END END AS verbatim FROM cl),
checks AS (SELECT *, verbatim IS NULL AS fabricated, CASE WHEN verbatim IS NULL THEN 'no_quote' WHEN verbatim = '' THEN 'unquotable' WHEN length({SQUASH.format(c='quote')}) < 12 THEN 'no_quote' WHEN contains({SQUASH.format(c='verbatim')}, {SQUASH.format(c='quote')}) THEN 'verified' ELSE 'absent' END AS quote_status FROM ck)"""


@query(f"WITH {CITE_SQL} SELECT answer_id, claim_index::INT AS claim_index, citation_index::INT AS citation_index, label, fabricated, quote_status FROM checks")
def f2_g5_citation_checks(spark, sf_dir):
    answered, sent = sample_answers(spark, sf_dir)
    return answers.citation_checks(answered, sent).select("answer_id", "claim_index", "citation_index", "label", "fabricated", "quote_status")


RECON_SQL = f"""{CITE_SQL}, c AS (SELECT answer_id, count(*) AS citations_emitted, count(DISTINCT label) FILTER (NOT fabricated) AS chunks_cited, count(*) FILTER (quote_status = 'verified') AS citations_verified, count(*) FILTER (quote_status = 'absent') AS citations_absent, count(*) FILTER (fabricated) AS citations_fabricated, count(*) FILTER (quote_status = 'unquotable') AS citations_unquotable, count(*) FILTER (quote_status = 'no_quote') AS citations_short FROM checks GROUP BY answer_id),
a AS (SELECT item_id AS answer_id, item_id % 5 = 0 AS abstained, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END AS claims, CASE WHEN item_id % 2 = 0 OR item_id % 3 = 0 THEN 1 ELSE 2 END AS claims_from_documents, CASE WHEN item_id % 2 = 1 AND item_id % 3 = 0 THEN 1 ELSE 0 END AS claims_from_conversation, CASE WHEN item_id % 2 = 1 AND item_id % 3 <> 0 THEN 1 ELSE 0 END AS claims_uncited FROM benchmark),
rec AS (SELECT a.*, 0 AS claims_mislabelled, c.* EXCLUDE (answer_id), 2::BIGINT AS chunks_sent, citations_fabricated = 0 AND citations_absent = 0 AND citations_short = 0 AND (abstained OR claims_uncited = 0) AS grounded FROM a JOIN c ON c.answer_id = a.answer_id)"""


@query(f"WITH {RECON_SQL} SELECT * FROM rec")
def a18_reconcile_answers(spark, sf_dir):
    answered, sent = sample_answers(spark, sf_dir)
    return answers.reconcile_answers(answered, answers.citation_checks(answered, sent), sent)


@query(f"WITH {RECON_SQL} SELECT count(*) AS n, sum(citations_fabricated)::BIGINT AS observed, CASE WHEN sum(citations_fabricated) = 0 THEN 'HOLDS' ELSE 'FAILS' END AS state FROM rec")
def g9_citation_integrity(spark, sf_dir):
    return answers.integrity(a18_reconcile_answers(spark, sf_dir))


@query(f"WITH {CITE_SQL} SELECT answer_id, count(*) FILTER (quote_status = 'verified') AS quoted, count(*) FILTER (quote_status <> 'verified') AS found_not_quoted FROM checks WHERE NOT fabricated GROUP BY answer_id")
def g6_evidence_mix(spark, sf_dir):
    answered, sent = sample_answers(spark, sf_dir)
    checks = answers.citation_checks(answered, sent).filter(~F.col("fabricated"))
    return answers.evidence_mix(checks.withColumn("evidence_kind", ids.evidence_kind(F.lit("verbatim"), F.lit("text_layer"), F.col("quote_status"))), ["quoted", "found_not_quoted"])


@query()
def f2_quote_overlap(spark, sf_dir):
    answered, sent = sample_answers(spark, sf_dir)
    return answers.with_overlap(answers.citation_checks(answered, sent)).select("answer_id", "citation_index", "quote_status", F.round("overlap", 6).alias("overlap"))


@query(r"""WITH q AS (SELECT item_id, text, substr(text, 10) AS passage FROM benchmark),
n AS (SELECT item_id, list_filter(range(1, length(text) + 1), lambda i: regexp_matches(substr(text, i, 1), '[\p{L}\p{N}]')) AS places,
  strpos(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(passage), '[^\p{L}\p{N}]', '', 'g')) AS found, length(regexp_replace(passage, '[^\p{L}\p{N}]', '', 'g')) AS n FROM q)
SELECT item_id, CASE WHEN found > 0 AND n > 0 THEN places[found] - 1 END::INT AS span_start, CASE WHEN found > 0 AND n > 0 THEN places[found + n - 1] END::INT AS span_end FROM n""")
def f3_locate_span(spark, sf_dir):
    """Each benchmark text's passage from its tenth character on, other marks between its words, found in the text."""
    quote = F.regexp_replace(F.substring("text", 10, 2**31 - 1), " ", " - ")
    rows = read(spark, sf_dir, "benchmark").select("item_id", quote.alias("quote"), "text")
    return answers.located(rows, "quote", "text").select("item_id", "span_start", "span_end")


@query(r"""WITH j AS (SELECT item_id, text, '{"answer_markdown":' || to_json(text) || '}' AS raw FROM benchmark)
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE json_extract_string('"' || regexp_replace(substr(left(raw, length(raw) // 2), 21), '\\$', '') || '"', '$') END AS answer_markdown, item_id % 2 = 1 AS truncated FROM j""")
def f6_salvaged_answers(spark, sf_dir):
    """Every other answer's JSON breaks off in the middle; what stands before is saved."""
    whole = F.to_json(F.struct(F.col("text").alias("answer_markdown")))
    raw = F.when(F.col("item_id") % 2 == 0, whole).otherwise(F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int")))
    return answers.parsed_answers(read(spark, sf_dir, "benchmark").select("item_id", raw.alias("raw"))).select("item_id", "answer_markdown", "truncated")


@query(r"""SELECT conv_id, turn, CASE WHEN turn = 0 OR turn % 5 = 4 THEN 'documents' WHEN length(text) < 80 THEN 'conversation_only' ELSE 'documents_and_conversation' END AS route,
CASE WHEN turn = 0 OR turn % 5 = 4 THEN text WHEN turn % 2 = 1 AND length(trim(text || ' and more of the same thing')) > 1.6 * length(text) THEN text ELSE trim(text || ' and more of the same thing') END AS search_query, turn <> 0 AND turn % 5 = 4 AS fallback, turn = 0 OR turn % 5 = 4 OR length(text) >= 80 AS searches FROM conversations""")
def g1_g2_condense(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("turn") == 0, "").otherwise("earlier").alias("history"), F.when(F.length("text") < 80, "conversation_only").otherwise("documents_and_conversation").alias("route"), F.concat("text", F.lit(" and more of the same thing")).alias("search_query"), (F.col("turn") % 2 == 1).alias("topic_shift"), (F.col("turn") % 5 == 4).alias("failed"))
    return answers.condensed(turns).select("conv_id", "turn", "route", "search_query", "fallback", "searches")


@query(f"""WITH {RECON_SQL} SELECT answer_id, CASE WHEN answer_id % 7 = 3 THEN 'abstained_starved' WHEN answer_id % 7 = 5 THEN 'abstained_no_sources' WHEN answer_id % 11 = 4 THEN 'ungrounded_truncated' WHEN abstained THEN 'abstained' WHEN grounded THEN 'grounded' ELSE 'ungrounded' END AS status FROM rec""")
def g3_answer_status(spark, sf_dir):
    k = F.col("answer_id")
    rows = a18_reconcile_answers(spark, sf_dir).withColumns({"n_ranked": F.when(k % 7 == 5, 0).otherwise(9), "n_delivered": F.when(k % 7 == 3, 0).otherwise(4), "truncated": k % 11 == 4})
    return answers.answer_status(rows).select("answer_id", "status")


@query("SELECT item_id, ('0x' || substr(sha256(item_id || '|5'), 1, 8))::UBIGINT % 2 = 1 AS order_swapped FROM benchmark")
def g7_order_swap(spark, sf_dir):
    return answers.swapped(read(spark, sf_dir, "benchmark").select("item_id"), "item_id", 5)


@query("""SELECT doc_id, '[' || (doc_id + 1) || '] ' || source || CASE WHEN lang = 'fr' AND doc_id > 0 THEN ' | page ' || doc_id ELSE '' END || CASE WHEN lang = 'de' THEN ' | Section: A > B' || chr(10) || '(Read this as a table: each line is one value, row after row.)' WHEN lang = 'es' THEN chr(10) || '(A model wrote this description; the document does not contain it.)' ELSE '' END || chr(10) || sha256(text) AS shown FROM documents""")
def f7_format_source(spark, sf_dir):
    lang = F.col("lang")
    headings = F.when(lang == "de", F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    shown = ids.format_source(F.col("doc_id") + 1, F.col("source"), F.when(lang == "fr", F.col("doc_id")), F.lit(None).cast("int"), headings, F.when(lang == "de", "page_text_clip"), F.when(lang == "es", "model_generated").otherwise("verbatim"), F.sha2("text", 256))
    return read(spark, sf_dir, "documents").select("doc_id", shown.alias("shown"))


# ---- lifecycle, conversations, limits ----------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Present documents (embeddings) and a manifest (labels) over one id space."""
    present = read(spark, sf_dir, "embeddings").select(F.lit("").alias("owner"), F.col("vec_id").cast("string").alias("source_id"), F.when(F.col("vec_id") % 5 == 0, "new").otherwise("same").alias("content_hash"), F.lit("fp2").alias("fingerprint"))
    manifest = read(spark, sf_dir, "labels").select(F.lit("").alias("owner"), F.col("doc_id").cast("string").alias("source_id"), F.lit("same").alias("content_hash"), F.when(F.col("quality") == 0, "fp1").otherwise("fp2").alias("fingerprint"), F.concat(F.lit("Doc "), "doc_id").alias("title"), F.lit("pdf").alias("doc_type"), F.array(F.concat(F.lit("c"), "doc_id")).alias("chunk_ids"), F.array(F.concat(F.lit("p"), "doc_id")).alias("parent_ids"), (F.col("toxic") * 2).cast("long").alias("n_uncontextualized"), F.lit(3).cast("long").alias("n_chunks"))
    return present, manifest


PLAN_SQL = """p AS (SELECT coalesce(e.vec_id, l.doc_id)::VARCHAR AS source_id, CASE WHEN e.vec_id IS NULL THEN 'delete' WHEN l.doc_id IS NULL OR e.vec_id % 5 = 0 OR l.quality = 0 THEN 'reprocess' ELSE 'skip' END AS action,
CASE WHEN e.vec_id IS NULL THEN NULL WHEN l.doc_id IS NULL THEN 'new document' WHEN e.vec_id % 5 = 0 THEN 'content changed' WHEN l.quality = 0 THEN 'pipeline changed (fp1 -> fp2)' END AS reason FROM embeddings e FULL JOIN labels l ON l.doc_id = e.vec_id)"""


@query(f"WITH {PLAN_SQL} SELECT '' AS owner, source_id, action, reason FROM p")
def m1_plan(spark, sf_dir):
    return lifecycle.plan(*snapshots(spark, sf_dir))


@query(f"WITH {PLAN_SQL} SELECT source_id FROM p WHERE action = 'reprocess'")
def m9_reprocess(spark, sf_dir):
    present, manifest = snapshots(spark, sf_dir)
    return lifecycle.to_reprocess(present, lifecycle.plan(present, manifest)).select("source_id")


@query(f"WITH {PLAN_SQL} SELECT source_id, 'Doc ' || source_id AS title, 1 AS n_chunks FROM p WHERE action = 'delete'")
def m2_tombstones(spark, sf_dir):
    present, manifest = snapshots(spark, sf_dir)
    gone = lifecycle.plan(present, manifest).filter("action = 'delete'")
    return lifecycle.tombstones(gone, manifest, F.lit("2024-01-01").cast("timestamp")).select("source_id", "title", "n_chunks")


@query(f"WITH {PLAN_SQL} SELECT doc_id::VARCHAR AS source_id FROM labels WHERE doc_id::VARCHAR NOT IN (SELECT source_id FROM p WHERE action = 'delete')")
def m3_purge(spark, sf_dir):
    present, manifest = snapshots(spark, sf_dir)
    gone = lifecycle.plan(present, manifest).filter("action = 'delete'")
    return lifecycle.purge({"manifest": manifest}, gone)["manifest"].select("source_id")


@query(f"""WITH {PLAN_SQL}, a AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE 'p' END || doc_id AS chunk_id, doc_id FROM documents)
SELECT chunk_id, CASE WHEN e.vec_id IS NOT NULL AND a.doc_id % 2 = 0 THEN 200 WHEN p.source_id IS NOT NULL THEN 410 ELSE 404 END AS status, CASE WHEN e.vec_id IS NOT NULL AND a.doc_id % 2 = 0 THEN e.vec_id::VARCHAR ELSE p.source_id END AS source_id
FROM a LEFT JOIN embeddings e ON e.vec_id = a.doc_id LEFT JOIN p ON p.source_id = a.doc_id::VARCHAR AND p.action = 'delete'""")
def m13_open_citation(spark, sf_dir):
    present, manifest = snapshots(spark, sf_dir)
    gone = lifecycle.plan(present, manifest).filter("action = 'delete'")
    graves = lifecycle.tombstones(gone, manifest, F.lit("2024-01-01").cast("timestamp"))
    asked = read(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "c").otherwise("p"), F.col("doc_id")).alias("chunk_id"))
    live = present.select(F.concat(F.lit("c"), "source_id").alias("chunk_id"), "source_id", F.lit("text").alias("display_text"))
    return lifecycle.open_citation(asked, live, graves).select("chunk_id", "status", "source_id")


@query("SELECT sum(toxic * 2)::BIGINT AS n_without, (count(*) * 3)::BIGINT AS n_chunks, sum(toxic * 2) > 0 AND sum(toxic * 2) < count(*) * 3 AS mixed FROM labels")
def a17_mixed_provenance(spark, sf_dir):
    return lifecycle.mixed_provenance(snapshots(spark, sf_dir)[1])


@query("SELECT doc_id::VARCHAR AS source_id, CASE WHEN toxic = 1 THEN 'SEARCHABLE_INCOMPLETE' ELSE 'READY' END AS state FROM labels")
def m11_visible_documents(spark, sf_dir):
    manifest = snapshots(spark, sf_dir)[1].withColumn("contextual", F.lit(True))
    return lifecycle.visible_documents(manifest, None).select("source_id", "state")


@query("SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events))::BIGINT - epoch(ts)::BIGINT > 864000")
def m5_expired_sessions(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    return lifecycle.expired(events, events.agg(F.max("created_at")).scalar(), 864_000).select("event_id")


def sample_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations")
    sources = F.transform(F.slice(F.split("text", " "), 1, 4), lambda w: F.struct(w.alias("source_id")))
    return talk.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), "role", "text", sources.alias("sources"), F.when(F.col("role") == "user", "fp1").when(F.col("role") == "system", "").otherwise("fp2").alias("pipeline_fingerprint"))


CITED_SQL = "i AS (SELECT DISTINCT unnest(string_split(text, ' ')[1:4]) AS source_id, conv_id AS conversation_id, turn AS turn_index, CASE role WHEN 'user' THEN 'fp1' WHEN 'system' THEN '' ELSE 'fp2' END AS fp FROM conversations)"


@query(f"WITH {CITED_SQL} SELECT source_id, conversation_id, turn_index, fp AS pipeline_fingerprint FROM i WHERE source_id <> ''")
def m6_citation_index(spark, sf_dir):
    return lifecycle.citation_index(sample_turns(spark, sf_dir))


@query(f"WITH {CITED_SQL} SELECT source_id, conversation_id, count(*) AS n_turns, count(*) FILTER (fp = 'fp1') AS n_stale FROM i WHERE source_id <> '' GROUP BY ALL")
def a21_m7_impact(spark, sf_dir):
    return lifecycle.impact(lifecycle.citation_index(sample_turns(spark, sf_dir)), "fp2")


@query("SELECT conv_id AS conversation_id, turn AS turn_index, coalesce(len(h), 0)::INT AS n, sha256(coalesce(array_to_string(h, chr(1)), '')) AS history FROM (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM conversations)")
def w6_history(spark, sf_dir):
    rows = lifecycle.history(sample_turns(spark, sf_dir))
    return rows.select("conversation_id", "turn_index", F.size("history").alias("n"), F.sha2(F.array_join("history", "\x01"), 256).alias("history"))


@query("""WITH r AS (SELECT conv_id, length(text) < 80 AS alone, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT conv_id, max(n) AS turns, count(*) FILTER (alone) AS k, avg(alone::INT) AS s, avg(alone::INT) FILTER (pos < n // 2) AS a, avg(alone::INT) FILTER (pos >= n // 2) AS b FROM r GROUP BY conv_id)
SELECT conv_id AS conversation_id, turns, k AS conversation_only, round(s, 3) AS share, round(a, 3) AS first_half, round(b, 3) AS second_half, turns >= 6 AS sufficient, turns >= 6 AND b > a + 0.25 AS drifting FROM a""")
def w7_route_drift(spark, sf_dir):
    route = F.when(F.length("text") < 80, "conversation_only").otherwise("documents")
    return lifecycle.drift(sample_turns(spark, sf_dir).withColumn("route", route))


@query("SELECT conv_id AS conversation_id, coalesce(left(trim(arg_min(text, turn) FILTER (role = 'user')), 60), '') AS title, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_questions FROM conversations GROUP BY conv_id")
def m12_summaries(spark, sf_dir):
    return lifecycle.summaries(sample_turns(spark, sf_dir))


FEEDBACK_SQL = "fb AS (SELECT event_id, ['structure_inferred', 'found_not_quoted', 'quoted', NULL][1 + user_id % 4] AS evidence_kind, ['source_is_fine', 'not_in_source', 'source_doesnt_say'][1 + event_id % 3] AS verdict, CASE WHEN user_id % 4 = 2 THEN 'verified' ELSE 'absent' END AS quote_status FROM events)"


def sample_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("structure_inferred"), F.lit("found_not_quoted"), F.lit("quoted"), F.lit(None).cast("string"))
    verdicts = F.array(*map(F.lit, ("source_is_fine", "not_in_source", "source_doesnt_say")))
    return read(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("user_id") % 4).cast("int")).alias("evidence_kind"), F.get(verdicts, (F.col("event_id") % 3).cast("int")).alias("verdict"), F.when(F.col("user_id") % 4 == 2, "verified").otherwise("absent").alias("quote_status"), F.concat(F.when(F.col("event_id") % 2 == 0, "c").otherwise("p"), F.col("event_id").cast("string")).alias("chunk_id"))


@query(f"WITH {FEEDBACK_SQL} SELECT coalesce(evidence_kind, 'unknown') AS evidence_kind, count(*) FILTER (verdict = 'source_is_fine') AS source_is_fine, count(*) FILTER (verdict = 'not_in_source') AS not_in_source, count(*) FILTER (verdict = 'source_doesnt_say') AS source_doesnt_say FROM fb GROUP BY 1")
def a10_feedback_matrix(spark, sf_dir):
    return lifecycle.feedback_matrix(sample_feedback(spark, sf_dir), ["source_is_fine", "not_in_source", "source_doesnt_say"])


@query(f"""WITH {FEEDBACK_SQL}, r AS (SELECT 'table_detector_false_positives' AS name, count(*) FILTER (evidence_kind = 'structure_inferred') AS n, count(*) FILTER (evidence_kind = 'structure_inferred' AND verdict = 'source_is_fine') AS hits FROM fb
UNION ALL SELECT 'declined_but_fine', count(*) FILTER (evidence_kind = 'found_not_quoted'), count(*) FILTER (evidence_kind = 'found_not_quoted' AND verdict = 'source_is_fine') FROM fb
UNION ALL SELECT 'verified_but_wrong', count(*) FILTER (quote_status = 'verified'), count(*) FILTER (quote_status = 'verified' AND verdict <> 'source_is_fine') FROM fb)
SELECT name, n, hits, CASE WHEN n >= 10 THEN round(hits / n, 3) END AS rate, CASE WHEN n = 0 THEN 'no flags' WHEN n < 10 THEN hits || ' of ' || n ELSE hits || '/' || n || ' = ' || round(100 * (hits / n))::BIGINT || '%' END AS label FROM r""")
def a10_feedback_rates(spark, sf_dir):
    return lifecycle.feedback_rates(sample_feedback(spark, sf_dir))


@query(f"""WITH {PLAN_SQL} SELECT e.event_id, CASE WHEN d.doc_id IS NOT NULL AND e.event_id % 2 = 0 THEN d.lang END AS chunk_text_source, p.source_id IS NOT NULL AS removed FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id LEFT JOIN p ON p.source_id = e.event_id::VARCHAR AND p.action = 'delete'""")
def m14_enrich_feedback(spark, sf_dir):
    present, manifest = snapshots(spark, sf_dir)
    graves = lifecycle.tombstones(lifecycle.plan(present, manifest).filter("action = 'delete'"), manifest, F.lit("2024-01-01").cast("timestamp"))
    chunks = read(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), F.col("lang").alias("text_source"), F.lit("verbatim").alias("text_provenance"))
    return lifecycle.enrich_feedback(sample_feedback(spark, sf_dir), chunks, graves).select("event_id", "chunk_text_source", "removed")


@query("""WITH d AS (SELECT event_type AS stage, CASE WHEN value < 0.5 THEN 'quota' ELSE 'empty' END AS cause FROM events WHERE value < 1), a AS (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1)
SELECT d.stage, cause, count(*) AS n, any_value(a.n) AS attempted FROM d JOIN a ON a.stage = d.stage GROUP BY d.stage, cause""")
def a15_degradations(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumnRenamed("event_type", "stage")
    failed = events.filter("value < 1").withColumn("cause", F.when(F.col("value") < 0.5, "quota").otherwise("empty"))
    return lifecycle.degradations(failed, events.groupBy("stage").agg(F.count("*").alias("n")))


@query("""WITH o AS (SELECT ts::DATE AS day, event_type AS stage, floor(value * 10)::BIGINT AS tokens FROM events), l AS (SELECT DISTINCT day FROM o ORDER BY day DESC LIMIT 30)
SELECT day, stage, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM o JOIN l USING (day) GROUP BY GROUPING SETS ((day, stage), (day))""")
def a16_spend(spark, sf_dir):
    return lifecycle.spend(operations(spark, sf_dir))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("stage"), F.floor(F.col("value") * 10).cast("long").alias("tokens"), F.col("event_id").alias("seq"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def t2_daily_counts(spark, sf_dir):
    return limits.daily_counts(read(spark, sf_dir, "events"))


@query("""WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS client, epoch_us(ts::TIMESTAMP) / 1e6 AS moment, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts::TIMESTAMP, event_id) AS k FROM events),
s AS (SELECT DISTINCT client, 0::BIGINT AS k, []::DOUBLE[] AS log, NULL::BIGINT AS request_id, false AS admitted FROM r
  UNION ALL
  SELECT client, k, CASE WHEN len(held) < 3 THEN list_append(held, moment) ELSE held END, request_id, len(held) < 3
  FROM (SELECT r.client, r.k, r.moment, r.request_id, list_filter(s.log, lambda x: r.moment - x <= 432000) AS held FROM s JOIN r ON r.client = s.client AND r.k = s.k + 1))
SELECT client, request_id, admitted FROM s WHERE k > 0""")
def t1_rate_limit(spark, sf_dir):
    requests = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"), F.col("event_id").alias("request_id"))
    requests = requests.select("client", (F.col("micros") / 1e6).alias("at"), "request_id")
    return limits.limited(requests, most=3, seconds=5 * 86_400).select("client", "request_id", "admitted")


@query("""WITH RECURSIVE o AS (SELECT ts::DATE AS day, event_id AS seq, floor(value * 10)::BIGINT AS tokens, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT day, 0::BIGINT AS k, 0::BIGINT AS spent, NULL::BIGINT AS seq, false AS admitted FROM o
  UNION ALL
  SELECT o.day, o.k, s.spent + CASE WHEN tokens + 5 <= 900 AND s.spent + tokens + 5 <= 5000 THEN tokens ELSE 0 END, o.seq, tokens + 5 <= 900 AND s.spent + tokens + 5 <= 5000 FROM s JOIN o ON o.day = s.day AND o.k = s.k + 1)
SELECT day, seq, admitted FROM s WHERE k > 0""")
def t3_daily_cap(spark, sf_dir):
    rows = operations(spark, sf_dir).select("day", "seq", (F.col("tokens") + 5).alias("estimated_tokens"), F.col("tokens").alias("actual_tokens"))
    return limits.capped(rows, daily=5000, single=900).select("day", "seq", "admitted")


@query("""WITH d AS (SELECT avg(quality) AS quality, avg(toxic) AS toxic, count(*) AS n FROM labels)
SELECT 'more_labels' AS decision, 'n >= 300' AS condition, n >= 300 AS expired FROM d UNION ALL SELECT 'entailment', 'toxic > 0.9', toxic > 0.9 FROM d""")
def e16_deferrals(spark, sf_dir):
    row = read(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("n"))
    return invariants.deferrals(row, {"more_labels": "n >= 300", "entailment": "toxic > 0.9"})


@query("""WITH p AS (SELECT count(*) FILTER (vec_id IS NULL) + count(*) FILTER (doc_id IS NULL) AS bad, count(*) FILTER (doc_id IS NOT NULL) AS n FROM documents FULL JOIN embeddings ON vec_id = doc_id)
SELECT 'index_parity' AS name, bad::VARCHAR AS observed, CASE WHEN bad = 0 THEN 'HOLDS' ELSE 'FAILS' END AS state, n FROM p
UNION ALL SELECT 'no_orphans', '0', 'HOLDS', count(*) FROM documents UNION ALL SELECT 'uniform_provenance', '1', 'HOLDS', count(*) FROM documents
UNION ALL SELECT 'ownership', count(*) FILTER (lang = 'es')::VARCHAR, CASE WHEN count(*) FILTER (lang = 'es') = 0 THEN 'HOLDS' ELSE 'FAILS' END, count(*) FROM documents""")
def e10_index_checks(spark, sf_dir):
    children = child_chunks(spark, sf_dir).withColumns({"text_provenance": F.lit("verbatim"), "has_contextual_prefix": F.lit(False), "origin": F.lit("corpus")})
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return invariants.index_checks(children, vectors, children.select("parent_id").distinct()).select("name", "observed", "state", "n")


@query(f"{SPARSE_HITS_SQL}, {CHILD_FILL_SQL.format(hits='sparse')} SELECT 'budget_respected' AS name, coalesce(max(spent), 0)::BIGINT::VARCHAR AS observed, 'HOLDS' AS state, count(DISTINCT query_id) AS n FROM run WHERE spent <= 1500")
def e10_budget_check(spark, sf_dir):
    filled = retrieval.fill(retrieval.costed(sparse_hits(spark, sf_dir), child_chunks(spark, sf_dir)), 1500)
    return invariants.budget_check(filled, 1500).select("name", "observed", "state", "n")


@query(f"""{FUSED_SQL}, costed AS (SELECT r.query_id, r.rank, 'parent:' || c.parent_id AS target, {COST_SQL.format(c="c.text")} AS t FROM rrf r JOIN chunks c ON c.chunk_id = r.chunk_id),
parents AS (SELECT parent_id, greatest(1, length(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id), '')) // 4) AS tokens FROM chunks GROUP BY parent_id),
priced AS (SELECT query_id, rank, target, CASE WHEN row_number() OVER (PARTITION BY query_id, target ORDER BY rank) = 1 THEN tokens ELSE 0 END AS cost FROM costed JOIN parents ON target = 'parent:' || parent_id),
run AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM priced WHERE rank < 200),
best AS (SELECT query_id, target, min(rank) AS child_rank FROM run WHERE spent <= 12000 GROUP BY ALL)
SELECT * FROM (SELECT query_id, target, child_rank::INT AS child_rank, row_number() OVER (PARTITION BY query_id ORDER BY child_rank)::INT AS label FROM best) WHERE label <= 6""")
def r20_retrieve(spark, sf_dir):
    """The flagship: fused ranking, parents charged once, strict budget, six sources at most."""
    chunks = all_chunks(spark, sf_dir)
    queries = vector_queries(chunks)
    texts = child_chunks(spark, sf_dir)
    found = ask.retrieve(queries, chunks, parent_costs(texts), text_index(texts, queries), mode="rrf")
    return found.select("query_id", "target", "child_rank", "label")


ISOLATION_SQL = f"""WITH chunks AS (SELECT doc_id AS chunk_id, text, CASE doc_id % 97 WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE '' END AS owner FROM documents),
vchunks AS (SELECT c.*, list_transform(e.embedding, lambda x: x::DOUBLE) AS vec FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id),
who AS (SELECT * FROM (VALUES (0, 'cross_session', 'a'), (1, 'public', NULL), (2, 'own', 'b')) t(k, who, caller)),
vq AS (SELECT 3 * chunk_id + k AS query_id, vec AS qvec, text AS query_text, caller FROM vchunks, who WHERE owner = 'b'),
{DENSE_SQL}, {index_sql()}, {sparse_sql('vq')}, {RRF_SQL},
hits AS (SELECT 'dense' AS mode, query_id, chunk_id FROM dense UNION ALL SELECT 'sparse', query_id, chunk_id FROM sparse UNION ALL SELECT 'rrf', query_id, chunk_id FROM rrf),
seen AS (SELECT k, who, m.mode, count(h.query_id) AS n, count(*) FILTER (c.owner = 'b') AS seen FROM who CROSS JOIN (VALUES ('dense'), ('sparse'), ('rrf')) m(mode)
  LEFT JOIN hits h ON h.mode = m.mode AND h.query_id % 3 = k LEFT JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY ALL)
SELECT 'isolation_' || who || '_' || mode AS name, CASE WHEN k = 2 THEN 'own chunks are found' ELSE 'no chunk of another owner' END AS rule, seen::VARCHAR AS observed,
  CASE WHEN n = 0 THEN 'NOT_MEASURED' WHEN CASE WHEN k = 2 THEN seen > 0 ELSE seen = 0 END THEN 'HOLDS' ELSE 'FAILS' END AS state, n, '' AS fingerprint FROM seen"""


@query(ISOLATION_SQL)
def e12_isolation(spark, sf_dir):
    owner = F.when(F.col("chunk_id") % 97 == 1, "b").when(F.col("chunk_id") % 97 == 2, "a").otherwise("")
    probes = child_chunks(spark, sf_dir).select("chunk_id", "text", owner.alias("owner"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    asked = probes.filter(F.col("owner") == "b").join(vectors.filter("vec IS NOT NULL"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query_text"), F.lit(None).cast("string").alias("caller"))
    return invariants.isolation_checks(probes, vectors, text_index(probes, asked), "a", "b")


@query()
def e5_scored_both_units(spark, sf_dir):
    """Children and their section parents as chunked, each scored by its own text."""
    chunks, parents = section_chunks(spark, sf_dir)
    queries = text_queries(spark, sf_dir)
    ranked = retrieval.sparse(queries, *text_index(chunks, queries), counted=False)
    accept = needle_hits(spark, sf_dir).groupBy("item_id").agg(F.collect_set("source_id").alias("accept"))
    items = needles(spark, sf_dir).join(accept, "item_id", "left")
    return evaluate.run(items, ranked, chunks, parents)


@query("SELECT conv_id AS conversation_id, max(turn) AS turn_index, sha256(max_by(text, turn)) AS text FROM conversations GROUP BY conv_id")
def w9_latest_turn(spark, sf_dir):
    rows = lifecycle.latest_of_each(sample_turns(spark, sf_dir), "conversation_id", "turn_index")
    return rows.select("conversation_id", "turn_index", F.sha2("text", 256).alias("text"))


@query(f"""{SCORE_SQL}, arms AS (SELECT 'context' AS arm, item_id, strict FROM scored UNION ALL SELECT 'plain', item_id, partial FROM scored)
SELECT 'delivered' AS basis, 1500 AS budget, count(*) FILTER (arm = 'context' AND strict) AS context_hits, count(*) FILTER (arm = 'context') AS context_n, count(*) FILTER (arm = 'plain' AND strict) AS plain_hits, count(*) FILTER (arm = 'plain') AS plain_n FROM arms""")
def a20_ab_grid(spark, sf_dir):
    scored = write_shared(scored_items(spark, sf_dir), "scored")
    arms = [scored.select(F.lit(arm).alias("arm"), F.lit(print_).alias("fingerprint"), F.lit("delivered").alias("basis"), F.lit(1500).alias("budget"), F.col(c).alias("strict")) for arm, print_, c in (("context", "f1", "strict"), ("plain", "f2", "partial"))]
    return evaluation.ab_grid(arms[0].unionByName(arms[1]), "context", "plain")


@query("""WITH v AS (SELECT list_transform(embedding[1:16], lambda x: x::DOUBLE) AS s FROM embeddings), c AS (SELECT list_dot_product(s, s) / greatest(sqrt(list_dot_product(s, s)), 1e-12) / greatest(sqrt(list_dot_product(s, s)), 1e-12) AS c FROM v)
SELECT count(*) AS n, round(min(c), 9) AS least_cosine, min(c) > 0.999 AS equivalent FROM c""")
def g16_truncation_equivalence(spark, sf_dir):
    pairs = read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("long"), F.slice("embedding", 1, 16).alias("short"))
    return index.truncation_equivalence(pairs, 16)


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'failed' ELSE event_type END AS state FROM events")
def t5_interrupted_jobs(spark, sf_dir):
    kind = F.col("event_type")
    jobs = read(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "queued").when(kind == "view", "running").otherwise(kind).alias("state"), F.lit(None).cast("string").alias("error"))
    return lifecycle.interrupted(jobs).select("event_id", "state")


# ---- injected models, uploads, stored tables: the models are deterministic stand-ins --------------------


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with one key a turn."""
    return read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


TALK_SQL = "talk AS (SELECT *, conv_id || '-' || turn AS key FROM conversations)"


@query(f"WITH {TALK_SQL} SELECT key AS chunk_id, CASE WHEN text IN (SELECT text FROM talk WHERE role = 'user') THEN 0.6 ELSE round(length(text) / sqrt(length(text) * length(text) + 1), 9) END AS x, text NOT IN (SELECT text FROM talk WHERE role = 'user') AS made FROM talk")
def r23_embed(spark, sf_dir):
    """Vectors of turns; those of user texts are cached, and no cached text reaches the model."""
    chunks = talk(spark, sf_dir).select(F.col("key").alias("chunk_id"), F.col("text").alias("embed_text"), F.lit("child").alias("role"), F.col("role").alias("speaker"))
    keys = ids.cache_key(F.lit("1"), F.lit("lengths"), F.lit("2"), F.lit("document"), F.sha2("embed_text", 256))
    cache = chunks.filter("speaker = 'user'").select(keys.alias("cache_key"), F.array(F.lit(3.0), F.lit(4.0)).alias("value")).dropDuplicates(["cache_key"])
    vectors, made = ingest.embed(chunks, cache, lambda texts: [[float(len(t)), 1.0] for t in texts], name="lengths", dim=2)
    known = chunks.select("chunk_id", keys.alias("cache_key")).join(made.select("cache_key", F.lit(True).alias("made")), "cache_key", "left")
    return vectors.join(known, "chunk_id").select("chunk_id", F.round(F.get("vec", F.lit(0)), 9).alias("x"), F.coalesce("made", F.lit(False)).alias("made"))


@query(f"""WITH {TALK_SQL} SELECT key AS chunk_id, CASE WHEN role = 'user' THEN 'cached' WHEN length(text) % 7 = 0 THEN '' ELSE 'on ' || conv_id || ': ' || length(text) END AS context,
key IN (SELECT key FROM talk WHERE role <> 'user' AND length(text) % 7 <> 0) AS made FROM talk""")
def c11_situated(spark, sf_dir):
    """A sentence a child from its synopsis and body; calls that fail leave none and are not cached."""

    def situate(synopsis: str, parent: str, body: str) -> str:
        if len(body) % 7 == 0:
            raise ValueError("no answer")
        return f"{synopsis}: {len(body)}"

    children = talk(spark, sf_dir).select(F.col("key").alias("chunk_id"), F.concat(F.lit("on "), F.col("conv_id").cast("string")).alias("synopsis"), F.col("key").alias("parent_text"), F.col("text").alias("display_text"), "role")
    cache = children.filter("role = 'user'").select(ids.cache_key(F.col("synopsis"), F.col("parent_text"), F.col("display_text")).alias("cache_key"), F.lit("cached").alias("value"))
    placed, made = chunking.contextualize(children, situate, cache)
    return placed.join(made.select("cache_key", F.lit(True).alias("made")), "cache_key", "left").select("chunk_id", "context", F.coalesce("made", F.lit(False)).alias("made"))


@query(f"WITH {TALK_SQL} SELECT key, 'count' AS stage, 'has ' || length(text) AS text, greatest(1, length(text) // 4)::BIGINT AS prompt_tokens, greatest(1, length('has ' || length(text)) // 4)::BIGINT AS text_tokens FROM talk")
def g10_generated(spark, sf_dir):
    prompts = talk(spark, sf_dir).select("key", F.col("text").alias("prompt"))
    return answers.generated(prompts, lambda p: f"has {len(p)}", "count")


@query(f"""WITH {TALK_SQL}, h AS (SELECT key, text, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM talk)
SELECT key, 'read ' || length('Conversation so far:' || chr(10) || history || chr(10) || chr(10) || 'Question: ' || text) AS text, 'conversation' AS source, 'not_applicable' AS verification FROM h""")
def g4_from_conversation(spark, sf_dir):
    turns = lifecycle.history(talk(spark, sf_dir).select("key", F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turn_index"), "text"))
    return answers.from_conversation(turns.select("key", "history", F.col("text").alias("question")), lambda p: f"read {len(p)}")


@query("""SELECT page_id AS image_id, CASE WHEN page_id % 5 = 0 THEN 'seen before' WHEN octet_length(encode(html)) % 3 <> 0 THEN octet_length(encode(html)) || ' bytes' END AS caption FROM pages""")
def g11_captioned(spark, sf_dir):
    """Captions of pages taken as images; a third has none, a fifth is cached under its hash and context."""
    images = read(spark, sf_dir, "pages").select(F.col("page_id").alias("image_id"), F.encode("html", "UTF-8").alias("content"), F.col("url").alias("context"))
    cache = images.filter("image_id % 5 = 0").select(ids.cache_key(F.sha2("content", 256), F.col("context")).alias("cache_key"), F.lit("seen before").alias("value"))
    shown, _ = answers.captioned(images, cache, lambda raw: f"{len(raw)} bytes" if len(raw) % 3 else None)
    return shown.select("image_id", "caption")


@query("""WITH s AS (SELECT item_id, ('0x' || substr(sha256(item_id || '|7'), 1, 8))::BIGINT % 2 = 1 AS order_swapped, substr(text, 1, 1) AS a, right(text, 1) AS b FROM benchmark)
SELECT item_id::VARCHAR AS item_id, CASE WHEN order_swapped THEN b ELSE a END AS faithfulness, order_swapped FROM s""")
def g13_judged(spark, sf_dir):
    """A judge that names the first source it sees shows the recorded order."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.array(F.substring("text", 1, 1), F.right("text", F.lit(1))).alias("sources"))
    return answers.judged(answers.swapped(items, "item_id", 7), lambda question, answer, sources: sources[0], "judge", "generator")


VERDICTS_SQL = "v AS (SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END AS verdict, lang = 'es' AS failed FROM documents)"


def sample_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") % 2 == 0, 1).otherwise(0).alias("verdict"), (F.col("lang") == "es").alias("failed"))


@query(f"WITH {VERDICTS_SQL} SELECT l.doc_id, l.quality AS label, verdict FROM labels l JOIN v ON v.doc_id = l.doc_id AND NOT failed")
def j8_labels_and_verdicts(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return evaluation.rated(labels, sample_verdicts(spark, sf_dir), "doc_id")


@query(f"WITH {VERDICTS_SQL} SELECT vec_id AS doc_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM v WHERE NOT failed AND doc_id % 3 = 0)")
def j12_unjudged(spark, sf_dir):
    items = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return evaluation.unjudged(items, sample_verdicts(spark, sf_dir).filter("doc_id % 3 = 0"), "doc_id")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::INT AS q FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey AS k, l_linenumber AS ordinal, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step, 'total' || (q % 5) || 'price' || (q % 3) AS text FROM l),
c AS (SELECT l_orderkey AS k, list({'no': l_linenumber, 'total': 'total' || (l_linenumber % 5), 'price': 'price' || (l_linenumber % 3)} ORDER BY l_linenumber) AS free FROM l GROUP BY l_orderkey),
s AS (SELECT k, 0::BIGINT AS step, free, 0::BIGINT AS ordinal, NULL::BIGINT AS hit FROM c
  UNION ALL
  SELECT k, step, list_filter(free, lambda x: hit IS NULL OR x.no <> hit), ordinal, hit
  FROM (SELECT b.k, b.step, s.free, b.ordinal, (list_filter(s.free, lambda x: contains(b.text, x.total) AND contains(b.text, x.price))[1]).no AS hit FROM s JOIN b ON b.k = s.k AND b.step = s.step + 1))
SELECT k::VARCHAR AS source_id, 1 AS page, ordinal::INT AS ordinal, hit::INT AS table_no FROM s WHERE step > 0 AND hit IS NOT NULL""")
def d7_matched_tables(spark, sf_dir):
    """Blocks take the first free candidate whose two probes they hold, in the order of their page."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("source_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("n")).agg(F.max("l_quantity").cast("int").alias("q"))
    blocks = lines.select("source_id", "page", F.col("n").alias("ordinal"), F.concat(F.lit("Total "), (F.col("q") % 5).cast("string"), F.lit(" | Price "), (F.col("q") % 3).cast("string")).alias("text"))
    offered = lines.select("source_id", "page", F.col("n").alias("table_no"), F.array(F.concat(F.lit("TOTAL-"), (F.col("n") % 5).cast("string")), F.lit("no"), F.concat(F.lit("Price "), (F.col("n") % 3).cast("string"))).alias("first_row"))
    return tables.matched(blocks, offered)


@query("""WITH k AS (SELECT page_id, page_id % 6 AS k FROM pages)
SELECT page_id || CASE k WHEN 3 THEN '.png' WHEN 4 THEN '.docx' ELSE '.pdf' END AS path, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'active_content' WHEN 2 THEN 'encrypted' WHEN 3 THEN 'too_many_pixels' WHEN 4 THEN 'unreadable' ELSE 'unknown_type' END AS code, k = 0 AS accepted FROM k""")
def d11_d12_upload_gate(spark, sf_dir):
    """Pages as uploads: behind a PDF's, an image's or an archive's first bytes, or bare."""
    k, html = F.col("page_id") % 6, F.encode("html", "UTF-8")
    pdf = [F.concat(F.encode(F.lit(head), "UTF-8"), html) for head in ("%PDF-1.7 ", "%PDF-1.7 /OpenAction ", "%PDF-1.7 /Encrypt ")]
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000FFFF0000FFFF")), html)
    content = F.when(k == 0, pdf[0]).when(k == 1, pdf[1]).when(k == 2, pdf[2]).when(k == 3, png).when(k == 4, F.concat(F.unhex(F.lit("504B0304")), html)).otherwise(html)
    name = F.concat(F.col("page_id").cast("string"), F.when(k == 3, ".png").when(k == 4, ".docx").otherwise(".pdf"))
    return uploads.gated(read(spark, sf_dir, "pages").select(name.alias("path"), content.alias("content"))).select("path", "code", "accepted")


@query("SELECT doc_id AS chunk_id, 'fp' AS pipeline_fingerprint, 'corpus' AS origin FROM documents UNION ALL SELECT page_id, 'fp', 'upload' FROM pages")
def m4_appended(spark, sf_dir):
    held = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("fp").alias("pipeline_fingerprint"), F.lit("corpus").alias("origin"))
    new = read(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.lit("fp").alias("pipeline_fingerprint"), F.lit("upload").alias("origin"))
    return lifecycle.appended(held, new, "fp")


@query(f"""WITH {PLAN_SQL}, new AS (SELECT DISTINCT item_id::VARCHAR AS source_id FROM benchmark), old AS (SELECT doc_id::VARCHAR AS source_id FROM labels)
SELECT 'manifest' AS kept_in, source_id, 'Doc ' || source_id AS title FROM old WHERE source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT 'manifest', source_id, 'Again' FROM new
UNION ALL SELECT 'tombstones', source_id, 'Doc ' || source_id FROM p WHERE action = 'delete' AND source_id NOT IN (SELECT source_id FROM new)""")
def m10_recorded(spark, sf_dir):
    """Sources that come back replace their manifest row and leave the tombstones."""
    present, manifest = snapshots(spark, sf_dir)
    graves = lifecycle.tombstones(lifecycle.plan(present, manifest).filter("action = 'delete'"), manifest, F.lit("2024-01-01").cast("timestamp"))
    new = read(spark, sf_dir, "benchmark").select(F.lit("").alias("owner"), F.col("item_id").cast("string").alias("source_id"), F.lit("Again").alias("title"))
    kept, left = lifecycle.record(manifest.select("owner", "source_id", "title"), graves.select("owner", "source_id", "title"), new)
    return kept.select(F.lit("manifest").alias("kept_in"), "source_id", "title").unionByName(left.select(F.lit("tombstones").alias("kept_in"), "source_id", "title"))


CONVERSATIONS_SQL = "c AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS owner FROM conversations GROUP BY conv_id)"


def sample_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b").alias("owner"), F.lit(0).alias("created_at")).distinct()


@query(f"WITH {CONVERSATIONS_SQL} SELECT conv_id AS conversation_id, owner FROM c UNION ALL SELECT item_id, 'new' FROM benchmark WHERE item_id NOT IN (SELECT conv_id FROM c)")
def m12_opened(spark, sf_dir):
    new = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conversation_id"), F.lit("new").alias("owner"), F.lit(1).alias("created_at"))
    return lifecycle.opened(sample_conversations(spark, sf_dir), new).select("conversation_id", "owner")


@query(f"WITH {CONVERSATIONS_SQL} SELECT conv_id AS conversation_id, turn AS turn_index FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM c WHERE owner = 'a' AND conv_id % 3 = 0)")
def m12_closed(spark, sf_dir):
    """A caller deletes every third conversation, but only their own go."""
    held = sample_conversations(spark, sf_dir)
    asked = held.filter("conversation_id % 3 = 0").select("conversation_id", F.lit("a").alias("owner"))
    return lifecycle.closed(held, sample_turns(spark, sf_dir).select("conversation_id", "turn_index"), asked)[1]


@query("""SELECT 'labels' AS section, '{"quality":' || quality || ',"n":' || count(*) || '}' AS row FROM labels GROUP BY quality
UNION ALL SELECT 'stages', '{"stage":"' || event_type || '","n":' || count(*) || '}' FROM events GROUP BY event_type""")
def m15_inspector(spark, sf_dir):
    """Two stored tables are shown; judged rates stay hidden, as the gate does not hold."""
    label_counts = read(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    stages = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    gate = spark.range(1).select(F.lit(False).alias("may_emit"))
    return evaluate.inspector({"labels": label_counts, "stages": stages, "judged": label_counts}, gate, ("judged",))


@query("""SELECT 'round_trip_' || name AS name, bad::VARCHAR AS observed, CASE WHEN n = 0 THEN 'NOT_MEASURED' WHEN bad = 0 THEN 'HOLDS' ELSE 'FAILS' END AS state, n FROM (
  SELECT 'labels' AS name, count(*) FILTER (l.doc_id IS NULL OR d.doc_id IS NULL) AS bad, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id
  UNION ALL SELECT 'orders', count(*) FILTER (o.k IS NULL OR l.k IS NULL), count(*) FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k)""")
def e15_round_trips(spark, sf_dir):
    docs, marked = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    orders, lines = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    parts = [invariants.round_trip_check(marked, docs, ["doc_id"], "round_trip_labels", "labels name documents"), invariants.round_trip_check(orders, lines, ["k"], "round_trip_orders", "orders have lines")]
    return parts[0].unionByName(parts[1]).select("name", "observed", "state", "n")


@query("SELECT event_type AS metric, round(avg((value > 50)::INT), 6) AS rate, count(*) AS n, 'fp' AS fingerprint FROM events GROUP BY 1")
def e9_baseline(spark, sf_dir):
    current = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("rate"), F.count("*").alias("n"))
    chunks = child_chunks(spark, sf_dir).select(F.lit("fp").alias("pipeline_fingerprint"), F.lit("child").alias("role"), F.lit("prefixed").alias("text_provenance"), F.lit(True).alias("has_contextual_prefix"))
    return evaluation.baseline(current, chunks)


@query("SELECT 'artifact_' || name AS name, coalesce(n::VARCHAR, 'absent') AS observed, CASE WHEN n IS NULL THEN 'NOT_MEASURED' WHEN n > 0 THEN 'HOLDS' ELSE 'FAILS' END AS state FROM (SELECT 'labels' AS name, count(*) AS n FROM labels UNION ALL SELECT 'pages', count(*) FROM pages WHERE page_id < 0 UNION ALL SELECT 'kappa', NULL)")
def e14_artifacts(spark, sf_dir):
    counts = [read(spark, sf_dir, name).filter(keep).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, keep in (("labels", "true"), ("pages", "page_id < 0"))]
    return invariants.artifact_checks(counts[0].unionByName(counts[1]), ["labels", "pages", "kappa"]).select("name", "observed", "state")


@query("SELECT doc_id, quality, 'fp' AS fingerprint, 'p1' AS parser, 'c1' AS chunker, 1500 AS token_budget FROM labels")
def e19_stamped(spark, sf_dir):
    return artifacts.stamped(read(spark, sf_dir, "labels").select("doc_id", "quality"), fingerprint="fp", parser="p1", chunker="c1", budget=1500)


@query("SELECT doc_id, 'r1' AS rubric, quality AS value FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) UNION ALL SELECT vec_id, 'r1', 9 FROM embeddings WHERE vec_id % 2 = 0")
def e20_upserted(spark, sf_dir):
    old = read(spark, sf_dir, "labels").select("doc_id", F.lit("r1").alias("rubric"), F.col("quality").alias("value"))
    new = read(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.lit("r1").alias("rubric"), F.lit(9).alias("value"))
    return artifacts.upsert(old, new, ["doc_id", "rubric"])


@query("SELECT event_id, ts::TIMESTAMP AS ts FROM events ORDER BY ts DESC, event_id LIMIT 25")
def t5_latest_jobs(spark, sf_dir):
    """The 25 latest rows, as a job list shows them."""
    return lifecycle.latest(read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "event_id", 25)


@query("""WITH d AS (SELECT item_id, item_id % 3 <> 0 AND item_id % 5 = 0 AS gone FROM benchmark)
SELECT 'item ' || item_id AS source_id, CASE WHEN gone THEN 'tombstone' ELSE 'manifest' END AS kept_in, NOT gone AS in_chunks, NOT gone AS in_index, 'Item ' || item_id AS title FROM d""")
def m3_m10_library(spark, sf_dir):
    """Benchmark texts as sources of a library: two thirds added, every fifth of these removed, the others added after."""
    items = read(spark, sf_dir, "benchmark")
    docs = items.select("item_id", F.lit("").alias("owner"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("source_id"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), "text", F.lit("corpus").alias("origin"), F.sha2("text", 256).alias("content_hash"))
    model = lambda texts: [[float(len(t) % 7 + 1), float(t.count("e") + 1), *([0.0] * 62)] for t in texts]
    first = F.col("item_id") % 3 != 0
    held = library.added(library.load(spark, f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"), docs.filter(first).drop("item_id"), model, fingerprint="fp")
    held = library.removed(held, docs.filter("item_id % 5 = 0").select("owner", "source_id"), F.lit("2024-01-01").cast("timestamp"))
    held = library.added(held, docs.filter(~first).drop("item_id"), model, fingerprint="fp")
    kept = held.table("manifest").select("source_id", "title").withColumn("kept_in", F.lit("manifest"))
    rows = kept.unionByName(held.table("tombstones").select("source_id", "title").withColumn("kept_in", F.lit("tombstone")))
    chunks = held.table("chunks")
    indexed = held.index.chunks().join(chunks.select("chunk_id", "source_id"), "chunk_id").select("source_id").distinct().withColumn("in_index", F.lit(True))
    rows = rows.join(chunks.select("source_id").distinct().withColumn("in_chunks", F.lit(True)), "source_id", "left").join(indexed, "source_id", "left")
    return rows.select("source_id", "kept_in", F.coalesce("in_chunks", F.lit(False)).alias("in_chunks"), F.coalesce("in_index", F.lit(False)).alias("in_index"), "title")
