"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe, html, licenses, neardup, packing, quality, resampling, secrets, subwords, suffixes, topk, toxicity, tries
from quarrylight.llm._common import arrow_batches, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of every document with the base verdict and that of policy v1."""
    rows = quality.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(quality.mask_of(quality.BASE_RULES))) != 0
    return quality.apply_policy(rows, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_bits"), "n_lines", "n_capitals")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (100 * n_capitals > 50 * word_chars)::BIGINT
    + 32 * (2 * word_chars < 4 * n_words)::BIGINT + 64 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, n_lines, n_capitals
FROM f
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of policy v1: documents that fail it, that only it rejects, and that stay without it; bits of the ledger, summed."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents", "doc_id", "text")))


ABLATIONS_SQL = f"""
WITH q AS ({OP1_SQL}),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('capitals', 16), ('short_words', 32), ('long_words', 64))
SELECT rule, count(*) FILTER ((failed_bits & bit) <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only, count(*) FILTER ((failed_bits & (127 - bit)) = 0) AS n_kept_without
FROM q, r GROUP BY rule
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of 2048."""
    arrow_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and network findings in every document."""
    arrow_batches(spark)
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fold (crc32 of the id, modulo 3, is 1)."""
    arrow_batches(spark)
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = toxicity.fit(toxicity.training_sample(docs, labels.filter(~held_out)))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrase places and license labels of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).cast("long").alias("last_word"),
        licenses.labels_of(base).alias("base_labels"),
        licenses.labels_of(F.col("detections")).alias("labels"),
        licenses.score_of(F.col("detections")).alias("score"),
    )


def _op5_sql() -> str:
    """The scan with the rule table as values; non-ASCII characters become _ so that \b parts words."""
    values = ", ".join("(" + ", ".join([str(k), f"'{r.gate}'", f"'{r.keyword}'", f"'{r.label}'", f"'{r.pattern}'", str(r.priority), str(r.base).lower()]) + ")" for k, r in enumerate(licenses.rules()))
    return rf"""
WITH rules(rank, gate, keyword, label, pattern, priority, base) AS (VALUES {values}),
f AS (
  SELECT doc_id, regexp_replace(' ' || regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F]', '_', 'g'), '[^0-9a-z_]', ' ', 'g') || ' ', ' {{2,}}', ' ', 'g') AS form
  FROM (SELECT doc_id, translate(text, '_', ' ') AS text FROM documents)),
m AS (
  SELECT doc_id, rules.*, string_split(regexp_replace(form, '\b(' || pattern || ')\b', chr(1) || '\1', 'g'), ' ') AS ws, regexp_extract_all(form, '\b(' || pattern || ')\b') AS ms
  FROM f JOIN rules ON contains(form, gate) AND contains(form, keyword)
  WHERE regexp_matches(form, '\b(' || pattern || ')\b')),
p AS (SELECT *, list_filter(range(len(ws)), lambda i: starts_with(ws[i + 1], chr(1))) AS pos FROM m),
d AS (
  SELECT doc_id, rank, label, priority, base, pos[k] - 1 AS s, pos[k] - 1 + len(string_split(ms[k], ' ')) AS e
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM p)),
kept AS (
  SELECT * FROM d WHERE base OR NOT EXISTS (
    SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND ((o.s < d.e AND d.s < o.e AND o.priority > d.priority)
      OR (o.s <= d.s AND d.e <= o.e AND o.priority = d.priority AND o.rank < d.rank)))),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(priority) / 100.0 AS score
  FROM kept GROUP BY doc_id)
SELECT f.doc_id, (length(form) - length(replace(form, ' ', '')) - 1)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM f LEFT JOIN g ON f.doc_id = g.doc_id
"""


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    arrow_batches(spark)
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.search(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses to earlier ones, by repeated strings of 50 bytes."""
    arrow_batches(spark)
    return suffixes.removal_report(table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, k * 512 AS base, substr(h, k * 1024 + 1, 1122) AS part, least(n - k * 512, 512) AS m, n
  FROM (SELECT *, unnest(range(0, (n + 511) // 512)) AS k FROM d)),
s AS (SELECT doc_id, base + i AS pos, substr(part, 2 * i + 1, 100) AS string
  FROM (SELECT *, unnest(range(0, least(512, n - 49 - base))) AS i FROM c)),
l AS (SELECT doc_id, pos, doc_id > min(doc_id) OVER (PARTITION BY string) AS lost FROM s),
g AS (SELECT doc_id, pos, pos - coalesce(lag(pos) OVER w, -1000) > 50 AS head FROM l WHERE lost WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, pos, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
r AS (SELECT doc_id, run, min(pos) AS b, max(pos) + 50 AS e FROM p GROUP BY ALL),
q AS (SELECT doc_id, b, e, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k FROM r),
z AS (SELECT d.doc_id, count(*) AS n_spans, sum(e - b) AS n_removed,
    string_agg((CASE WHEN k = 1 THEN substr(h, 1, 2 * b) ELSE '' END) || substr(h, 2 * e + 1, 2 * (coalesce(next, n) - e)), '' ORDER BY b) AS kept
  FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's encoding and of its decoding."""
    arrow_batches(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    arrow_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS other FROM u UNION SELECT r.doc_id, u.b FROM reach r JOIN u ON u.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id)::BIGINT AS component_id, component_id IS NULL OR component_id = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    arrow_batches(spark)
    return tries.trie(table(spark, sf_dir, "conversations"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    arrow_batches(spark)
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = subwords.fit(subwords.training_sample(docs, labels.filter(~held_out)))
    return subwords.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy score and rank of every document, drawn a tenth towards the benchmark's texts by word buckets."""
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")).drop("n_words")


#: CTEs: ``crc_table`` with one row tab, the CRC-32 table by its polynomial.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""


def crc_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a string; needs ``crc_table`` beside it."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295)"


OP11_SQL = f"""
WITH {CRC_TABLE},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc_sql('id')} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS id FROM t), crc_table),
r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(role) || sha256(text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS path, strlen(text) AS n
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
a AS (SELECT conv_id, depth, path, n FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM a JOIN (SELECT conv_id, max(depth) AS length FROM a GROUP BY conv_id) l USING (conv_id) GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 128) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
up AS (
  SELECT left(path, 128 * i) AS path, sum((n_convs - 1) * n) AS saved, sum(leaf) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM (SELECT nodes.*, (kids.n IS NULL)::INT AS leaf FROM nodes LEFT JOIN kids ON kids.path = nodes.path)) GROUP BY ALL)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children,
  up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN up ON up.path = nodes.path LEFT JOIN kids ON kids.path = nodes.path
LEFT JOIN nodes above ON nodes.depth > 0 AND above.path = left(nodes.path, length(nodes.path) - 128)
"""

OP13_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocabulary AS (SELECT w, {crc_sql('w')} % 10000 AS b FROM (SELECT w FROM w UNION SELECT w FROM bw), crc_table),
s AS (SELECT b, count(*) AS n FROM w JOIN vocabulary USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN vocabulary USING (w) GROUP BY b),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (sum(s.n) OVER () + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t ON t.b = s.b),
m AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN vocabulary USING (w) JOIN g USING (b) GROUP BY r),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m ON m.r = d.r),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) END AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, sf_dir)."""
    return {
        "op1_quality_rules": op1_quality_rules,
        "quality_ablations": quality_ablations,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_secret_scans": op3_secret_scans,
        "op4_toxicity": op4_toxicity,
        "op5_license_scans": op5_license_scans,
        "op6_html_extraction": op6_html_extraction,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op1_quality_rules": OP1_SQL,
        "quality_ablations": ABLATIONS_SQL,
        "op5_license_scans": _op5_sql(),
        "op7_exact_top_k": OP7_SQL,
        "op8_suffix_array_dedup": OP8_SQL,
        "op10_minhash_near_dedup": OP10_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
