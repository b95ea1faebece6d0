"""Citation checks, quote overlap, routing rules and answer status. Language models are injected functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.matching import overlap
from quarrylight.functions.text import QUOTE_CHARS, squash

#: Routes, which of them search, and how much longer a rewrite of a new topic may be.
ROUTES = ("documents", "documents_and_conversation", "conversation_only", "ask_fresh")
SEARCHING, REWRITE_GROWTH = ("documents", "documents_and_conversation"), 1.6


def quote_status(quote: Column, verbatim: Column, provenance: Column) -> Column:
    """unquotable, no_quote, verified or absent."""
    q = squash(quote)
    return F.when((provenance == "model_generated") | verbatim.isNull() | (verbatim == ""), "unquotable").when(F.length(q) < QUOTE_CHARS, "no_quote").when(F.contains(squash(verbatim), q), "verified").otherwise("absent")


def with_overlap(checks: DataFrame, quote: str = "quote", verbatim: str = "verbatim_text") -> DataFrame:
    """``checks`` with ``overlap``: 1 for verified quotes, measured in Python for absent ones only, else 0."""

    @F.pandas_udf("double")
    def measured(quotes, texts):
        return quotes.combine(texts, lambda q, t: overlap(q or "", t or ""))

    absent = F.col("quote_status") == "absent"
    rest = checks.filter(~absent).withColumn("overlap", F.when(F.col("quote_status") == "verified", 1.0).otherwise(0.0))
    return rest.unionByName(checks.filter(absent).withColumn("overlap", measured(squash(F.col(quote)), squash(F.col(verbatim)))))


def citation_checks(answers: DataFrame, sent: DataFrame) -> DataFrame:
    """One row a citation: label, chunk, fabricated, quote status.

    answers: answer_id, claims (array of text, source, citations of label and quote; labels are
    strings); sent: answer_id, label, chunk_id, verbatim_text, text_provenance. A label that is not
    an integer, or was not sent, is fabricated.
    """
    claims = answers.select("answer_id", F.posexplode("claims").alias("claim_index", "claim"))
    cited = claims.select("answer_id", "claim_index", F.posexplode("claim.citations").alias("citation_index", "c"))
    cited = cited.select("answer_id", "claim_index", "citation_index", F.col("c.quote").alias("quote"), F.expr("try_cast(c.label as int)").alias("label"))
    joined = cited.join(sent, ["answer_id", "label"], "left")
    fabricated = F.col("chunk_id").isNull()
    status = F.when(fabricated, "no_quote").otherwise(quote_status(F.col("quote"), F.col("verbatim_text"), F.col("text_provenance")))
    return joined.select("answer_id", "claim_index", "citation_index", "label", "chunk_id", "quote", "verbatim_text", fabricated.alias("fabricated"), status.alias("quote_status"))


def reconcile_answers(answers: DataFrame, checks: DataFrame, sent: DataFrame) -> DataFrame:
    """Per answer: counts of chunks, citations and claims, and whether it is grounded.

    Grounded: nothing fabricated, absent or too short to check, no document claim without a
    citation (unless the answer abstained), no conversation claim with one.
    """
    status = F.col("quote_status")
    by_answer = checks.groupBy("answer_id").agg(
        F.count("*").alias("citations_emitted"),
        F.count_distinct(F.when(~F.col("fabricated"), F.col("label"))).alias("chunks_cited"),
        F.sum((status == "verified").cast("long")).alias("citations_verified"),
        F.sum((status == "absent").cast("long")).alias("citations_absent"),
        F.sum(F.col("fabricated").cast("long")).alias("citations_fabricated"),
        F.sum((status == "unquotable").cast("long")).alias("citations_unquotable"),
        F.sum((status == "no_quote").cast("long")).alias("citations_short"),
    )
    documents = F.filter("claims", lambda c: F.coalesce(c["source"], F.lit("documents")) == "documents")
    talk = F.filter("claims", lambda c: c["source"] == "conversation")

    def cites(c: Column) -> Column:
        return F.coalesce(F.size(c["citations"]), F.lit(0)) > 0

    claims = answers.select(
        "answer_id",
        "abstained",
        F.size("claims").alias("claims"),
        F.size(documents).alias("claims_from_documents"),
        F.size(talk).alias("claims_from_conversation"),
        F.size(F.filter(documents, lambda c: ~cites(c))).alias("claims_uncited"),
        F.size(F.filter(talk, cites)).alias("claims_mislabelled"),
    )
    chunks = sent.groupBy("answer_id").agg(F.count("*").alias("chunks_sent"))
    counts = [c for c in by_answer.columns if c != "answer_id"] + ["chunks_sent"]
    joined = claims.join(by_answer, "answer_id", "left").join(chunks, "answer_id", "left").na.fill(0, counts)
    grounded = (F.col("citations_fabricated") == 0) & (F.col("citations_absent") == 0) & (F.col("citations_short") == 0) & (F.col("abstained") | (F.col("claims_uncited") == 0)) & (F.col("claims_mislabelled") == 0)
    return joined.withColumn("grounded", grounded)


def integrity(reconciled: DataFrame) -> DataFrame:
    """One row: citation integrity holds exactly if nothing was fabricated; not measured without answers."""
    n = F.count("*")
    return reconciled.agg(n.alias("n"), F.coalesce(F.sum("citations_fabricated"), F.lit(0)).alias("observed")).select("n", "observed", F.when(F.col("n") == 0, "NOT_MEASURED").when(F.col("observed") == 0, "HOLDS").otherwise("FAILS").alias("state"))


def evidence_mix(checks: DataFrame, kinds: list[str]) -> DataFrame:
    """Citations of each answer by evidence kind, one column a kind. checks: answer_id, evidence_kind."""
    return checks.groupBy("answer_id").pivot("evidence_kind", kinds).count().na.fill(0)


def locate_span(quote: str | None, text: str | None) -> tuple[int, int] | None:
    """Start and end of a quote in a text, comparing letters and digits only; null if it is not there."""
    held = [(k, c.lower()) for k, c in enumerate(text or "") if c.isalnum()]
    needle = "".join(c for c in (quote or "").lower() if c.isalnum())
    flat, places = "", []
    flat = "".join(c for _, c in held)
    for k, c in held:
        places += [k] * len(c)
    at = flat.find(needle) if needle else -1
    return None if at < 0 else (places[at], places[at + len(needle) - 1] + 1)


def located(rows: DataFrame, quote: str, text: str) -> DataFrame:
    """``rows`` with span_start and span_end (null where the quote is not found)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [locate_span(q, t) for q, t in zip(batch.column(names.index(quote)).to_pylist(), batch.column(names.index(text)).to_pylist())]
            ends = [pa.array([s and s[k] for s in spans], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *ends], names=[*names, "span_start", "span_end"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, span_start int, span_end int")


def salvage(raw: str | None, field: str = "answer_markdown") -> str:
    """The named string field of JSON text that may be cut off; empty if there is none to save."""
    key = (raw or "").find(f'"{field}"')
    colon = raw.find(":", key + len(field) + 2) if key >= 0 else -1
    start = raw.find('"', colon + 1) if colon >= 0 else -1
    if start < 0:
        return ""
    end, escaped = start + 1, False
    while end < len(raw) and (escaped or raw[end] != '"'):
        escaped = raw[end] == "\\" and not escaped
        end += 1
    body = raw[start + 1 : end]
    for cut in range(min(8, len(body) + 1)):
        try:
            return json.loads(f'"{body[: len(body) - cut]}"')
        except json.JSONDecodeError:
            continue
    return ""


def parsed_answers(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with ``answer_markdown`` and ``truncated``: parsed natively, salvaged in Python only where that fails."""
    whole = F.from_json(column, "answer_markdown string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = raw.withColumn("__p", whole)
    bad = F.col("__p").isNull() | F.col("__p._corrupt").isNotNull()

    @F.pandas_udf("string")
    def saved(texts):
        return texts.map(salvage)

    good = parsed.filter(~bad).select(*raw.columns, F.coalesce("__p.answer_markdown", F.lit("")).alias("answer_markdown"), F.lit(False).alias("truncated"))
    return good.unionByName(parsed.filter(bad).select(*raw.columns, saved(F.col(column)).alias("answer_markdown"), F.lit(True).alias("truncated")))


def condensed(turns: DataFrame) -> DataFrame:
    """What is searched, by the routing rules over a model's proposal.

    turns: question, history, route, search_query, topic_shift, failed (the proposal; null columns
    without a call). No history: the question itself. A failed call: the question, flagged. A
    rewrite of a new topic that grew past the limit: the question.
    """
    fresh = F.trim(F.coalesce("history", F.lit(""))) == ""
    failed = F.coalesce("failed", F.lit(False))
    proposed = F.when(F.trim(F.coalesce("search_query", F.lit(""))) == "", F.col("question")).otherwise(F.trim("search_query"))
    grown = F.coalesce("topic_shift", F.lit(False)) & (F.length(proposed) > REWRITE_GROWTH * F.length("question"))
    route = F.when(fresh | failed, "documents").otherwise(F.coalesce("route", F.lit("documents")))
    query = F.when(fresh | failed | grown, F.col("question")).otherwise(proposed)
    return turns.withColumns({"route": route, "search_query": query, "fallback": ~fresh & failed, "searches": route.isin(*SEARCHING)})


def answer_status(answers: DataFrame) -> DataFrame:
    """Status of each answer: starved and empty retrievals abstain for different reasons, cut-off answers are ungrounded.

    answers: n_ranked, n_delivered, abstained, truncated, grounded.
    """
    status = F.when((F.col("n_ranked") > 0) & (F.col("n_delivered") == 0), "abstained_starved").when(F.col("n_ranked") == 0, "abstained_no_sources").when(F.col("truncated"), "ungrounded_truncated").when(F.col("abstained"), "abstained").when(F.col("grounded"), "grounded").otherwise("ungrounded")
    return answers.withColumn("status", status)


def swapped(pairs: DataFrame, key: str, seed: int) -> DataFrame:
    """``pairs`` with a recorded coin of id and seed that says whether the judge sees the sources reversed."""
    return pairs.withColumn("order_swapped", F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256), 1, 8), 16, 10).cast("long") % 2 == 1)


def judged(pairs: DataFrame, judge: Callable[[str, str, list[str]], str], judge_model: str, generator_model: str) -> DataFrame:
    """Verdicts of an injected judge on (item_id, question, answer, sources, order_swapped); refused if a model would grade itself."""
    if judge_model == generator_model:
        raise ValueError("the judge and the generator are the same model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for question, answer, sources, reverse in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                out.append(judge(question, answer, list(reversed(sources)) if reverse else sources))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(4)], names=["item_id", "faithfulness", "order_swapped"])

    return pairs.select(F.col("item_id").cast("string").alias("item_id"), "question", "answer", "sources", "order_swapped").mapInArrow(run, "item_id string, faithfulness string, order_swapped boolean")


def generated(prompts: DataFrame, model: Callable[[str], str], stage: str) -> DataFrame:
    """Answers of an injected model, each distinct prompt asked once; an empty answer fails the task.

    prompts: key, prompt. Returns key, stage, text and the estimated tokens of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model(p) for p in batch.column(0).to_pylist()]
            if not all(out):
                raise ValueError(f"the model gave an empty answer in stage {stage}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["prompt", "text"])

    asked = prompts.select("prompt").distinct().mapInArrow(run, "prompt string, text string")
    tokens = [F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long").alias(f"{c}_tokens") for c in ("prompt", "text")]
    return prompts.join(asked, "prompt").select("key", F.lit(stage).alias("stage"), "text", *tokens)


def cached(wanted: DataFrame, cache: DataFrame, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all values, new cache rows) of ``wanted`` (cache_key, ...): misses alone go to ``make``, which returns cache_key and value."""
    misses = wanted.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    made = make(misses).select("cache_key", "value")
    return wanted.join(cache.select("cache_key", "value").unionByName(made), "cache_key"), made


def numbered(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each query with their label from 1."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("label", F.row_number().over(order)).filter(F.col("label") <= most)


def from_conversation(turns: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Answers from the history alone: key, text; their one claim is the conversation's and no citation check applies.

    turns: key, history (array of texts), question.
    """
    prompt = F.concat(F.lit("Conversation so far:\n"), F.array_join("history", "\n"), F.lit("\n\nQuestion: "), "question")
    told = generated(turns.select("key", prompt.alias("prompt")), model, "conversation")
    return told.select("key", "text", F.lit("conversation").alias("source"), F.lit("not_applicable").alias("verification"))


def captioned(images: DataFrame, cache: DataFrame, caption: Callable[[bytes], str | None]) -> tuple[DataFrame, DataFrame]:
    """(images with caption, new cache rows) by an injected model, each distinct image and context once.

    images: image_id, content, context. The key covers the image's hash and the context; an image without a caption is not cached.
    """
    from quarrylight.functions.ids import cache_key

    keyed = images.withColumn("cache_key", cache_key(F.sha2("content", 256), F.coalesce("context", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([caption(c) or "" for c in batch.column(1).to_pylist()], pa.string())], names=["cache_key", "value"])

    misses = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    made = misses.select("cache_key", "content").mapInArrow(run, "cache_key string, value string").filter("value <> ''")
    return keyed.join(cache.select("cache_key", "value").unionByName(made), "cache_key", "left").withColumnRenamed("value", "caption"), made
