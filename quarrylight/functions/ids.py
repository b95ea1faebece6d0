"""Identifiers, hashes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(role: Column, source_id: Column, ordinal: Column, text: Column) -> Column:
    """24 hex digits of the hash of role, source, ordinal and the text's hash."""
    return F.substring(F.sha2(F.concat_ws("|", role, source_id, ordinal.cast("string"), F.sha2(text, 256)), 256), 1, 24)


def cache_key(*parts: Column) -> Column:
    """Hash of parts each followed by NUL, so that no two lists of parts run together."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\x00"))]), 256)


def fingerprint(components: dict[str, Column]) -> Column:
    """16 hex digits of the hash of the components as compact JSON with sorted keys."""
    pairs = []
    for name in sorted(components):
        pairs += [F.lit(("," if pairs else "{") + f'"{name}":'), F.to_json(F.struct(components[name].alias("v")), {"ignoreNullFields": "false"})]
    pairs = [p if k % 2 == 0 else F.regexp_replace(p, r'^\{"v":(.*)\}$', "$1") for k, p in enumerate(pairs)]
    return F.substring(F.sha2(F.concat(*pairs, F.lit("}")), 256), 1, 16)


def normalize_id(path: Column, root: str) -> Column:
    """A path under ``root`` relative to it, any other one's file name; slashes forward, lower case."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.lower(F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, F.lit(len(base) + 1), F.length(slashed))).otherwise(F.regexp_extract(slashed, "([^/]*)/*$", 1)))


def session_ok(raw: Column, public: str) -> Column:
    """The session id if it has the shape of one and is not the public owner's; else null."""
    return F.when(raw.rlike("^[A-Za-z0-9_-]{22}$") & (raw != public), raw)


def asset_slug(name: Column) -> Column:
    """slug and page of a page image's name (slug_pN.ext); null where the name has another form."""
    hit = name.rlike(r"(?i)^.*_p\d+\.(png|jpe?g|webp)$")
    return F.when(hit, F.struct(F.lower(F.regexp_extract(name, r"(?i)([^/]*)_p(\d+)\.(png|jpe?g|webp)$", 1)).alias("slug"), F.regexp_extract(name, r"(?i)_p(\d+)\.[a-z]+$", 1).cast("int").alias("page")))


def page_label(page: Column, page_end: Column) -> Column:
    """p. N, or pp. N-M; null without a page."""
    return F.when(page.isNull(), None).when(page_end.isNull() | (page_end == page), F.concat(F.lit("p. "), page.cast("string"))).otherwise(F.concat(F.lit("pp. "), page.cast("string"), F.lit("-"), page_end.cast("string")))


def locator(source_id: Column, page: Column, page_end: Column, headings: Column, asset: Column) -> Column:
    """Where a citation points: source, page range or else the last two headings, image."""
    has_page = page.isNotNull() & (page != 0)
    pages = F.concat(F.lit("p"), page.cast("string"), F.when(page_end.isNotNull() & (page_end != 0), F.concat(F.lit("-"), page_end.cast("string"))).otherwise(""))
    last = F.slice(headings, F.greatest(F.size(headings) - 1, F.lit(1)), F.lit(2))
    place = F.when(has_page, pages).when(F.size(headings) > 0, F.array_join(last, " > "))
    image = F.when(F.length(asset) > 0, F.concat(F.lit("image: "), asset))
    return F.when(source_id.isNull(), "?").otherwise(F.concat_ws("  ", source_id, place, image))


def evidence_kind(provenance: Column, text_source: Column, quote_status: Column) -> Column:
    """What a citation rests on."""
    return F.when(provenance == "model_generated", "assistant_reading").when(F.contains(F.coalesce(text_source, F.lit("")), F.lit("page_text_clip")), "structure_inferred").when(quote_status == "verified", "quoted").otherwise("found_not_quoted")


def format_source(label: Column, source_id: Column, page: Column, page_end: Column, headings: Column, text_source: Column, provenance: Column, text: Column) -> Column:
    """A numbered source block: header line, note on how to read it, text."""
    has_page = page.isNotNull() & (page != 0)
    pages = F.when(has_page, F.concat(F.lit("page "), page.cast("string"), F.when(page_end.isNotNull() & (page_end != 0), F.concat(F.lit("-"), page_end.cast("string"))).otherwise("")))
    section = F.when(F.size(headings) > 0, F.concat(F.lit("Section: "), F.array_join(headings, " > ")))
    head = F.concat_ws(" | ", F.concat(F.lit("["), label.cast("string"), F.lit("] "), source_id), pages, section)
    note = F.when(F.contains(F.coalesce(text_source, F.lit("")), F.lit("page_text_clip")), "\n(Read this as a table: each line is one value, row after row.)").when(provenance == "model_generated", "\n(A model wrote this description; the document does not contain it.)").otherwise("")
    return F.concat(head, note, F.lit("\n"), text)


def reingest_reason(previous_hash: Column, content_hash: Column, previous_print: Column, print_: Column) -> Column:
    """Why a document is processed again: new, content changed, pipeline changed; null if it is not."""
    return F.when(previous_hash.isNull(), "new document").when(previous_hash != content_hash, "content changed").when(previous_print != print_, F.concat(F.lit("pipeline changed ("), previous_print, F.lit(" -> "), print_, F.lit(")")))
