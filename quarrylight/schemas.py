"""Schemas of the engine's tables, as Spark DDL."""

from __future__ import annotations

BLOCK = "ordinal int, kind string, text string, page int, page_end int, heading_path array<string>, asset_path string, text_source string, table_continuation_suspect boolean, table_header_missing boolean"
SOURCES = "owner string, source_id string, uri string, doc_type string, title string, content_hash string, origin string"
BLOCKS = f"owner string, source_id string, {BLOCK}"
CHUNKS = (
    "owner string, origin string, source_id string, chunk_id string, ordinal int, role string, parent_id string, position_within_parent int, n_siblings int, "
    "embed_text string, display_text string, verbatim_text string, text_provenance string, kind string, page int, page_end int, asset_path string, heading_path array<string>, "
    "has_contextual_prefix boolean, text_source string, table_continuation_suspect boolean, table_header_missing boolean, pipeline_fingerprint string, content_hash string"
)
CHECKS = "name string, rule string, observed string, state string, n long, fingerprint string"
#: Closed sets of names.
DOC_TYPES = ("pdf", "docx", "image", "markdown", "text")
CHUNK_KINDS = ("text", "table", "table_summary", "image_caption", "parent")
PROVENANCES = ("verbatim", "prefixed", "model_generated")
