"""Corpus files: walk, dispatch to loaders, parse cache. PDF and captions come through injected functions."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylight import schemas
from quarrylight.operators.chunking import markdown_parts

#: Document type of each suffix; version of the parsers, part of the cache key.
SUFFIXES = {"pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "md": "markdown", "txt": "text"}
PARSER = "quarrylight-1"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

PARSED = f"source_id string, doc_type string, content_hash string, {schemas.BLOCK}"
Loader = Callable[[str, bytes], list[dict]]


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, content, length and content_hash of every corpus file under ``root``, by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    return files.select("path", "content", "length", F.sha2("content", 256).alias("content_hash"))


def block(ordinal: int, kind: str, text: str, path: list[str], **more) -> dict:
    """A block row with its defaults."""
    return {"ordinal": ordinal, "kind": kind, "text": text, "heading_path": path, "text_source": "text_layer", "table_continuation_suspect": False, "table_header_missing": False} | more


def load_markdown(path: str, content: bytes) -> list[dict]:
    """Blocks of markdown or plain text."""
    return [block(k, p.kind, p.text, list(p.heading_path)) for k, p in enumerate(markdown_parts(content.decode("utf-8", "replace")))]


def load_docx(path: str, content: bytes) -> list[dict]:
    """Blocks of a .docx in document order: declared headings make the path, native tables become markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out: list[dict] = []
    heading: list[str] = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            text = _words(child).strip()
            style = child.find(f"{_W}pPr/{_W}pStyle")
            raw = style.get(f"{_W}val") if style is not None else ""
            name = names.get(raw, raw)
            level = re.fullmatch(r"heading ?(\d+)", name, re.IGNORECASE)
            if not text:
                continue
            if name.lower() == "title":
                heading = [text]
            elif level:
                heading = heading[: int(level[1])] + [text]
            else:
                out.append(block(len(out), "text", text, list(heading)))
        elif child.tag == f"{_W}tbl":
            rows = [[_words(cell).strip() for cell in row.iter(f"{_W}tc")] for row in child.iter(f"{_W}tr")]
            out.append(block(len(out), "table", markdown_rows(rows), list(heading), table_header_missing=not _labelled(rows)))
    return out


def _words(node) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            parts.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}br"):
            parts.append("\t" if x.tag == f"{_W}tab" else "\n")
    return "".join(parts)


def markdown_rows(rows: list[list[str]]) -> str:
    """The table of functions.text.markdown_table."""
    width = max(map(len, rows), default=0)
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([*lines[:1], *([f"| {' | '.join(['---'] * width)} |"] if rows else []), *lines[1:]])


def numeric(cell: str) -> bool:
    """The test of functions.text.is_numeric."""
    bare = re.sub(r"[\s,%]", "", cell).rstrip(".")
    try:
        return bool(bare) and float(bare) is not None
    except ValueError:
        return False


def _labelled(rows: list[list[str]]) -> bool:
    filled = next(([c for c in map(str.strip, r) if c] for r in rows if any(map(str.strip, r))), [])
    return bool(filled) and sum(map(numeric, filled)) < max(1, len(filled) // 2)


def caption_loader(caption: Callable[[bytes], str | None]) -> Loader:
    """Images: one caption block, or none where there is no caption."""
    return lambda path, content: [block(0, "image_caption", text, [], asset_path=path, text_source="caption")] if (text := caption(content)) else []


def parse(files: DataFrame, cache: DataFrame | None = None, *, pdf: Loader | None = None, caption: Callable[[bytes], str | None] = lambda _: None) -> tuple[DataFrame, DataFrame]:
    """(blocks, new cache rows) of walked files.

    cache: cache_key and the block columns; its key covers parser version and content, so only files
    that changed are parsed. A suffix without loader is an error. Without ``pdf``, PDFs are one.
    """
    loaders: dict[str, Loader | None] = {"markdown": load_markdown, "text": load_markdown, "docx": load_docx, "image": caption_loader(caption), "pdf": pdf}
    schema = StructType.fromDDL(f"cache_key string, {PARSED}")
    arrow = to_arrow_schema(schema)
    key = F.sha2(F.concat(F.lit(PARSER + "|"), F.col("content_hash")), 256)
    keyed = files.withColumn("cache_key", key).withColumn("source_id", F.lower(F.regexp_extract("path", "([^/]*)$", 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                suffix = row["path"].rpartition(".")[2].lower()
                loader = loaders.get(SUFFIXES.get(suffix, ""))
                if loader is None:
                    raise ValueError(f"no loader for {row['path']}")
                common = {"cache_key": row["cache_key"], "source_id": row["source_id"], "doc_type": SUFFIXES[suffix], "content_hash": row["content_hash"]}
                found = [common | b for b in loader(row["path"], row["content"])]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    misses = keyed if cache is None else keyed.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    made = misses.select("cache_key", "source_id", "path", "content", "content_hash").mapInArrow(run, schema)
    if cache is None:
        return made.drop("cache_key"), made
    held = cache.join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
    return held.unionByName(made).drop("cache_key"), made


def parsed_hash(blocks: DataFrame) -> DataFrame:
    """source_id and the hash of its parser output, blocks in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda b: b["text"])
    return blocks.groupBy("source_id").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("parsed_hash"))


def file_hash(content: bytes) -> str:
    """The content hash of walk(), for drivers that hold a file."""
    return hashlib.sha256(content).hexdigest()
