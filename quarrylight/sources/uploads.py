"""Upload probe and gate: what a file is by its bytes, and whether it may be parsed. Asset path containment."""

from __future__ import annotations

import io
import os
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits on size, pixels, archives and PDF pages.
MAX_BYTES, MAX_PIXELS, MAX_RATIO, MAX_UNPACKED, MAX_PAGES, MAX_OBJECTS = 20_000_000, 40_000_000, 100, 200_000_000, 500, 200_000
#: Signatures by type, and PDF names of active content.
MAGIC = {b"%PDF-": "pdf", b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpeg", b"PK\x03\x04": "zip"}
ACTIVE = (b"/JavaScript", b"/JS", b"/Launch", b"/EmbeddedFile", b"/OpenAction", b"/AA")
#: What a visitor is told of each code.
MESSAGES = {
    "ok": "accepted",
    "too_large": "the file is too large",
    "unknown_type": "the file is not a PDF, a Word document or an image",
    "suffix_mismatch": "the file is not what its name says",
    "too_many_pixels": "the image has too many pixels",
    "archive_bomb": "the document unpacks to too much",
    "archive_escape": "the document has a member outside itself",
    "not_a_document": "the archive is not a Word document",
    "active_content": "the PDF has active content",
    "encrypted": "the PDF is encrypted",
    "too_many_pages": "the PDF has too many pages",
    "unreadable": "the file cannot be read",
}


def sniff(raw: bytes) -> str:
    """The type by leading bytes; empty if unknown."""
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return "webp"
    return next((kind for magic, kind in MAGIC.items() if raw.startswith(magic)), "")


def image_size(raw: bytes) -> tuple[int, int]:
    """Width and height of a PNG or JPEG from its headers; (0, 0) if they are not found."""
    if raw.startswith(b"\x89PNG") and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    at = 2
    while raw.startswith(b"\xff\xd8") and at + 9 < len(raw) and raw[at] == 0xFF:
        if raw[at + 1] in range(0xC0, 0xD0) and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return 0, 0


def probe(name: str, raw: bytes) -> str:
    """A code of MESSAGES."""
    if len(raw) > MAX_BYTES:
        return "too_large"
    kind, suffix = sniff(raw), name.rpartition(".")[2].lower()
    if not kind:
        return "unknown_type"
    if kind not in {"pdf": ("pdf",), "docx": ("zip",), "png": ("png",), "jpg": ("jpeg",), "jpeg": ("jpeg",), "webp": ("webp",)}.get(suffix, ()):
        return "suffix_mismatch"
    if kind == "zip":
        return _probe_archive(raw)
    if kind == "pdf":
        return _probe_pdf(raw)
    width, height = image_size(raw)
    return "too_many_pixels" if width * height > MAX_PIXELS else "ok"


def _probe_archive(raw: bytes) -> str:
    try:
        members = zipfile.ZipFile(io.BytesIO(raw)).infolist()
    except zipfile.BadZipFile:
        return "unreadable"
    unpacked = sum(m.file_size for m in members)
    if unpacked > MAX_UNPACKED or unpacked > MAX_RATIO * max(1, sum(m.compress_size for m in members)):
        return "archive_bomb"
    if any(m.filename.startswith("/") or ".." in m.filename.replace("\\", "/").split("/") for m in members):
        return "archive_escape"
    return "ok" if any(m.filename == "word/document.xml" for m in members) else "not_a_document"


def _probe_pdf(raw: bytes) -> str:
    if b"/Encrypt" in raw:
        return "encrypted"
    if any(name in raw for name in ACTIVE):
        return "active_content"
    pages = raw.count(b"/Type /Page") + raw.count(b"/Type/Page") - raw.count(b"/Type /Pages") - raw.count(b"/Type/Pages")
    return "too_many_pages" if pages > MAX_PAGES or raw.count(b" obj") > MAX_OBJECTS else "ok"


def gated(files: DataFrame) -> DataFrame:
    """path, code, message and accepted of binary files (path, content). Reading happens in the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [probe(p, c or b"") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], names=["path", "code"])

    codes = files.select("path", "content").mapInArrow(run, "path string, code string")
    message = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[F.col("code")]
    return codes.select("path", "code", message.alias("message"), (F.col("code") == "ok").alias("accepted"))


def inside(root: str, relative: str) -> Path:
    """The path of a relative asset name under ``root``; an error if it is absolute or leads outside."""
    if os.path.isabs(relative):
        raise ValueError("an asset path is relative")
    base = Path(root).resolve()
    full = (base / relative).resolve()
    if base != full and base not in full.parents:
        raise ValueError("an asset path stays inside its root")
    return full
