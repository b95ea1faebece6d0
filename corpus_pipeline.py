"""A training corpus from raw documents: quality rules, near-duplicate and passage removal, secret redaction, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All stages but
the last return the columns of ``documents``. Stages take null, empty and very long texts,
repeated rows, empty tables and extra columns as their operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import neardup, packing, quality, secrets, suffixes
from quarrylight.llm._common import arrow_batches, table, write_shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps; a null text fails the least number of words."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares 80% of its five-word shingles."""
    arrow_batches(spark)
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id holds."""
    arrow_batches(spark)
    return suffixes.remove_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found secret replaced by a mark."""
    arrow_batches(spark)
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts, placed in sequences of 2048."""
    arrow_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_duplicates),
    ("repeated-passage removal", repeated_passages),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Sketch links, suffix order, a trained network and tokenization are beyond SQL; tests/llm/test_pipeline.py restates the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
