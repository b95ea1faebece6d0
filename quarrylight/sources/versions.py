"""Versions of a folder of tables: numbered manifests, each published whole by one rename that never replaces a file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's Path and the FileContext that it belongs to."""
    fs = spark._jvm.org.apache.hadoop.fs
    found = fs.Path(path)
    qualified = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found)
    return qualified, fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first; none for a new folder."""
    path, _ = _hadoop(spark, f"{root}/{FOLDER}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """The number and the manifest of a version, the newest by default; (0, {}) for a new folder."""
    if version is None:
        version = max(numbers(spark, root), default=0)
    if version == 0:
        return 0, {}
    path, _ = _hadoop(spark, f"{root}/{FOLDER}/{version:08d}.json")
    text = spark.sparkContext.wholeTextFiles(path.toString(), 1).values().collect()
    return version, json.loads(text[0])


def publish(spark: SparkSession, root: str, after: int, content: dict) -> int:
    """Publish ``content`` as the version that follows ``after``; Conflict if there is one already.

    The manifest is written under another name and renamed without replacing, so readers see the old version or the
    new one, and of two writers that began at the same version one fails. A writer that dies leaves the old version.
    """
    version = after + 1
    target, context = _hadoop(spark, f"{root}/{FOLDER}/{version:08d}.json")
    draft, _ = _hadoop(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        system.delete(draft, False)
        if system.exists(target):
            raise Conflict(f"version {version} of {root} is published already") from error
        raise
    return version
