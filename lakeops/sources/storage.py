"""Small metadata calls on the file system Spark itself uses.

Only names and manifests pass through here; data is always read
and written by Spark jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession

METADATA_THREADS = 32


def _open(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def on_each(call: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
    """``call`` on every item, many waiting for the file system at a time."""
    with ThreadPoolExecutor(METADATA_THREADS) as pool:
        return list(pool.map(call, items))


def qualify(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, the way Spark names files in it."""
    fs, hadoop_path = _open(spark, path)
    return fs.makeQualified(hadoop_path).toString().rstrip("/")


def as_url(spark: SparkSession, path: str) -> str:
    """A qualified path as Spark's file metadata spells it, percent-encoded."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _open(spark, path)
    return fs.exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, none when there is no such folder."""
    fs, hadoop_path = _open(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, hadoop_path = _open(spark, path)
    return fs.getContentSummary(hadoop_path).getLength() if fs.exists(hadoop_path) else 0


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _open(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file that appears whole or not at all; False if it exists."""
    fs, final = _open(spark, path)
    if fs.exists(final):
        return False
    draft = final.suffix(f".{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    return fs.rename(draft, final)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    fs, source_path = _open(spark, source)
    _, target_path = _open(spark, target)
    fs.mkdirs(target_path.getParent())
    return fs.rename(source_path, target_path)


def delete_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _open(spark, path)
    return fs.delete(hadoop_path, True)


def as_literal_path(path: str) -> str:
    """``path`` with glob characters escaped, for readers that expand globs."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)
