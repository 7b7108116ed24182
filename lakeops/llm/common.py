"""Helpers shared by the operators: intermediate tables, words of a batch, hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.operators.upsert import unused_name
from lakeops.session import new_work_dir

#: White space of the contracts, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PIECE_BYTES = 1 << 23


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared work folder and read back.

    Cuts the lineage: what follows survives lost executors without computing the
    steps before it again, and a frame used twice is computed once.
    """
    spark = df.sparkSession
    path = new_work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that tell its rows apart in every read, and their names.

    A row of a Parquet file is known by a hash of the file's name and its place in the
    file, which do not depend on how Spark splits a read. Where rows have no such place, or
    not one each, as after a join, and where two files share a hash, the rows are written
    once with numbers and read from there.
    """
    names = [unused_name(docs, "row_file"), unused_name(docs, "row_place")]
    if "_metadata" not in docs.columns:
        try:
            path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
            found = docs.withColumns({names[0]: F.xxhash64(path), names[1]: place})
            files = docs.select(path.alias("path")).distinct().agg(
                F.count("*"), F.count_distinct(F.xxhash64("path"))
            )
        except AnalysisException:
            pass
        else:
            twice = found.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")
            if len(set(files.first())) == 1 and twice.isEmpty():
                return found, names
    numbers = {names[0]: F.lit(0).cast("long"), names[1]: F.monotonically_increasing_id()}
    return stored(docs.withColumns(numbers), "keyed-rows"), names


def numbered(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with a dense 0-based rank over all rows in the given order.

    Rows are range-partitioned and sorted; only one count per partition is summed
    in one place, never the rows themselves.
    """
    local = "__local_rank"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn(local, F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col(local), 33)
    counts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("__rows").over(ahead)
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.col(local).bitwiseAND((1 << 33) - 1)
    return (
        kept.withColumn("__part", part)
        .join(offsets, "__part")
        .withColumn(name, F.col("__before") + inside)
        .drop("__part", "__before", local)
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1), one per 64-bit key; the same key gives the same number."""
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    values = strings.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(values.astype(object), categorize=False)


def worker_cache(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` once made in this Python process, for all tasks it runs."""
    name = "lakeops_worker_cache"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class Words:
    """The white-space separated words of a batch of texts, dictionary-encoded.

    ``codes[offsets[i]:offsets[i + 1]]`` are the words of text i as indexes of
    ``vocabulary``, a string array without repeats.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        # A copy: kernels on strings misread slices of other arrays.
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")
        if lower:
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        flat = split.flatten()
        encoded = flat.dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), sizes)
        vocabulary = encoded.dictionary
        filled = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False) > 0
        if not filled.all():
            keep = filled[codes]
            codes, owner = codes[keep], owner[keep]
        self.vocabulary = vocabulary
        self.codes = codes
        self.owner = owner
        self.counts = np.bincount(owner, minlength=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])


def pieces(batch: pa.RecordBatch, column: str, limit: int = _PIECE_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes; a row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def spread(df: DataFrame, spark: SparkSession, *keys: Column) -> DataFrame:
    """``df`` dealt by keys to as many partitions as the session shuffles to."""
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
