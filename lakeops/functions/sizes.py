"""Byte-size expressions: bins, megabytes, guarded averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_MB = 1024 * 1024

# Bin labels with their exclusive upper bound in MB, smallest
# first, and the label of everything at or above the last bound.
SIZE_BINS = [("<1MB", 1), ("1MB-10MB", 10), ("10MB-100MB", 100)]
LARGEST_BIN = ">100MB"
BIN_LABELS = [label for label, _ in SIZE_BINS] + [LARGEST_BIN]


def size_bin(size: Column, unknown_label: str | None = None) -> Column:
    """Label of the half-open bin a byte size falls in.

    A NULL size is counted as the largest bin unless ``unknown_label`` names a
    bin of its own.
    """
    binned = F.lit(LARGEST_BIN)
    for label, upper_mb in reversed(SIZE_BINS):
        binned = F.when(size < upper_mb * BYTES_PER_MB, label).otherwise(binned)
    if unknown_label is not None:
        binned = F.when(size.isNull(), unknown_label).otherwise(binned)
    return binned


def to_mb(size: Column) -> Column:
    return size / F.lit(BYTES_PER_MB)


def average_or_zero(total: Column, count: Column) -> Column:
    """``total / count``, 0 where nothing was counted."""
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def sum_or_zero(size: Column) -> Column:
    return F.coalesce(F.sum(size), F.lit(0))
