"""Size statistics and size distribution of data files, any number of tables at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions.sizes import BIN_LABELS, average_or_zero, size_bin, sum_or_zero, to_mb

TABLE = "table_name"
FAULT = "fault"

# What a text report shows of the descriptive statistics.
REPORTED_STATS = ["min", "max", "mean", "stddev"]
TOTALS = [
    "total_size_bytes",
    "total_size_mb",
    "num_files",
    "average_file_size_bytes",
    "average_file_size_mb",
]


def _totals(files: DataFrame) -> list[Column]:
    """Totals of each table; rows with a fault are no files, and the first is its error."""
    faulty = FAULT in files.columns
    count = F.count_if(F.col(FAULT).isNull()) if faulty else F.count("*")
    error = [F.min(FAULT).alias("error")] if faulty else []
    return [*_sums(count), *error]


def _sums(files: Column) -> list[Column]:
    total = sum_or_zero(F.col("size_in_bytes"))
    average = average_or_zero(total, files)
    return [
        total.alias("total_size_bytes"),
        to_mb(total).alias("total_size_mb"),
        files.alias("num_files"),
        average.alias("average_file_size_bytes"),
        to_mb(average).alias("average_file_size_mb"),
    ]


def _descriptive_stats() -> Column:
    size = F.col("size_in_bytes")
    stats = {
        "count": F.count(size),
        "mean": F.avg(size),
        "stddev": F.stddev_samp(size),
        "min": F.min(size),
        "max": F.max(size),
    }
    return F.struct(*[value.cast("double").alias(name) for name, value in stats.items()]).alias(
        "descriptive_stats"
    )


def _bins(count: Callable[[str], Column]) -> Column:
    return F.array(
        *[F.struct(F.lit(name).alias("size_bin"), count(name).alias("count")) for name in BIN_LABELS]
    )


def _bin_counts() -> Column:
    label = size_bin(F.col("size_in_bytes"))
    return _bins(lambda name: F.count_if(label == name)).alias("size_distribution")


def file_size_statistics(files: DataFrame, descriptive: bool = True) -> DataFrame:
    """One row of size statistics per table with files.

    The average divides by all files, the descriptive mean by those of known size.
    """
    extra = [_descriptive_stats()] if descriptive else []
    return files.groupBy(TABLE).agg(*_totals(files), *extra)


def file_profile(files: DataFrame) -> DataFrame:
    """Statistics and distribution of each table from a single pass over its files."""
    return files.groupBy(TABLE).agg(*_totals(files), _descriptive_stats(), _bin_counts())


def file_size_distribution(files: DataFrame, unknown_label: str | None = None) -> DataFrame:
    """Number of files per table and size bin; bins without files do not appear."""
    label = size_bin(F.col("size_in_bytes"), unknown_label)
    return files.groupBy(TABLE, label.alias("size_bin")).count()


def partial_profile(files: DataFrame) -> DataFrame:
    """Partial figures of each table, from which a profile and larger partials follow.

    ``deviations`` are the squares of distances from the partial's own mean, added up.
    """
    size = F.col("size_in_bytes")
    known = F.count(size)
    label = size_bin(size)
    faulty = FAULT in files.columns
    return files.groupBy(TABLE).agg(
        (F.count_if(F.col(FAULT).isNull()) if faulty else F.count("*")).alias("files"),
        known.alias("known"),
        F.sum(size).alias("bytes"),
        (F.var_pop(size) * known).alias("deviations"),
        F.min(size).alias("low"),
        F.max(size).alias("high"),
        *[F.count_if(label == name).alias(f"bin_{i}") for i, name in enumerate(BIN_LABELS)],
        *([F.min(FAULT).alias("error")] if faulty else []),
    )


def merged_partials(partials: DataFrame, *latest: str) -> DataFrame:
    """One partial a table out of several; of the columns ``latest`` the largest value stays.

    Deviations are moved from each part's mean to the common one, so nothing is lost to
    the difference of large squares.
    """
    every = Window.partitionBy(TABLE)
    moved = F.col("bytes") / F.col("known") - F.col("all_bytes") / F.col("all_known")
    counts = ["files", "known", *[f"bin_{i}" for i in range(len(BIN_LABELS))]]
    return (
        partials.withColumns(
            {"all_bytes": F.sum("bytes").over(every), "all_known": F.sum("known").over(every)}
        )
        .withColumn(
            "deviations",
            F.when(F.col("known") > 0, F.col("deviations") + F.col("known") * moved * moved),
        )
        .groupBy(TABLE)
        .agg(
            *[F.sum(name).alias(name) for name in [*counts, "bytes", "deviations"]],
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            *[F.max(name).alias(name) for name in latest],
        )
    )


def profile_of(partials: DataFrame) -> DataFrame:
    """The profile that one partial a table gives, as ``file_profile`` of all its files."""
    known, files = F.col("known"), F.col("files")
    total = F.coalesce("bytes", F.lit(0))
    average = average_or_zero(total, files)
    spread = F.when(known > 1, F.sqrt(F.col("deviations") / F.nullif(known - 1, F.lit(0))))
    stats = {
        "count": known,
        "mean": F.when(known > 0, F.col("bytes") / F.nullif(known, F.lit(0))),
        "stddev": spread,
        "min": F.col("low"),
        "max": F.col("high"),
    }
    place = {name: f"bin_{i}" for i, name in enumerate(BIN_LABELS)}
    return partials.select(
        TABLE,
        total.alias("total_size_bytes"),
        to_mb(total).alias("total_size_mb"),
        files.alias("num_files"),
        average.alias("average_file_size_bytes"),
        to_mb(average).alias("average_file_size_mb"),
        F.struct(*[value.cast("double").alias(name) for name, value in stats.items()]).alias(
            "descriptive_stats"
        ),
        _bins(lambda name: F.col(place[name])).alias("size_distribution"),
    )


def distribution_of(profile: DataFrame, empty_bins: bool = False) -> DataFrame:
    """The distribution rows held in a profile, on request with the empty bins."""
    rows = profile.select(TABLE, F.inline("size_distribution"))
    return rows if empty_bins else rows.filter(F.col("count") > 0)


def for_tables(tables: DataFrame, profile: DataFrame) -> DataFrame:
    """A row for every listed table, zeros for those without files."""
    no_files = _bins(lambda name: F.lit(0).cast("bigint"))
    return (
        tables.join(profile, TABLE, "left")
        .fillna(dict.fromkeys(TOTALS, 0))
        .withColumn("size_distribution", F.coalesce("size_distribution", no_files))
    )


def without_figures(profile: DataFrame) -> DataFrame:
    """A profile in which tables with an ``error``, the last column, have no figures."""
    figures = [c for c in profile.columns if c not in (TABLE, "error")]
    return profile.select(
        TABLE, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in figures], "error"
    )


def configured_statistics(control: DataFrame, statistics: DataFrame) -> DataFrame:
    """Statistics of the tables a control selection names."""
    return statistics.join(control.select(TABLE).distinct(), TABLE)


def report(profile: DataFrame) -> DataFrame:
    """Long form ``(table_name, metric, value)`` of a profile, for printing."""
    metrics = [(name, F.col(name)) for name in TOTALS]
    metrics += [(name, F.col("descriptive_stats")[name]) for name in REPORTED_STATS]
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in metrics
        ]
    )
    bins = F.transform(
        F.filter("size_distribution", lambda row: row["count"] > 0),
        lambda row: F.struct(
            row["size_bin"].alias("metric"), row["count"].cast("double").alias("value")
        ),
    )
    return profile.select(TABLE, F.inline(F.concat(lines, bins))).filter(
        F.col("value").isNotNull()
    )
