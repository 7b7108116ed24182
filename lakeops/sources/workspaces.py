"""Workspace exports: raw records, normalised records and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.session import new_work_dir

# Fields of a raw record and of a normalised one, and the columns
# of the CSV export.
RAW_FIELDS = ["name", "id", "location", "workspaceUrl", "subscriptionId", "resourceGroup"]
RECORD_FIELDS = [
    "subscription_id",
    "account_id",
    "workspace_name",
    "workspace_id",
    "tenant_id",
    "resource_group",
    "azure_resource_id",
    "workspace_url",
]
CSV_FIELDS = RECORD_FIELDS[:5]


def strings(fields: list[str], *more: str) -> str:
    return ", ".join([f"{name} STRING" for name in fields] + list(more))


def _read_arrays(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Records of JSON array files, with the positions their order gives them.

    Files come in the order of the last number in their name, files of equal or no
    number by name, and records in that of their array: positions count all records
    before. A ``pos`` field of a record wins over its place.

    Arrays are parsed once, from the file's stream, and their records written with the
    number they have in that read; counts of files and places in them come from there.
    """
    place = F.monotonically_increasing_id()
    parsed = spark.read.schema(strings(names, "pos BIGINT")).json(
        path, multiLine=True, mode="FAILFAST"
    )
    kept = new_work_dir(spark, "records")
    parsed.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("file_name"),
        place.alias("place"),
    ).write.parquet(kept)
    rows = spark.read.parquet(kept)
    # One row per file is put in order. A file is one piece of the scan, so its records
    # are numbered without a gap.
    number = F.regexp_extract("file_name", r"(\d+)\D*$", 1).try_cast("decimal(38,0)")
    before = F.sum("size").over(
        Window.orderBy(number.asc_nulls_first(), "file_name", "file").rowsBetween(
            Window.unboundedPreceding, -1
        )
    )
    sizes = rows.groupBy("file", "file_name").agg(
        F.count("*").alias("size"), F.min("place").alias("first")
    )
    starts = sizes.select("file", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    position = F.coalesce("pos", F.col("start") + F.col("place"))
    return rows.join(starts, "file").select(*names, position.alias("pos"))


def _read(spark: SparkSession, path: str, fields: list[str], arrays: bool) -> DataFrame:
    if arrays:
        return _read_arrays(spark, path, fields)
    return spark.read.schema(strings(fields, "pos BIGINT")).json(path)


def read_raw_pages(spark: SparkSession, path: str, arrays: bool = True) -> DataFrame:
    """Raw records of all page files in a folder, in one scan, duplicates kept.

    A page is one JSON array, read by one task as a stream; with ``arrays`` off files hold
    one record per line, which Spark can split, and carry ``pos`` themselves.
    """
    return _read(spark, path, RAW_FIELDS, arrays)


def read_records(spark: SparkSession, path: str, arrays: bool = True) -> DataFrame:
    """Normalised records from a JSON array file or a folder of them."""
    return _read(spark, path, RECORD_FIELDS, arrays)


def write_json(records: DataFrame, path: str) -> None:
    """One record per line; missing values are written as null fields."""
    records.write.option("ignoreNullFields", "false").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """The five identifying columns, with header and proper quoting."""
    records.select(*CSV_FIELDS).write.option("header", True).csv(path)
