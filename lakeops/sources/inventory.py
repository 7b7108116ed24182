"""Where tables lie and which data files they have."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import small_table
from lakeops.sources import storage


def table_location(spark: SparkSession, name: str) -> str:
    """Folder of a catalog table; a name with a slash is taken as the folder itself."""
    if "/" in name:
        return name.rstrip("/")
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()
    location = json.loads(detail[0]).get("location")
    if not location:
        raise ValueError(f"{name} has no folder of its own")
    return location


def resolve_locations(
    spark: SparkSession, names: Iterable[str]
) -> tuple[dict[str, str], dict[str, str]]:
    """Locations of the tables that have one, and the error of each other table."""

    def resolve(name: str) -> tuple[str, str | None, str | None]:
        try:
            return name, table_location(spark, name), None
        except (PySparkException, ValueError) as error:
            return name, None, str(error)

    found = storage.on_each(resolve, dict.fromkeys(names))
    return (
        {name: location for name, location, _ in found if location},
        {name: error for name, _, error in found if error},
    )


def root_key(path: Column) -> Column:
    """``path`` in one spelling, whatever number of slashes follows ``file:``."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_file_inventory(
    spark: SparkSession, locations: Mapping[str, str], glob: str | None = None
) -> DataFrame:
    """Data files below many folders, in one listing; file contents are not read.

    Files of every format count, but not those in or under names that begin with an
    underscore or a dot, which Spark takes for hidden. ``glob`` narrows file names.
    """
    roots = {name: storage.qualify(spark, location) for name, location in locations.items()}
    narrowed = {"pathGlobFilter": glob} if glob else {}
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup="true", **narrowed)
        .load([storage.as_literal_path(root) for root in sorted(set(roots.values()))])
        .select(root_key(F.col("path")).alias("full_path"), F.col("length").alias("size_in_bytes"))
    )
    tables = small_table(
        spark,
        [(name, locations[name], root) for name, root in roots.items()],
        "table_name",
        "location",
        "root",
    ).withColumn("root", root_key(F.col("root")))
    # A file belongs to a table if the table's folder is one of its ancestors; only
    # ancestors as deep as some table's folder are looked at.
    steps = F.split("full_path", "/")
    depths = sorted({re.sub("^file:/+", "/", root).count("/") + 1 for root in roots.values()})
    ancestors = F.transform(
        F.filter(F.array(*map(F.lit, depths)), lambda n: n < F.size(steps)),
        lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"),
    )
    return (
        files.withColumn("root", F.explode(ancestors))
        .join(tables, "root")
        .filter(~F.substr("full_path", F.length("root") + 1).rlike(r"/[_.][^=]*(/|$)"))
        .select(
            "table_name",
            "location",
            F.substr("full_path", F.length("root") + 2).alias("relative_path"),
            "size_in_bytes",
            "full_path",
        )
    )
