"""Inputs the library reads, derived from the driver's tables by fixed rules.

Each rule exists twice: as a DataFrame here and as SQL text the oracles share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ACTION_FIELDS = (
    "STRUCT<path: STRING, size: BIGINT, dataChange: BOOLEAN, modificationTime: BIGINT>",
    "STRUCT<path: STRING, dataChange: BOOLEAN, deletionTimestamp: BIGINT>",
)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit log per order priority: ten days of adds, then removes and rewrites."""
    add_type, remove_type = ACTION_FIELDS
    day = F.col("o_orderkey") % 10
    path = F.concat(F.lit("part-"), F.col("o_orderkey"))
    size = (F.round(F.col("o_totalprice") * 100) * 10).cast("bigint")

    def action(version, add_size, removes):
        add = F.struct(path, add_size, F.lit(True), F.lit(0).cast("bigint")).cast(add_type)
        remove = F.struct(path, F.lit(True), F.lit(0).cast("bigint")).cast(remove_type)
        return F.struct(
            version.alias("version"),
            (F.lit(None).cast(add_type) if removes else add).alias("add"),
            (remove if removes else F.lit(None).cast(remove_type)).alias("remove"),
        )

    status = F.col("o_orderstatus")
    first = F.array(action(2 * day, size, False))
    every = (
        F.when((status == "F") & (day < 5), F.concat(first, F.array(action(2 * day + 2, size, True))))
        .when(status == "P", F.concat(first, F.array(action(day + 20, size + 1, False))))
        .otherwise(first)
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("table_name"),
        F.concat(F.lit("/lake/"), F.col("o_orderpriority"), F.lit("/")).alias("location"),
        F.inline(every),
    )


ACTIONS_SQL = """
first_adds AS (
  SELECT o_orderpriority AS table_name, 2 * (o_orderkey % 10) AS version,
         'part-' || o_orderkey AS path, CAST(round(o_totalprice * 100) * 10 AS BIGINT) AS size,
         o_orderkey % 10 AS d, o_orderstatus AS status
  FROM orders),
actions AS (
  SELECT table_name, version, path, size, TRUE AS is_add FROM first_adds
  UNION ALL
  SELECT table_name, version + 2, path, NULL, FALSE FROM first_adds WHERE status = 'F' AND d < 5
  UNION ALL
  SELECT table_name, 20 + d, path, size + 1, TRUE FROM first_adds WHERE status = 'P'),
adds AS (SELECT * FROM actions WHERE is_add),
live AS (
  SELECT * FROM actions
  QUALIFY row_number() OVER (PARTITION BY table_name, path ORDER BY version DESC, is_add DESC) = 1
     AND is_add),
append_only AS (
  SELECT a.* FROM adds a WHERE NOT EXISTS (
    SELECT 1 FROM actions r
    WHERE NOT r.is_add AND r.table_name = a.table_name AND r.version = a.version))
"""
