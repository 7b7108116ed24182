"""Control-table selections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import name_list
from lakeops.operators import control
from lakeops.session import new_work_dir
from lakeops.sources.control import IngestionConfig, read_name_list
from spark_queries import inputs

SOURCE = "ASIA"


def control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control row per customer: source by region, some skipped, some without a flag."""
    key = F.col("c_custkey")
    nations = inputs.table(spark, sf_dir, "nation").join(
        inputs.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        inputs.table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_name").alias("table_name"),
            F.when(key % 7 != 0, F.concat("c_name", F.lit("_INC"))).alias("inc_table_name"),
            F.col("r_name").alias("source_system"),
            F.when(key % 5 == 0, "Y").when(key % 11 != 1, "N").alias("skip_table"),
        )
    )


CONTROL_SQL = """
control AS (
  SELECT c_name AS table_name,
         CASE WHEN c_custkey % 7 <> 0 THEN c_name || '_INC' END AS inc_table_name,
         r_name AS source_system,
         CASE WHEN c_custkey % 5 = 0 THEN 'Y' WHEN c_custkey % 11 <> 1 THEN 'N' END AS skip_table
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def registered(spark: SparkSession, rows: DataFrame, **config: object) -> IngestionConfig:
    view = f"control_{uuid.uuid4().hex[:12]}"
    rows.createOrReplaceTempView(view)
    return IngestionConfig(spark, schema_name="staging", config_table=view, **config)


def control_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered(spark, control_rows(spark, sf_dir)).rows()


def control_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source, and only tables of customers with a debt."""
    indebted = (
        inputs.table(spark, sf_dir, "customer")
        .filter("c_acctbal < 0")
        .select(F.col("c_name").alias("table_name"))
    )
    return registered(spark, control_rows(spark, sf_dir), source_name=SOURCE).rows(indebted)


def control_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered(spark, control_rows(spark, sf_dir), source_name=SOURCE).table_list()


def control_no_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list from a control table without the incremental column."""
    rows = control_rows(spark, sf_dir).drop("inc_table_name")
    return registered(spark, rows).table_list()


def control_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection of an environment whose filter is the segment it is named after."""
    segments = {"DEV": ["BUILDING"], "PRD": ["MACHINERY", "HOUSEHOLD"]}
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey"),
        F.col("c_mktsegment").alias("table_name"),
        F.when(F.col("c_custkey") % 5 == 0, "Y").otherwise("N").alias("skip_table"),
    )
    chosen = control.environment_filter("prd", segments)
    return control.select_rows(rows, table_filter=chosen)


def name_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a CSV list, then a comma-separated list of each cut into names."""
    path = new_work_dir(spark, "names")
    inputs.table(spark, sf_dir, "part").select(F.col("p_type").alias("table_name")).write.csv(
        path, header=True
    )
    names = read_name_list(spark, path)
    pairs = F.concat(F.lower("table_name"), F.lit(", "), F.col("table_name"))
    return names.select(name_list(pairs).alias("table_name")).groupBy("table_name").agg(
        F.count("*").alias("listed")
    )


QUERIES = {
    "control_select": control_select,
    "control_filtered": control_filtered,
    "control_list": control_list,
    "control_no_incremental": control_no_incremental,
    "control_env": control_env,
    "name_list": name_list_query,
}

COLUMNS = "table_name, inc_table_name, source_system, skip_table"

ORACLES = {
    "control_select": f"WITH {CONTROL_SQL} SELECT {COLUMNS} FROM control WHERE skip_table = 'N'",
    "control_filtered": f"""WITH {CONTROL_SQL}
SELECT {COLUMNS} FROM control WHERE skip_table = 'N' AND source_system = '{SOURCE}'
  AND table_name IN (SELECT c_name FROM customer WHERE c_acctbal < 0)""",
    "control_list": f"""WITH {CONTROL_SQL}
SELECT table_name, inc_table_name, inc_table_name IS DISTINCT FROM table_name AS is_incremental
FROM control WHERE skip_table = 'N' AND source_system = '{SOURCE}'""",
    "control_no_incremental": f"""WITH {CONTROL_SQL}
SELECT table_name, table_name AS inc_table_name, FALSE AS is_incremental
FROM control WHERE skip_table = 'N'""",
    "control_env": """SELECT c_custkey, c_mktsegment AS table_name, 'N' AS skip_table
FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')""",
    "name_list": """SELECT table_name, count(*) AS listed FROM (
  SELECT lower(p_type) AS table_name FROM part UNION ALL SELECT ' ' || p_type FROM part)
GROUP BY table_name""",
}
