"""Workspace records, hierarchy and inventory profile."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import hierarchy, workspaces
from lakeops.operators.profile import (
    SYSTEM_CATALOGS,
    Inventory,
    metrics,
    profile,
    schema_counts,
)
from lakeops.session import new_work_dir
from lakeops.sources import storage
from lakeops.sources import workspaces as files
from spark_queries import inputs

TENANT = "tenant-1"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace per customer; some without URL, some with a web page's instead."""
    key = F.col("c_custkey")
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    nations = inputs.table(spark, sf_dir, "nation").join(
        inputs.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        inputs.table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(pages, F.when(key % 10 == 1, key) == F.col("page_id"), "left")
        .select(
            F.col("c_name").alias("name"),
            F.concat(F.lit("/workspaces/"), key).alias("id"),
            F.col("n_name").alias("location"),
            F.when(key % 10 == 1, F.coalesce("url", F.lit("https://example.org/none")))
            .when(key % 10 != 0, F.concat(F.lit("adb-"), key, F.lit(".1.example.net")))
            .alias("workspaceUrl"),
            F.col("r_name").alias("subscriptionId"),
            F.col("c_mktsegment").alias("resourceGroup"),
            key.alias("pos"),
        )
    )


RAW_SQL = """
raw AS (
  SELECT c_name AS name, '/workspaces/' || c_custkey AS id, n_name AS location,
         CASE WHEN c_custkey % 10 = 1 THEN coalesce(url, 'https://example.org/none')
              WHEN c_custkey % 10 <> 0 THEN 'adb-' || c_custkey || '.1.example.net' END
           AS workspaceUrl,
         r_name AS subscriptionId, c_mktsegment AS resourceGroup, c_custkey AS pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN pages ON c_custkey % 10 = 1 AND page_id = c_custkey),
records AS (
  SELECT subscriptionId AS subscription_id, '' AS account_id, name AS workspace_name,
         coalesce(regexp_extract(workspaceUrl, 'adb-([0-9]+)', 1), '') AS workspace_id,
         'tenant-1' AS tenant_id, resourceGroup AS resource_group, id AS azure_resource_id,
         coalesce(workspaceUrl, '') AS workspace_url, pos
  FROM raw WHERE workspaceUrl IS NULL OR regexp_matches(workspaceUrl, 'adb-[0-9]+')),
owners AS (
  SELECT resource_group, arg_min(subscription_id, pos) AS subscription_id, min(pos) AS pos,
         count(*) AS workspace_count
  FROM records GROUP BY resource_group)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.normalise(raw_records(spark, sf_dir), TENANT)


def workspace_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.normalise(raw_records(spark, sf_dir), TENANT, keep_unmatched=True)


def workspace_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.search(raw_records(spark, sf_dir), TENANT, "7")


def workspace_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.match_count(raw_records(spark, sf_dir), "7")


def workspace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as page files of JSON arrays and read back in one scan."""
    path = new_work_dir(spark, "pages")
    (
        raw_records(spark, sf_dir)
        .groupBy(F.floor(F.col("pos") / 1000))
        .agg(F.to_json(F.collect_list(F.struct(*files.RAW_FIELDS, "pos"))).alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return files.read_raw_pages(spark, path)


def workspace_pages_unpositioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without positions, in page files named by a date and a number."""
    path = new_work_dir(spark, "pages")
    page = F.floor(F.col("pos") / 40).cast("string")
    pages = (
        raw_records(spark, sf_dir)
        .groupBy(page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", *files.RAW_FIELDS))).alias("records"))
        .select(
            "page", F.to_json(F.transform("records", lambda r: r.dropFields("pos"))).alias("value")
        )
    )
    pages.repartition("page").write.partitionBy("page").text(path)
    folders = [n for n in storage.child_names(spark, path) if n.startswith("page=")]

    def rename(folder: str) -> None:
        for name in storage.child_names(spark, f"{path}/{folder}"):
            if name.endswith(".txt"):
                target = f"{path}/pages/2026-12-01_page{folder.split('=')[1]}.json"
                storage.rename(spark, f"{path}/{folder}/{name}", target)

    storage.on_each(rename, folders)
    return files.read_raw_pages(spark, f"{path}/pages")


def workspace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the JSON export joined to those of the CSV export."""
    root = new_work_dir(spark, "export")
    files.write_json(records(spark, sf_dir), f"{root}/json")
    files.write_csv(records(spark, sf_dir), f"{root}/csv")
    exported = files.read_records(spark, f"{root}/json", arrays=False)
    listed = spark.read.csv(
        f"{root}/csv", header=True, schema=files.strings(files.CSV_FIELDS), emptyValue=""
    )
    names = listed.select("workspace_name", F.col("workspace_id").alias("csv_id"))
    return exported.join(names, "workspace_name").withColumn(
        "csv_id", F.coalesce("csv_id", F.lit(""))
    )


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nodes(records(spark, sf_dir))


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.edges(records(spark, sf_dir))


def hierarchy_edges_by_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.edges(records(spark, sf_dir), by_subscription=True)


def hierarchy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.group_owners(records(spark, sf_dir))


def hierarchy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.group_workspaces(records(spark, sf_dir))


def _look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose names differ from those of two others in one unsafe character."""
    serial = F.substring_index("workspace_name", "#", -1).cast("bigint")
    sign = F.element_at(F.array(*map(F.lit, "#-.")), (serial % 3 + 1).cast("int"))
    return records(spark, sf_dir).withColumn(
        "workspace_name", F.concat(F.lit("w"), sign, F.floor(serial / 3).cast("string"))
    )


def hierarchy_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.collisions(_look_alikes(spark, sf_dir))


def hierarchy_told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ids tell every node from those that look like it."""
    return hierarchy.edges(_look_alikes(spark, sf_dir), by_subscription=True, told_apart=True)


def inventory(spark: SparkSession, sf_dir: str, shared: str = "s_acctbal > 1e9") -> Inventory:
    customers = inputs.table(spark, sf_dir, "customer")
    suppliers = inputs.table(spark, sf_dir, "supplier")
    regions = inputs.table(spark, sf_dir, "region")
    nations = inputs.table(spark, sf_dir, "nation")
    system = spark.createDataFrame(
        [(name, None) for name in [*SYSTEM_CATALOGS, None]],
        "full_name STRING, securable_kind STRING",
    )
    kind = F.when(F.col("r_regionkey") == 2, "CATALOG_DELTASHARING").otherwise("CATALOG_STANDARD")
    by_nation = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return Inventory(
        catalogs=regions.select(F.col("r_name").alias("full_name"), kind.alias("securable_kind"))
        .unionByName(system),
        schemas=by_nation.select(
            F.col("r_name").alias("catalog_name"), F.col("s_name").alias("schema_name")
        ),
        users=customers.select(F.col("c_name").alias("display_name")),
        # One row per piece of a segment: no group's members meet in one array.
        groups=customers.groupBy(
            F.col("c_mktsegment").alias("display_name"), F.floor(F.col("c_custkey") / 1000)
        )
        .agg(F.collect_list("c_name").alias("members"))
        .select("display_name", "members"),
        service_principals=suppliers.select(F.col("s_name").alias("display_name")),
        warehouses=suppliers.select(
            F.col("s_name").alias("name"),
            (F.col("s_suppkey") % 2 == 0).alias("enable_serverless_compute"),
        ),
        shares=suppliers.filter(shared).select(F.col("s_name").alias("name")),
        experiments=inputs.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")),
    )


def inventory_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(
        spark,
        inventory(spark, sf_dir),
        user="Customer#000000007",
        workspace_id="7",
        host="adb-7.1.example.net",
        admin_group="BUILDING",
    )


def inventory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(inventory_profile(spark, sf_dir))


def inventory_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = inventory(spark, sf_dir)
    return schema_counts(listed.catalogs, listed.schemas)


def inventory_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sharing is used: with neither sign of it, with a share, with such a catalog."""
    plain = inventory(spark, sf_dir)
    sharing = F.col("securable_kind").contains("SHARING")
    unshared = replace(plain, catalogs=plain.catalogs.filter(~F.coalesce(sharing, F.lit(False))))
    cases = {
        "neither": unshared,
        "share": replace(unshared, shares=inventory(spark, sf_dir, "s_acctbal < 1e9").shares),
        "catalog": plain,
    }
    rows = [
        profile(spark, case).select(F.lit(name).alias("case"), "uses_sharing")
        for name, case in cases.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {
    "workspace_normalise": records,
    "workspace_unmatched": workspace_unmatched,
    "workspace_search": workspace_search,
    "workspace_match_count": workspace_match_count,
    "workspace_pages": workspace_pages,
    "workspace_pages_unpositioned": workspace_pages_unpositioned,
    "workspace_export": workspace_export,
    "hierarchy_nodes": hierarchy_nodes,
    "hierarchy_edges": hierarchy_edges,
    "hierarchy_edges_by_subscription": hierarchy_edges_by_subscription,
    "hierarchy_collisions": hierarchy_collisions,
    "hierarchy_told_apart": hierarchy_told_apart,
    "hierarchy_groups": hierarchy_groups,
    "hierarchy_members": hierarchy_members,
    "inventory_profile": inventory_profile,
    "inventory_metrics": inventory_metrics,
    "inventory_schemas": inventory_schemas,
    "inventory_sharing": inventory_sharing,
}


def _safe(expression: str) -> str:
    return f"regexp_replace({expression}, '[^a-zA-Z0-9]', '_', 'g')"


RECORDS = ", ".join(files.RECORD_FIELDS)
SUB_ID = f"'Sub_' || {_safe('subscription_id')}"
RG_ID = f"'RG_' || {_safe('resource_group')}"
SUB_RG_ID = "'RG_' || " + _safe("subscription_id || '_' || resource_group")
WS_ID = f"'WS_' || {_safe('workspace_name')}"

LOOK_ALIKES_SQL = """
alike AS (
  SELECT * REPLACE ('w' || ['#', '-', '.'][CAST(serial % 3 + 1 AS INT)] || (serial // 3) AS workspace_name)
  FROM (SELECT *, CAST(split_part(workspace_name, '#', 2) AS BIGINT) AS serial FROM records))
"""


def _hash(*parts: str) -> str:
    whole = " || ".join(f"length({part}) || ':' || {part}" for part in parts)
    return f"'_' || left(sha256({whole}), 16)"


SUB_APART = f"{SUB_ID} || {_hash('subscription_id')}"
RG_APART = f"{SUB_RG_ID} || {_hash('subscription_id', 'resource_group')}"
WS_APART = f"{WS_ID} || {_hash('workspace_name', 'workspace_id')}"

PROFILE_SQL = """
profile AS (
  SELECT
    (SELECT coalesce(bool_or(c_mktsegment = 'BUILDING' AND c_name = 'Customer#000000007'), FALSE)
     FROM customer) AS is_admin,
    'Not Available' AS account_id, '7' AS workspace_id,
    'adb-7.1.example.net' AS workspace_url, 'Not Available' AS workspace_name,
    'adb-7' AS platform,
    (SELECT coalesce(bool_or(s_suppkey % 2 = 0), FALSE) FROM supplier) AS uses_serverless,
    TRUE AS uses_catalogs,
    (SELECT count(*) > 0 FROM supplier WHERE s_acctbal > 1e9)
      OR (SELECT coalesce(bool_or(r_regionkey = 2), FALSE) FROM region) AS uses_sharing,
    (SELECT count(*) > 0 FROM part) AS uses_experiments,
    (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS schema_count,
    (SELECT count(*) + 3 FROM region) AS catalog_count,
    (SELECT count(*) FROM customer) AS user_count,
    (SELECT count(*) FROM (SELECT DISTINCT c_mktsegment, c_custkey // 1000 FROM customer))
      AS group_count,
    (SELECT count(*) FROM supplier) AS service_principal_count)
"""
PROFILE_COLUMNS = [
    "is_admin", "account_id", "workspace_id", "workspace_url", "workspace_name", "platform",
    "uses_serverless", "uses_catalogs", "uses_sharing", "uses_experiments", "schema_count",
    "catalog_count", "user_count", "group_count", "service_principal_count",
]

ORACLES = {
    "workspace_normalise": f"WITH {RAW_SQL} SELECT {RECORDS}, pos FROM records",
    "workspace_unmatched": f"""WITH {RAW_SQL}
SELECT subscriptionId AS subscription_id, '' AS account_id, name AS workspace_name,
       coalesce(regexp_extract(workspaceUrl, 'adb-([0-9]+)', 1), '') AS workspace_id,
       'tenant-1' AS tenant_id, resourceGroup AS resource_group, id AS azure_resource_id,
       coalesce(workspaceUrl, '') AS workspace_url, pos FROM raw""",
    "workspace_search": f"""WITH {RAW_SQL}
SELECT subscriptionId AS subscription_id, '' AS account_id, name AS workspace_name,
       regexp_replace(workspaceUrl, 'adb-([0-9]+)\\..*', '\\1') AS workspace_id,
       'tenant-1' AS tenant_id, resourceGroup AS resource_group, id AS azure_resource_id,
       coalesce(workspaceUrl, '') AS workspace_url, pos
FROM raw WHERE contains(name, '7')""",
    "workspace_match_count": f"""WITH {RAW_SQL}
SELECT count(*) AS match_count FROM raw WHERE contains(name, '7')""",
    "workspace_pages": f"""WITH {RAW_SQL}
SELECT name, id, location, workspaceUrl, subscriptionId, resourceGroup, pos FROM raw""",
    "workspace_pages_unpositioned": f"""WITH {RAW_SQL}
SELECT name, id, location, workspaceUrl, subscriptionId, resourceGroup,
       row_number() OVER (ORDER BY pos) - 1 AS pos FROM raw""",
    "workspace_export": f"""WITH {RAW_SQL}
SELECT {RECORDS}, pos, workspace_id AS csv_id FROM records""",
    "hierarchy_nodes": f"""WITH {RAW_SQL}
SELECT 'tenant' AS level, 'Tenant' AS node_id, 'Tenant: tenant-1' AS label, min(pos) AS pos
FROM records
UNION ALL
SELECT 'subscription', {SUB_ID}, 'Subscription: ' || subscription_id, min(pos)
FROM records GROUP BY subscription_id
UNION ALL
SELECT 'resource_group', {RG_ID}, 'Resource Group: ' || resource_group, pos FROM owners
UNION ALL
SELECT 'workspace', {WS_ID}, 'Workspace: ' || workspace_name || ' (' || workspace_id || ')', pos
FROM records""",
    "hierarchy_edges": f"""WITH {RAW_SQL}
SELECT 'subscription' AS level, 'Tenant' AS parent_id, {SUB_ID} AS child_id, min(pos) AS pos
FROM records GROUP BY subscription_id
UNION ALL
SELECT 'resource_group', {SUB_ID}, {RG_ID}, pos FROM owners
UNION ALL
SELECT 'workspace', {RG_ID}, {WS_ID}, pos FROM records""",
    "hierarchy_edges_by_subscription": f"""WITH {RAW_SQL}
SELECT 'subscription' AS level, 'Tenant' AS parent_id, {SUB_ID} AS child_id, min(pos) AS pos
FROM records GROUP BY subscription_id
UNION ALL
SELECT 'resource_group', {SUB_ID}, {SUB_RG_ID}, min(pos)
FROM records GROUP BY subscription_id, resource_group
UNION ALL
SELECT 'workspace', {SUB_RG_ID}, {WS_ID}, pos FROM records""",
    "hierarchy_collisions": f"""WITH {RAW_SQL}, {LOOK_ALIKES_SQL},
ids AS (
  SELECT 'subscription' AS level, {SUB_ID} AS node_id, subscription_id AS key,
         'Subscription: ' || subscription_id AS label FROM alike
  UNION ALL
  SELECT 'resource_group', {RG_ID}, resource_group, 'Resource Group: ' || resource_group FROM alike
  UNION ALL
  SELECT 'workspace', {WS_ID}, workspace_name || '/' || workspace_id,
         'Workspace: ' || workspace_name || ' (' || workspace_id || ')' FROM alike)
SELECT level, node_id, count(DISTINCT key) AS n_nodes, min(label) AS first_label, max(label) AS last_label
FROM ids GROUP BY level, node_id HAVING count(DISTINCT key) > 1""",
    "hierarchy_told_apart": f"""WITH {RAW_SQL}, {LOOK_ALIKES_SQL}
SELECT 'subscription' AS level, 'Tenant' AS parent_id, {SUB_APART} AS child_id, min(pos) AS pos
FROM alike GROUP BY subscription_id
UNION ALL
SELECT 'resource_group', {SUB_APART}, {RG_APART}, min(pos)
FROM alike GROUP BY subscription_id, resource_group
UNION ALL
SELECT 'workspace', {RG_APART}, {WS_APART}, pos FROM alike""",
    "hierarchy_groups": f"""WITH {RAW_SQL}
SELECT resource_group, subscription_id, pos, workspace_count FROM owners""",
    "hierarchy_members": f"""WITH {RAW_SQL}
SELECT resource_group, pos, workspace_name AS name, workspace_id AS id FROM records""",
    "inventory_profile": f"WITH {PROFILE_SQL} SELECT * FROM profile",
    "inventory_metrics": f"WITH {PROFILE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS metric, CAST({name} AS VARCHAR) AS value FROM profile"
        for name in PROFILE_COLUMNS
    ),
    "inventory_sharing": """SELECT 'neither' AS "case", FALSE AS uses_sharing
UNION ALL SELECT 'share', count(*) > 0 FROM supplier WHERE s_acctbal < 1e9
UNION ALL SELECT 'catalog', count(*) > 0 FROM region WHERE r_regionkey = 2""",
    "inventory_schemas": """SELECT r_name AS full_name, count(s_suppkey) AS schema_count
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name""",
}
