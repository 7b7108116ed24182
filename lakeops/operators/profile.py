"""One-row profile of a workspace from exported inventory tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import host_prefix, or_label

# Catalogs that are not a user's, the mark of a sharing catalog,
# and the group whose members administer the workspace.
SYSTEM_CATALOGS = ["__databricks_internal", "system"]
SHARING_KIND = "CATALOG_DELTASHARING"
ADMIN_GROUP = "admins"


@dataclass
class Inventory:
    """Exported listings of one workspace."""

    catalogs: DataFrame
    schemas: DataFrame
    users: DataFrame
    groups: DataFrame
    service_principals: DataFrame
    warehouses: DataFrame
    shares: DataFrame
    experiments: DataFrame


def user_catalogs(catalogs: DataFrame) -> DataFrame:
    """Catalogs with a name that is not a system one."""
    name = F.col("full_name")
    return catalogs.filter(name.isNotNull() & ~name.isin(SYSTEM_CATALOGS))


def schema_counts(catalogs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Schemas per user catalog, 0 for a catalog without any."""
    per_catalog = schemas.groupBy("catalog_name").agg(F.count("*").alias("schema_count"))
    return (
        user_catalogs(catalogs)
        .join(per_catalog, F.col("full_name") == F.col("catalog_name"), "left")
        .select("full_name", F.coalesce("schema_count", F.lit(0)).alias("schema_count"))
    )


def any_of(condition: Column) -> Column:
    """Whether the condition holds for some row; false for no rows."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def is_member(groups: DataFrame, user: str | None, group: str = ADMIN_GROUP) -> DataFrame:
    """Whether a group of that name lists the user among its members."""
    listed = (F.col("display_name") == group) & F.array_contains("members", F.lit(user or ""))
    return groups.agg(any_of(listed & F.lit(bool(user))).alias("is_member"))


def _some(rows: DataFrame) -> Column:
    return rows.agg(F.count("*") > 0).scalar()


def _count(rows: DataFrame) -> Column:
    return rows.agg(F.count("*")).scalar()


def profile(
    spark: SparkSession,
    inventory: Inventory,
    user: str | None = None,
    account_id: str | None = None,
    workspace_id: str | None = None,
    workspace_name: str | None = None,
    host: str | None = None,
    admin_group: str = ADMIN_GROUP,
) -> DataFrame:
    """Counts, usage flags and labels in one row; each count is a scalar subquery."""
    catalogs, host_column = inventory.catalogs, F.lit(host).cast("string")
    serverless = any_of(F.col("enable_serverless_compute"))
    sharing = any_of(F.col("securable_kind").contains(SHARING_KIND))
    counted = schema_counts(catalogs, inventory.schemas)
    columns = {
        "is_admin": is_member(inventory.groups, user, admin_group).scalar(),
        "account_id": or_label(F.lit(account_id or None).cast("string")),
        "workspace_id": or_label(F.lit(workspace_id).cast("string")),
        "workspace_url": or_label(host_column),
        "workspace_name": or_label(F.lit(workspace_name).cast("string")),
        "platform": or_label(host_prefix(host_column), "Unknown"),
        "uses_serverless": inventory.warehouses.agg(serverless).scalar(),
        "uses_catalogs": _some(catalogs),
        "uses_sharing": _some(inventory.shares) | catalogs.agg(sharing).scalar(),
        "uses_experiments": _some(inventory.experiments),
        "schema_count": F.coalesce(counted.agg(F.sum("schema_count")).scalar(), F.lit(0)),
        "catalog_count": _count(catalogs),
        "user_count": _count(inventory.users),
        "group_count": _count(inventory.groups),
        "service_principal_count": _count(inventory.service_principals),
    }
    return spark.range(1).select(*[value.alias(name) for name, value in columns.items()])


def metrics(profile_row: DataFrame) -> DataFrame:
    """The profile in long form ``(metric, value)``, values as text."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(name).cast("string").alias("value"))
            for name in profile_row.columns
        ]
    )
    return profile_row.select(F.inline(pairs))
