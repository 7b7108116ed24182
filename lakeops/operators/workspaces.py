"""Normalising and searching workspace records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.functions.text import host_to_id, id_from_host
from lakeops.sources.workspaces import RECORD_FIELDS


def _records(raw: DataFrame, tenant_id: str, workspace_id, extra: list[str]) -> DataFrame:
    values = {
        "subscription_id": F.col("subscriptionId"),
        "account_id": F.lit(""),
        "workspace_name": F.col("name"),
        "workspace_id": workspace_id,
        "tenant_id": F.lit(tenant_id),
        "resource_group": F.col("resourceGroup"),
        "azure_resource_id": F.col("id"),
        "workspace_url": F.coalesce("workspaceUrl", F.lit("")),
    }
    return raw.select(*[values[name].alias(name) for name in RECORD_FIELDS], *extra)


def normalise(raw: DataFrame, tenant_id: str, keep_unmatched: bool = False) -> DataFrame:
    """Normalised records of a whole listing.

    A record without URL has an empty id. One whose URL carries no id is dropped,
    unless ``keep_unmatched`` keeps it with an empty id.
    """
    found = id_from_host(F.col("workspaceUrl"))
    kept = raw if keep_unmatched else raw.filter(F.col("workspaceUrl").isNull() | (found != ""))
    position = [name for name in ("pos",) if name in raw.columns]
    return _records(kept, tenant_id, F.coalesce(found, F.lit("")), position)


def search(raw: DataFrame, tenant_id: str, name: str, exact: str | None = None) -> DataFrame:
    """Records whose name contains ``name``, on request only the exactly named one.

    Here a URL without id stands in for the id. Several hits are returned as they
    are; ``match_count`` counts them.
    """
    hits = raw.filter(F.col("name").contains(name))
    if exact is not None:
        hits = hits.filter(F.col("name") == exact)
    position = [column for column in ("pos",) if column in raw.columns]
    return _records(hits, tenant_id, host_to_id(F.col("workspaceUrl")), position)


def match_count(raw: DataFrame, name: str) -> DataFrame:
    return raw.filter(F.col("name").contains(name)).agg(F.count("*").alias("match_count"))
