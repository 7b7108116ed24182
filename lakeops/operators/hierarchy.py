"""Tenant, subscription, resource group and workspace as nodes and edges.

Input order decides which subscription owns a resource group, so records carry
an explicit ``pos``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.text import safe_identifier

GROUP = "resource_group"
SUBSCRIPTION = "subscription_id"

# Prefixes of node identifiers.
TENANT_ID, SUBSCRIPTION_ID, GROUP_ID, WORKSPACE_ID = "Tenant", "Sub_", "RG_", "WS_"


# Hex digits of a hash that tell apart nodes whose names look alike when made safe.
HASH_DIGITS = 16


def _node_id(prefix: str, *names: str, apart: bool = False, also: Sequence[str] = ()) -> Column:
    """An identifier made of safe characters, and ``apart`` of a hash of names and ``also``."""
    plain = F.concat(F.lit(prefix), safe_identifier(F.concat_ws("_", *names)))
    if not apart:
        return plain
    # With its length before each part, different parts never make one text.
    parts = [F.coalesce(name, F.lit("")) for name in (*names, *also)]
    whole = F.concat(*[text for part in parts for text in (F.length(part), F.lit(":"), part)])
    return F.concat(plain, F.lit("_"), F.left(F.sha2(whole, 256), F.lit(HASH_DIGITS)))


def pairs(records: DataFrame) -> DataFrame:
    """Subscription and resource group pairs with first position and record count.

    All upper levels come from these few rows, which a hash aggregate with a
    map-side part finds however many records one group has.
    """
    return records.groupBy(SUBSCRIPTION, GROUP).agg(
        F.min("pos").alias("pos"), F.count("*").alias("workspace_count")
    )


def group_owners(records: DataFrame) -> DataFrame:
    """Each resource group with the subscription it was first seen in."""
    return (
        pairs(records)
        .groupBy(GROUP)
        .agg(
            F.min_by(SUBSCRIPTION, "pos").alias(SUBSCRIPTION),
            F.min("pos").alias("pos"),
            F.sum("workspace_count").alias("workspace_count"),
        )
    )


def owned_groups(records: DataFrame, by_subscription: bool = False) -> DataFrame:
    """Resource groups under their subscription.

    By default a group is known by its name alone and belongs to the first
    subscription that shows it; ``by_subscription`` keeps equal names of different
    subscriptions apart.
    """
    return pairs(records) if by_subscription else group_owners(records)


def subscriptions(records: DataFrame) -> DataFrame:
    return pairs(records).groupBy(SUBSCRIPTION).agg(F.min("pos").alias("pos"))


def tenant(records: DataFrame) -> DataFrame:
    """The first record's tenant; no row for no records."""
    return (
        records.agg(F.min_by("tenant_id", "pos").alias("tenant_id"), F.min("pos").alias("pos"))
        .filter(F.col("pos").isNotNull())
    )


def group_workspaces(records: DataFrame) -> DataFrame:
    """``(resource_group, pos, name, id)``: the members of every group, one row each.

    A group with a third of all workspaces must not become one array, so members stay
    rows; ``pos`` gives their order within the group.
    """
    return records.select(
        GROUP, "pos", F.col("workspace_name").alias("name"), F.col("workspace_id").alias("id")
    )


def _group_key(by_subscription: bool) -> list[str]:
    return [SUBSCRIPTION, GROUP] if by_subscription else [GROUP]


def _workspace_id(apart: bool) -> Column:
    return _node_id(WORKSPACE_ID, "workspace_name", apart=apart, also=["workspace_id"])


def nodes(
    records: DataFrame, by_subscription: bool = False, told_apart: bool = False
) -> DataFrame:
    """``(level, node_id, label, pos)``: one row per tenant, subscription, group, record.

    Names that differ in unsafe characters only share an id, and so do workspaces of one
    name. With ``told_apart`` ids also carry a hash of the names, workspaces' also of their
    own id; it follows from the row alone, so ids stay the same when records are added.
    """
    group_id = _node_id(GROUP_ID, *_group_key(by_subscription), apart=told_apart)
    levels = [
        tenant(records).select(
            F.lit("tenant").alias("level"),
            F.lit(TENANT_ID).alias("node_id"),
            F.format_string("Tenant: %s", "tenant_id").alias("label"),
            "pos",
        ),
        subscriptions(records).select(
            F.lit("subscription").alias("level"),
            _node_id(SUBSCRIPTION_ID, SUBSCRIPTION, apart=told_apart).alias("node_id"),
            F.format_string("Subscription: %s", SUBSCRIPTION).alias("label"),
            "pos",
        ),
        owned_groups(records, by_subscription).select(
            F.lit("resource_group").alias("level"),
            group_id.alias("node_id"),
            F.format_string("Resource Group: %s", GROUP).alias("label"),
            "pos",
        ),
        records.select(
            F.lit("workspace").alias("level"),
            _workspace_id(told_apart).alias("node_id"),
            F.format_string("Workspace: %s (%s)", "workspace_name", "workspace_id").alias("label"),
            "pos",
        ),
    ]
    return reduce(DataFrame.unionByName, levels)


def edges(
    records: DataFrame, by_subscription: bool = False, told_apart: bool = False
) -> DataFrame:
    """``(level, parent_id, child_id, pos)`` from each node to those below it; ids as ``nodes``."""
    group_id = _node_id(GROUP_ID, *_group_key(by_subscription), apart=told_apart)
    subscription_id = _node_id(SUBSCRIPTION_ID, SUBSCRIPTION, apart=told_apart)
    levels = [
        subscriptions(records).select(
            F.lit("subscription").alias("level"),
            F.lit(TENANT_ID).alias("parent_id"),
            subscription_id.alias("child_id"),
            "pos",
        ),
        owned_groups(records, by_subscription).select(
            F.lit("resource_group").alias("level"),
            subscription_id.alias("parent_id"),
            group_id.alias("child_id"),
            "pos",
        ),
        records.select(
            F.lit("workspace").alias("level"),
            group_id.alias("parent_id"),
            _workspace_id(told_apart).alias("child_id"),
            "pos",
        ),
    ]
    return reduce(DataFrame.unionByName, levels)


def collisions(records: DataFrame, by_subscription: bool = False) -> DataFrame:
    """``(level, node_id, n_nodes, first_label, last_label)`` of ids that several nodes share.

    Every node is counted under its plain id by the id that tells it apart; distinct ids are
    found on the map side first, so an id that very many records carry is no hot group.
    """
    apart = nodes(records, by_subscription, told_apart=True).filter(F.col("level") != "tenant")
    plain = F.left("node_id", F.length("node_id") - F.lit(HASH_DIGITS + 1))
    return (
        apart.groupBy("level", plain.alias("plain_id"), "node_id")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .groupBy("level", F.col("plain_id").alias("node_id"))
        .agg(
            F.count("*").alias("n_nodes"),
            F.min("low").alias("first_label"),
            F.max("high").alias("last_label"),
        )
        .filter("n_nodes > 1")
    )
