"""Connected components of links between numbered rows, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import stored


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); a component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours
    to its smallest one, then its smaller neighbours. The links shrink to stars in
    logarithmically many rounds. A node with a third of all links is one row on the
    aggregated side of each join, and Spark splits its other side.
    """
    now = stored(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct(),
        "links",
    )
    seen = _print(now)
    while seen[0]:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            now.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(
            both.join(least, "u")
            .filter("v > u and v != m")
            .select(F.col("v").alias("high"), F.col("m").alias("low"))
            .distinct(),
            "links",
        )
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        now = stored(
            large.join(lowest, "high")
            .select(F.explode(F.array("high", "low")).alias("high"), F.col("m").alias("low"))
            .filter("high != low")
            .distinct(),
            "links",
        )
        before, seen = seen, _print(now)
        if seen == before:
            break
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
