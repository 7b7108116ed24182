"""Bronze tables: parquet tables several flows append to, one folder per batch.

Each flow writes ``ingest_flow=<flow>/ingest_batch=<id>`` and the batch becomes
visible when its partition is added to the catalog. A batch that is replayed
after a failure finds its own folder, so nothing is lost or repeated.
"""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from lakeops.operators.upsert import unused_name
from lakeops.sources import storage
from lakeops.sources.inventory import table_location

FLOW, BATCH = "ingest_flow", "ingest_batch"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"

# Folder of batches written together; its name hides it from streams over the table.
PACKS = "_packs"

#: Ranks a column has on the curve, as a power of two; rows its quantiles are taken from;
#: columns the curve follows, which is as many as one number has bits for.
CURVE_BITS, CURVE_SAMPLE, CURVE_COLUMNS = 6, 20_000, 62
CURVE_TYPES = (BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType)

# Flows of one job may find the same new column at the same time.
_altering: dict[str, threading.Lock] = defaultdict(threading.Lock)


@dataclass(frozen=True)
class Pack:
    """Batches of a flow that lie together in a folder below the table."""

    flow: str
    batches: tuple[int, ...]
    folder: str


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def columns_ddl(fields: Sequence[StructField]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def date_partition(schema: StructType, clustered: Sequence[str]) -> list[str]:
    """The clustering column, if it is one date: then it makes a good partition."""
    return [
        f.name for f in schema.fields if list(clustered) == [f.name] and f.dataType == DateType()
    ]


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    clustered: Sequence[str] = (),
    properties: Mapping[str, str] | None = None,
    comment: str | None = None,
    location: str | None = None,
) -> None:
    """Create the table unless it exists; data already at its location is found again.

    The names of the two bookkeeping columns are refused in ``schema``.
    """
    taken = {FLOW, BATCH} & {f.name.lower() for f in schema.fields}
    if taken:
        raise ValueError(f"column names {sorted(taken)} are reserved")
    if spark.catalog.tableExists(name):
        return
    dates = date_partition(schema, clustered)
    clauses = [
        f"CREATE TABLE IF NOT EXISTS {name} "
        f"({columns_ddl(schema.fields)}, {FLOW} STRING, {BATCH} BIGINT)",
        "USING parquet",
        f"PARTITIONED BY ({', '.join([FLOW, BATCH, *dates])})",
    ]
    if location:
        clauses.append(f"LOCATION {quoted(location)}")
    if comment:
        clauses.append(f"COMMENT {quoted(comment)}")
    if properties:
        pairs = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in properties.items())
        clauses.append(f"TBLPROPERTIES ({pairs})")
    spark.sql("\n".join(clauses))
    _find_finished_batches(spark, name)


def _find_finished_batches(spark: SparkSession, name: str) -> None:
    """Make the batches below a new table's location visible, but no unfinished one."""
    root = table_location(spark, name)
    packed = packed_batches(spark, root)
    for flow in [n for n in storage.child_names(spark, root) if n.startswith(f"{FLOW}=")]:
        label = unquote(flow.split("=", 1)[1])
        for batch in storage.child_names(spark, f"{root}/{flow}"):
            folder = f"{root}/{flow}/{batch}"
            if batch.startswith(f"{BATCH}=") and storage.exists(spark, f"{folder}/_SUCCESS"):
                number = int(batch.split("=", 1)[1])
                if (label, number) not in packed:
                    _show_batch(spark, name, folder, label, number)
    for pack in dict.fromkeys(packed.values()):
        show_pack(spark, name, root, pack)


def _show_batch(spark: SparkSession, name: str, folder: str, flow: str, batch_id: int) -> None:
    specs = [f"PARTITION ({spec})" for spec in _partition_specs(spark, folder, flow, batch_id)]
    if specs:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(specs)}")


def pack_manifest(root: str, number: int) -> str:
    return f"{root}/{PACKS}/manifests/{number:020d}.json"


def pack_manifests(
    spark: SparkSession, root: str, finished: bool = False
) -> dict[int, list[Pack]]:
    """Packs by number of their manifest, on request those the catalog knows too."""
    names = set(storage.child_names(spark, f"{root}/{PACKS}/manifests"))
    wanted = [n for n in sorted(names) if n.endswith(".json") and (finished or f"{n}.done" not in names)]
    texts = storage.on_each(
        lambda name: storage.read_text(spark, f"{root}/{PACKS}/manifests/{name}"), wanted
    )
    return {
        int(name.split(".")[0]): [
            Pack(p["flow"], tuple(p["batches"]), p["folder"]) for p in json.loads(text)
        ]
        for name, text in zip(wanted, texts, strict=True)
    }


def packed_batches(spark: SparkSession, root: str) -> dict[tuple[str, int], Pack]:
    """The pack of every batch that lies in one."""
    return {
        (pack.flow, batch): pack
        for packs in pack_manifests(spark, root, finished=True).values()
        for pack in packs
        for batch in pack.batches
    }


def batch_specs(spark: SparkSession, root: str, flow: str, batch_id: int) -> list[str]:
    """The partitions a batch has of its own."""
    folder = f"{root}/{FLOW}={quote(flow, safe='')}/{BATCH}={batch_id}"
    return _partition_specs(spark, folder, flow, batch_id)


def show_pack(spark: SparkSession, name: str, root: str, pack: Pack) -> None:
    """Make a pack visible, as a batch with the number of its first one."""
    folder = f"{root}/{pack.folder}"
    inner = [n for n in storage.child_names(spark, folder) if "=" in n]
    specs = _partition_specs(spark, folder, pack.flow, pack.batches[0])
    places = [f"{folder}/{n}" for n in inner] or [folder] * len(specs)
    located = [f"PARTITION ({s}) LOCATION {quoted(at)}" for s, at in zip(specs, places, strict=True)]
    if located:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(located)}")


def evolved(known: StructType, incoming: StructType) -> StructType:
    """Known columns followed by new ones; a column that changed its type is refused."""
    types = {f.name.lower(): f.dataType.simpleString() for f in known.fields}
    for f in incoming.fields:
        expected = types.get(f.name.lower(), f.dataType.simpleString())
        if f.dataType.simpleString() != expected:
            raise ValueError(f"column {f.name} is {expected}, not {f.dataType.simpleString()}")
    new = [f for f in incoming.fields if f.name.lower() not in types]
    return StructType([*known.fields, *new])


def add_missing_columns(spark: SparkSession, name: str, schema: StructType) -> None:
    """Append the columns the table lacks; rows written before read them as NULL."""
    with _altering[name]:
        known = spark.table(name).schema
        missing = evolved(known, schema).fields[len(known.fields) :]
        if missing:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns_ddl(missing)})")


def _curve(df: DataFrame, columns: Sequence[str]) -> Column:
    """A row's place on a curve that keeps neighbours in every column near each other.

    Each value is ranked among quantiles of a sample, and the bits of the ranks take
    turns. A frequent value takes as many ranks as it has rows, so that a column of few
    values steers the curve as much as one of many. NULL has the lowest rank.
    """
    bits = max(1, min(CURVE_BITS, 62 // len(columns)))
    steps = 1 << bits
    keys = df.select(*columns)
    sampled = keys.sample(min(1.0, CURVE_SAMPLE / max(1, keys.count())), seed=0)
    bounds = sampled.agg(
        *[F.sort_array(F.collect_list(name)).alias(f"c{i}") for i, name in enumerate(columns)]
    ).first()
    ranks = []
    for name, values in zip(columns, bounds):
        cuts = [values[i * len(values) // steps] for i in range(1, steps)] if values else []
        above = [(F.col(name) >= F.lit(cut)).cast("long") for cut in cuts]
        ranks.append(F.coalesce(reduce(Column.__add__, above, F.lit(0).cast("long")), F.lit(0)))
    turns = [
        F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), bit * len(columns) + i)
        for bit in range(bits)
        for i, rank in enumerate(reversed(ranks))
    ]
    return reduce(Column.__add__, turns)


def clustered_layout(
    df: DataFrame, clustered: Sequence[str], files: int | None = None
) -> DataFrame:
    """Rows arranged so that files cover narrow ranges of every clustering column.

    One date is rebalanced by value, which splits a hot date and merges small
    ones. Several plain columns are laid along a space-filling curve, whose quantiles
    come from at most some CURVE_SAMPLE rows; one column, or columns that are no plain
    values, by their order. Both are range-partitioned together with the row's position,
    so a value holding a third of the rows is spread over many partitions too.
    ``files`` sets the number of partitions, which is left to Spark without it.
    """
    columns = [name for name in clustered if name in df.columns]
    if not columns:
        return df
    if date_partition(df.schema, columns):
        return df.hint("rebalance", *columns)
    number = [files] if files else []
    position = unused_name(df, "row_position")
    placed = df.withColumn(position, F.monotonically_increasing_id())
    if len(columns) == 1 or not all(
        isinstance(df.schema[name].dataType, CURVE_TYPES) for name in columns
    ):
        return (
            placed.repartitionByRange(*number, *columns, position)
            .sortWithinPartitions(*columns)
            .drop(position)
        )
    curve = unused_name(placed, "curve")
    return (
        placed.withColumn(curve, _curve(df, columns[:CURVE_COLUMNS]))
        .repartitionByRange(*number, curve, position)
        .sortWithinPartitions(curve, *columns)
        .drop(curve, position)
    )


def flow_state(location: str, flow: str) -> str:
    """Where a flow keeps what it must remember between batches."""
    return f"{location}/_flows/{quote(flow, safe='')}"


def claim_flow(spark: SparkSession, location: str, flow: str, query_id: str) -> None:
    """Tie a flow to its checkpoint.

    Batches are numbered by the checkpoint, so a flow started over with a new one
    would take its first batches for written and lose them. That is refused.
    """
    path = flow_state(location, flow)
    if storage.publish_text(spark, path, query_id):
        return
    owner = storage.read_text(spark, path)
    if owner != query_id:
        raise ValueError(f"flow {flow} into {location} has run with another checkpoint")


def _partition_specs(spark: SparkSession, folder: str, flow: str, batch_id: int) -> list[str]:
    batch = f"{FLOW} = {quoted(flow)}, {BATCH} = {batch_id}"
    names = storage.child_names(spark, folder)
    inner = [n.split("=", 1) for n in names if "=" in n]
    if not inner:
        # Without rows a batch of a table with dates has no files either.
        return [batch] if any(n.startswith("part-") for n in names) else []
    return [
        f"{batch}, `{column}` = {'NULL' if value == NULL_PARTITION else quoted(unquote(value))}"
        for column, value in inner
    ]


def append_batch(
    spark: SparkSession,
    name: str,
    flow: str,
    batch_id: int,
    batch: DataFrame,
    clustered: Sequence[str] = (),
    one_date: bool = False,
    location: str | None = None,
) -> None:
    """Write one micro-batch of a flow and make it visible.

    With ``one_date`` the batch carries a single date, so it needs no shuffle to
    be laid out by it.
    """
    dates = date_partition(batch.schema, clustered)
    root = location or table_location(spark, name)
    folder = f"{root}/{FLOW}={quote(flow, safe='')}/{BATCH}={batch_id}"
    if not storage.exists(spark, f"{folder}/_SUCCESS"):
        arranged = batch if dates and one_date else clustered_layout(batch, clustered)
        arranged.write.mode("overwrite").partitionBy(*dates).parquet(folder)
    elif (flow, batch_id) in packed_batches(spark, root):
        return
    _show_batch(spark, name, folder, flow, batch_id)
    spark.catalog.refreshTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """The appended rows without the bookkeeping columns."""
    return spark.table(name).drop(FLOW, BATCH)
