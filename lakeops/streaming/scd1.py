"""Type-1 upserts into a catalog table partitioned by a bucket of its keys.

A batch is cut to one row per key, merged with the current rows of the buckets its keys
fall in, and written to a folder of its own; then the partitions of these buckets are
pointed at the new files. Merging a batch twice gives what merging it once gives, so a
batch that failed half way is simply merged again. Readers use the catalog table as any
other; while partitions are switched they may see some buckets before and some after a
batch. One job at a time merges into a table.

The cut batch is written once, so its size is known. A small one is sent to every task
that scans current rows: rows of the touched buckets are updated where they stand and
written again without being shuffled, and only keys that the batch brings anew are dealt to
their buckets. With a large one, current rows and batch are shuffled by bucket and by a
piece of it, each task ranking a part of a bucket's keys and writing a file of its own; how
many pieces follows from the bytes of the touched buckets and of the batch.
"""

from __future__ import annotations

import math
import threading
import uuid
from collections import defaultdict
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeops.functions.tables import cluster_columns, table_properties
from lakeops.operators.upsert import (
    Keys,
    as_column,
    key_bucket,
    latest_by_key,
    precedence,
    unused_name,
)
from lakeops.session import new_work_dir
from lakeops.sources import storage
from lakeops.sources.inventory import table_location
from lakeops.streaming import flows, targets

SEED = "seed"
BATCHES_FOLDER = "_batches"
BUCKET_PROPERTY, COUNT_PROPERTY = "merge.bucketColumn", "merge.buckets"

# Bytes a bucket should hold, and those one task should merge.
BUCKET_BYTES = 4 << 30
PIECE_BYTES = 256 << 20
FEWEST_BUCKETS = 8
# Bytes on disk of a batch that is sent to every task; a larger one is shuffled.
SENT_BYTES = 16 << 20

# Names and pace of a merged table's flow.
FLOW_SUFFIX = "_apply_changes"
SILVER_TRIGGER = {"processingTime": "60 seconds"}
SILVER_COMMENT = "Clean, merged data"

_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)


# Catalyst's size of a relation about which it knows nothing.
UNKNOWN_BYTES = 1 << 60


def _estimated_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads, 0 if Catalyst cannot tell."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < UNKNOWN_BYTES else 0


def buckets_for(size: int) -> int:
    """A number of buckets for a table of about so many bytes."""
    return max(FEWEST_BUCKETS, math.ceil(size / BUCKET_BYTES))


def create_target(
    spark: SparkSession,
    target: str,
    schema: StructType,
    num_buckets: int,
    cluster_by: str | Sequence[str] | None = None,
    comment: str | None = SILVER_COMMENT,
    location: str | None = None,
) -> None:
    """Create an empty merged table unless there is one."""
    if spark.catalog.tableExists(target):
        return
    bucket = unused_name(spark.createDataFrame([], schema), "key_bucket")
    own = {BUCKET_PROPERTY: bucket, COUNT_PROPERTY: str(num_buckets)}
    clauses = [
        f"CREATE TABLE {target} ({targets.columns_ddl(schema.fields)}, `{bucket}` INT)",
        f"USING parquet PARTITIONED BY (`{bucket}`)",
    ]
    if location:
        clauses.append(f"LOCATION {targets.quoted(location)}")
    if comment:
        clauses.append(f"COMMENT {targets.quoted(comment)}")
    pairs = (table_properties("silver", cluster_by) | own).items()
    listed = ", ".join(f"{targets.quoted(k)} = {targets.quoted(v)}" for k, v in pairs)
    spark.sql("\n".join([*clauses, f"TBLPROPERTIES ({listed})"]))


def _layout(spark: SparkSession, target: str) -> tuple[str, int]:
    """The bucket column of a merged table and the number of its buckets."""
    if not spark.catalog.tableExists(target):
        raise ValueError(f"no merged table {target}")
    properties = dict(spark.sql(f"SHOW TBLPROPERTIES {target}").collect())
    if BUCKET_PROPERTY not in properties:
        raise ValueError(f"no merged table {target}: it is another table")
    return properties[BUCKET_PROPERTY], int(properties[COUNT_PROPERTY])


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """The merged rows, without the bucket."""
    bucket, _ = _layout(spark, target)
    return spark.table(target).drop(bucket)


def merge_batch(
    spark: SparkSession,
    target: str,
    batch: DataFrame,
    keys: Keys,
    sequence_by: str | Column,
    flow: str,
    batch_id: int,
    cluster_by: str | Sequence[str] | None = None,
) -> None:
    """Merge one batch; a replayed batch changes nothing."""
    with _locks[target]:
        bucket, count = _layout(spark, target)
        if bucket in {c.lower() for c in batch.columns}:
            raise ValueError(f"column name {bucket} is reserved in {target}")
        targets.add_missing_columns(spark, target, batch.schema)
        number = key_bucket(keys, count)
        names = [c for c in spark.table(target).columns if c != bucket]
        present = {c.lower() for c in batch.columns}
        # One row per key before anything is shuffled by bucket: a bucket then grows
        # with its keys, never with the versions of one hot key.
        newest = latest_by_key(
            batch, keys, sequence_by, tie_columns=[c for c in names if c.lower() in present]
        )
        staged = new_work_dir(spark, "merge-batch")
        newest.write.parquet(staged)
        newest = spark.read.schema(newest.schema).parquet(staged)
        # At most ``count`` numbers.
        touched = [row[0] for row in newest.select(number).distinct().collect()]
        if not touched:
            return
        held = spark.table(target).filter(F.col(bucket).isin(touched))
        none = spark.createDataFrame([], held.drop(bucket).schema)
        newest = none.unionByName(newest, allowMissingColumns=True)
        size = storage.folder_bytes(spark, staged)
        if size <= SENT_BYTES:
            merged = updated_rows(held, newest.withColumn(bucket, number), bucket, keys, sequence_by)
        else:
            both = held.drop(bucket).unionByName(newest).withColumn(bucket, number)
            share = (_estimated_bytes(held) + size) / len(touched)
            pieces = math.ceil(share / PIECE_BYTES) or 1
            merged = _ranked_rows(both, bucket, len(touched), pieces, keys, sequence_by)
        label = f"{quote(flow, safe='')}-{batch_id}"
        _replace(spark, target, merged, bucket, touched, label, cluster_by)
        storage.delete_folder(spark, staged)


def updated_rows(
    held: DataFrame, newest: DataFrame, bucket: str, keys: Keys, sequence_by: str | Column
) -> DataFrame:
    """Current rows and a batch small enough to be sent to every task, one row a key.

    A current row is replaced where it stands if the batch has a row of its key that comes
    before it. The batch's other keys are those that no current row has: the keys met are
    found by the same kind of join, over key columns only.
    """
    names = held.columns
    mark = "merge"
    while any(c.lower().startswith(mark) for c in names):
        mark += "_"
    own = {f"{mark}{i}": as_column(key) for i, key in enumerate(keys)}
    order = {f"{mark}order": precedence(held, keys, sequence_by, [c for c in names if c != bucket])}
    sent = F.broadcast(
        newest.withColumns(own | order).select(
            F.struct(*[F.col(f"`{c}`") for c in names]).alias(f"{mark}new"),
            *[F.col(name).alias(f"{name}_new") for name in (*own, *order)],
        )
    )
    same = [F.col(name).eqNullSafe(F.col(f"{name}_new")) for name in own]
    both = held.withColumns(own | order).join(sent, same, "left")
    wins = F.col(f"{mark}new").isNotNull() & (F.col(f"{mark}order_new") > F.col(f"{mark}order"))
    updated = both.select(
        *[F.when(wins, F.col(f"{mark}new.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) for c in names]
    )
    met = held.select(*[key.alias(name) for name, key in own.items()]).join(sent, same)
    known = met.select(*[F.col(name).alias(f"{name}_new") for name in own]).distinct()
    added = newest.withColumns(own).join(known, same, "left_anti")
    return updated.unionByName(added.select(*[F.col(f"`{c}`") for c in names]).repartition(bucket))


def _ranked_rows(
    rows: DataFrame, bucket: str, buckets: int, pieces: int, keys: Keys, sequence_by: str | Column
) -> DataFrame:
    """The latest row of each key, dealt by bucket and pieces of a bucket."""
    piece = unused_name(rows, "key_piece")
    spread = rows.withColumn(
        piece, F.pmod(F.hash(*[as_column(k) for k in keys]), F.lit(pieces))
    ).repartition(buckets * pieces, bucket, piece)
    # The keys determine bucket and piece, so rank and write need no further shuffle.
    return latest_by_key(
        spread,
        keys,
        sequence_by,
        within=[bucket, piece],
        tie_columns=[c for c in rows.columns if c != bucket],
    ).drop(piece)


def _replace(
    spark: SparkSession,
    target: str,
    merged: DataFrame,
    bucket: str,
    numbers: Sequence[int],
    label: str,
    cluster_by: str | Sequence[str] | None,
) -> None:
    """Make merged rows the content of their buckets."""
    if cluster_by:
        merged = merged.sortWithinPartitions(bucket, *cluster_columns(cluster_by))
    folder = f"{table_location(spark, target)}/{BATCHES_FOLDER}/{label}-{uuid.uuid4().hex[:8]}"
    merged.write.partitionBy(bucket).parquet(folder)
    known = {row[0] for row in spark.sql(f"SHOW PARTITIONS {target}").collect()}
    for n in sorted(numbers):
        place = targets.quoted(f"{folder}/{bucket}={n}")
        if f"{bucket}={n}" in known:
            spark.sql(f"ALTER TABLE {target} PARTITION (`{bucket}` = {n}) SET LOCATION {place}")
        else:
            spark.sql(f"ALTER TABLE {target} ADD PARTITION (`{bucket}` = {n}) LOCATION {place}")
    spark.catalog.refreshTable(target)


def rebucket(
    spark: SparkSession,
    target: str,
    keys: Keys,
    sequence_by: str | Column,
    num_buckets: int,
) -> None:
    """Deal all rows of a merged table to another number of buckets.

    Run it while nothing reads or merges: buckets are switched one after another.
    """
    with _locks[target]:
        bucket, before = _layout(spark, target)
        # The filter lets Catalyst look at the partitions and so know their size.
        current = spark.table(target).filter(F.col(bucket) >= 0).drop(bucket)
        rows = current.withColumn(bucket, key_bucket(keys, num_buckets))
        filled = [row[0] for row in rows.select(bucket).distinct().collect()]
        if filled:
            pieces = math.ceil(_estimated_bytes(rows) / len(filled) / PIECE_BYTES) or 1
            dealt = _ranked_rows(rows, bucket, len(filled), pieces, keys, sequence_by)
            _replace(spark, target, dealt, bucket, filled, f"rebucket-{num_buckets}", None)
        for n in set(range(before)) - set(filled):
            spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION (`{bucket}` = {n})")
        spark.sql(
            f"ALTER TABLE {target} SET TBLPROPERTIES ('{COUNT_PROPERTY}' = '{num_buckets}')"
        )
        spark.catalog.refreshTable(target)


def seed_target(
    spark: SparkSession,
    target: str,
    rows: DataFrame,
    keys: Keys,
    sequence_by: str | Column,
    num_buckets: int | None = None,
) -> None:
    """Create a merged table that holds rows already."""
    create_target(spark, target, rows.schema, num_buckets or buckets_for(_estimated_bytes(rows)))
    merge_batch(spark, target, rows, keys, sequence_by, SEED, 0)


def drop_stale(spark: SparkSession, target: str) -> list[str]:
    """Delete the folders of batches no bucket points at any more.

    Run it while no merge runs and no reader holds an older state.
    """
    with _locks[target]:
        root = f"{table_location(spark, target)}/{BATCHES_FOLDER}"
        used = {path.split(f"/{BATCHES_FOLDER}/", 1)[-1].split("/")[0] for path in spark.table(target).inputFiles()}
        stale = [
            name
            for name in storage.child_names(spark, root)
            if storage.as_url(spark, name) not in used and name not in used
        ]
        for name in stale:
            storage.delete_folder(spark, f"{root}/{name}")
        return stale


def bootstrap_scd1_flow(
    spark: SparkSession,
    schema_name: str,
    table_name: str,
    keys: Keys,
    sequence_by: str | Column,
    target: str,
    create_target_table: bool = False,
    cluster_by: str | Sequence[str] | None = None,
    skip_change_commits: bool = True,
    comment: str | None = SILVER_COMMENT,
    *,
    catalog: str | None = None,
    num_buckets: int | None = None,
    location: str | None = None,
    options: Mapping[str, str] | None = None,
    trigger: Mapping[str, object] | None = SILVER_TRIGGER,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Stream a catalog table into a merged table.

    Without ``create_target_table`` the target must exist and may hold rows. The number
    of buckets of a new one follows from the source's size unless given.
    """
    name = flows.qualified(schema_name, table_name, catalog)
    flow = flows.FLOW_PREFIX + table_name + FLOW_SUFFIX
    source = flows.stream_table(spark, name, skip_change_commits, options)
    if create_target_table:
        count = num_buckets or buckets_for(
            storage.folder_bytes(spark, table_location(spark, name))
        )
        create_target(spark, target, source.schema, count, cluster_by, comment, location)
    _layout(spark, target)
    state = targets.flow_state(table_location(spark, target), flow)

    def merge(batch: DataFrame, batch_id: int) -> None:
        for number, rows in source.slices(batch, batch_id, state):
            merge_batch(spark, target, rows, keys, sequence_by, flow, number, cluster_by)

    return flows.start_batches(spark, source.stream, merge, target, flow, trigger, checkpoint)
