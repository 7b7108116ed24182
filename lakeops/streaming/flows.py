"""Append flows from catalog tables into bronze tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeops.functions.tables import DEFAULT_CLUSTER_COLUMNS, cluster_columns, table_properties
from lakeops.functions.text import decode_path, is_absolute, join_path
from lakeops.session import new_work_dir
from lakeops.sources import commit_log, storage
from lakeops.sources.inventory import table_location
from lakeops.streaming import targets

AVAILABLE_NOW = {"availableNow": True}

# Fixed value: prefix of flows that copy a catalog table.
FLOW_PREFIX = "hive_metastore_"

# Commits one micro-batch of a logged table takes in.
COMMITS_PER_BATCH = 100

# Bytes of new files one micro-batch of a plain table takes in.
BYTES_PER_BATCH = str(64 << 30)

# Data files of a logged table that are read at once.
FILES_PER_SLICE = 10_000

# Batches of a logged table are cut into slices, whose numbers follow one another
# and come after those of the rows that were there when the flow began.
SLICES = 1 << 20
BEFORE_ALL = -(1 << 60)


@dataclass
class FlowSource:
    """A stream to trigger on, and how one of its batches turns into rows.

    ``slices`` takes a batch, its number and a folder that keeps the flow's state, and
    gives numbered frames, in rising order and the same when a batch is replayed.
    """

    stream: DataFrame
    slices: Callable[[DataFrame, int, str], Iterator[tuple[int, DataFrame]]]
    schema: StructType


def qualified(schema_name: str, table_name: str, catalog: str | None = None) -> str:
    return ".".join(part for part in (catalog, schema_name, table_name) if part)


def stream_table(
    spark: SparkSession,
    name: str,
    skip_change_commits: bool = False,
    options: Mapping[str, str] | None = None,
) -> FlowSource:
    """Stream a catalog table.

    A plain file table only ever gains files, so there is nothing to skip. A
    table with a commit log begins with the files live at that moment and goes on
    commit by commit: commits that remove data are skipped or, without
    ``skip_change_commits``, refused.
    """
    location = table_location(spark, name)
    if commit_log.has_log(spark, location):
        return _stream_commits(spark, name, location, skip_change_commits, options or {})
    given = dict(options or {})
    bound = {} if any("PerTrigger" in key for key in given) else {"maxBytesPerTrigger": BYTES_PER_BATCH}
    stream = spark.readStream.options(**bound, **given).table(name)
    stream = stream.drop(targets.FLOW, targets.BATCH)
    return FlowSource(stream, lambda batch, number, _: iter([(number, batch)]), stream.schema)


def _stream_commits(
    spark: SparkSession,
    name: str,
    location: str,
    skip_change_commits: bool,
    options: Mapping[str, str],
) -> FlowSource:
    stream = (
        spark.readStream.schema(commit_log.LINES_SCHEMA)
        .options(
            **{"maxFilesPerTrigger": str(COMMITS_PER_BATCH), **commit_log.COMMIT_FILES, **options}
        )
        .json(storage.as_literal_path(commit_log.log_folder(location)))
        .select(
            F.lit(name).alias("table_name"),
            commit_log.commit_version(F.col("_metadata.file_name")).alias("version"),
            "add",
            "remove",
            commit_log.FAULT,
        )
    )
    schema = spark.table(name).schema

    def read(adds: DataFrame, first: int) -> Iterator[tuple[int, DataFrame]]:
        """Rows of the files in ``adds``, some files at a time."""
        path = decode_path(F.col("path"))
        whole = F.when(is_absolute(path), path).otherwise(join_path(F.lit(location), path))
        files = adds.select(whole.alias("path"))
        slices = -(-files.count() // FILES_PER_SLICE)
        if slices > 1:
            folder = new_work_dir(spark, "slices")
            number = F.pmod(F.xxhash64("path"), F.lit(slices)).alias("slice")
            files.select("path", number).write.partitionBy("slice").parquet(folder)
            files = spark.read.parquet(folder)
        for i in range(slices):
            part = files.filter(F.col("slice") == i) if slices > 1 else files
            # About FILES_PER_SLICE names; the rows stay in Spark.
            paths = [storage.as_literal_path(row[0]) for row in part.select("path").collect()]
            if paths:
                reader = spark.read.schema(schema).option("basePath", location)
                yield first + i, reader.parquet(*paths)

    def slices(actions: DataFrame, batch_id: int, state: str) -> Iterator[tuple[int, DataFrame]]:
        start = _start_version(spark, location, state)
        if batch_id == 0:
            snapshot = commit_log.find_snapshot(spark, location, start)
            known = commit_log.read_live_actions(spark, {name: location}, {name: snapshot})
            yield from read(
                commit_log.live_files(known).select(F.col("relative_path").alias("path")),
                BEFORE_ALL,
            )
        new = actions.filter(F.col("version") > start)
        seen = new.agg(
            F.max(F.col("remove.dataChange")).alias("removes"),
            F.min(F.when(F.col(commit_log.FAULT).isNotNull(), F.col("version"))).alias("broken"),
        ).first()
        if seen["broken"] is not None:
            raise ValueError(f"commit {seen['broken']} of {name} has a malformed line")
        if not skip_change_commits and seen["removes"]:
            raise ValueError(f"a commit of {name} removes data; set skip_change_commits")
        adds = commit_log.append_only_actions(new).filter(
            ~F.col("add.dataChange").eqNullSafe(False)
        )
        yield from read(adds.select("add.path"), batch_id * SLICES)

    return FlowSource(stream, slices, schema)


def _start_version(spark: SparkSession, location: str, state: str) -> int:
    """The version whose live files a flow began with; kept from its first batch on."""
    path = f"{state}.start"
    if not storage.exists(spark, path):
        storage.publish_text(spark, path, str(commit_log.find_snapshot(spark, location).version))
    return int(storage.read_text(spark, path))


def start_flow(
    spark: SparkSession,
    source: FlowSource,
    target: str,
    flow: str,
    clustered: Sequence[str] = (),
    trigger: Mapping[str, object] | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Append a source to an existing table under a flow name of its own."""

    location = table_location(spark, target)

    def append(batch: DataFrame, batch_id: int) -> None:
        targets.claim_flow(spark, location, flow, query_id(batch))
        for number, rows in source.slices(batch, batch_id, targets.flow_state(location, flow)):
            targets.add_missing_columns(spark, target, rows.schema)
            targets.append_batch(spark, target, flow, number, rows, clustered, location=location)

    return start_batches(spark, source.stream, append, target, flow, trigger, checkpoint)


def query_id(batch: DataFrame) -> str:
    """Identity of the checkpoint a micro-batch belongs to."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def start_batches(
    spark: SparkSession,
    stream: DataFrame,
    apply: Callable[[DataFrame, int], None],
    target: str,
    flow: str,
    trigger: Mapping[str, object] | None,
    checkpoint: str | None,
) -> StreamingQuery:
    """Run ``apply`` on every micro-batch, progress kept beside the target by default."""
    folder = checkpoint or f"{table_location(spark, target)}/_checkpoints/{flow}"
    writer = stream.writeStream.queryName(f"{target}:{flow}").foreachBatch(apply)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", folder).start()


def bootstrap_bronze_flow(
    spark: SparkSession,
    schema_name: str,
    table_name: str,
    target_table: str | None = None,
    cluster_by: str | Sequence[str] | None = None,
    skip_change_commits: bool = True,
    properties: Mapping[str, str] | None = None,
    *,
    catalog: str | None = None,
    quality: str = "bronze",
    location: str | None = None,
    options: Mapping[str, str] | None = None,
    trigger: Mapping[str, object] | None = AVAILABLE_NOW,
) -> StreamingQuery:
    """Create a bronze table and start the flow that fills it from a catalog table."""
    name, target = qualified(schema_name, table_name, catalog), target_table or table_name
    clustered = cluster_columns(cluster_by, DEFAULT_CLUSTER_COLUMNS)
    source = stream_table(spark, name, skip_change_commits, options)
    targets.create_table(
        spark,
        target,
        source.schema,
        clustered,
        table_properties(quality, clustered, properties),
        location=location,
    )
    return start_flow(spark, source, target, FLOW_PREFIX + target, clustered, trigger)


def bootstrap_incremental_flow(
    spark: SparkSession,
    schema_name: str,
    table_name: str,
    target_table: str | None = None,
    skip_change_commits: bool = False,
    *,
    catalog: str | None = None,
    flow: str | None = None,
    options: Mapping[str, str] | None = None,
    trigger: Mapping[str, object] | None = AVAILABLE_NOW,
) -> StreamingQuery:
    """Start a flow from a catalog table into a table that exists already."""
    name, target = qualified(schema_name, table_name, catalog), target_table or table_name
    source = stream_table(spark, name, skip_change_commits, options)
    return start_flow(
        spark, source, target, flow or FLOW_PREFIX + target, trigger=trigger
    )


def passthrough_flows(
    spark: SparkSession,
    names: DataFrame,
    schema_name: str,
    target_schema: str,
    trigger: Mapping[str, object] | None = AVAILABLE_NOW,
    location_root: str | None = None,
) -> list[StreamingQuery]:
    """One silver copy per listed table; the list itself is the fan-out."""
    return [
        bootstrap_bronze_flow(
            spark,
            schema_name,
            name,
            target_table=qualified(target_schema, name),
            quality="silver",
            location=f"{location_root}/{name}" if location_root else None,
            trigger=trigger,
        )
        for name in distinct_names(row[0] for row in names.select("table_name").collect())
    ]


def distinct_names(names: Iterable[str]) -> list[str]:
    """The names, refusing one that comes twice: flow names must be unique."""
    listed = list(names)
    repeated = sorted(name for name, times in Counter(listed).items() if times > 1)
    if repeated:
        raise ValueError(f"flows registered twice: {', '.join(repeated)}")
    return listed


def await_all(queries: Iterable[StreamingQuery]) -> None:
    """Wait for every query, then raise the first failure, if any, with all named."""
    failed = []
    for query in queries:
        try:
            query.awaitTermination()
        except StreamingQueryException as error:
            failed.append((query.name, error))
    if failed:
        raise RuntimeError(f"failed: {', '.join(str(n) for n, _ in failed)}") from failed[0][1]
