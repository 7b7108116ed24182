"""Append flows, CSV landing, type-1 upserts and control-driven ingestion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.upsert import latest_by_key
from lakeops.plans import ingest
from lakeops.session import new_work_dir
from lakeops.sources import commit_log, storage
from lakeops.sources.control import IngestionConfig, read_name_list
from lakeops.streaming import flows, landing, packing, scd1, targets
from spark_queries import inputs

# Micro-batches a streamed source is cut into, whatever its size.
BATCHES = 4
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events")


class Workspace:
    """A database and folder of one query run."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = new_work_dir(spark, "ingest")
        self.source = "src_" + self.root.rsplit("-", 1)[1]
        self.target = "tgt_" + self.root.rsplit("-", 1)[1]
        for schema in (self.source, self.target):
            spark.sql(f"CREATE DATABASE {schema} LOCATION '{self.root}/{schema}'")

    def add_source(self, name: str, rows: DataFrame, order: Column | None = None) -> None:
        """Add rows, in several files, to a source table; create it if it is new."""
        arranged = rows.repartitionByRange(self.files, order) if order is not None else rows
        path = f"{self.root}/sources/{name}"
        arranged.write.mode("append").parquet(path)
        table = f"{self.source}.{name}"
        if not self.spark.catalog.tableExists(table):
            self.spark.catalog.createTable(table, path=path, source="parquet", schema=rows.schema)

    @property
    def files(self) -> int:
        """Files of an ordered source: one per core, at least one per batch."""
        return max(BATCHES, self.spark.sparkContext.defaultParallelism)

    def in_batches(self, batches: int = BATCHES) -> dict[str, str]:
        return {"maxFilesPerTrigger": str(-(-self.files // batches))}

    def rows(self, name: str) -> DataFrame:
        return targets.read_table(self.spark, f"{self.target}.{name}")


def bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated events copied batch by batch into a bronze table laid out by date."""
    space = Workspace(spark)
    dated = events(spark, sf_dir).withColumn("part_col", F.to_date("ts"))
    space.add_source("events", dated, F.col("ts"))
    flows.bootstrap_bronze_flow(
        spark, space.source, "events", f"{space.target}.events", options=space.in_batches()
    ).awaitTermination()
    return space.rows("events").select(*EVENT_COLUMNS, "part_col")


def bronze_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a date, clustered by user and type."""
    space = Workspace(spark)
    space.add_source("events", events(spark, sf_dir), F.col("ts"))
    flows.bootstrap_bronze_flow(
        spark,
        space.source,
        "events",
        f"{space.target}.events",
        cluster_by=["event_type", "user_id"],
        options=space.in_batches(),
    ).awaitTermination()
    return space.rows("events").select(*EVENT_COLUMNS)


def clustered_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a table laid out by two columns a predicate on either one reads.

    A file is read for a value within its bounds of the column. ``narrow`` says that a
    value is in less than half of the files on average, over all values of the column.
    """
    columns = ["l_partkey", "l_shipdate"]
    path = new_work_dir(spark, "curve")
    lines = inputs.table(spark, sf_dir, "lineitem")
    targets.clustered_layout(lines, columns, files=16).write.parquet(path)
    laid_out = spark.read.parquet(path)

    def measured(name: str) -> DataFrame:
        value = F.col(name).cast("string") if name == "l_shipdate" else F.col(name)
        rows = laid_out.select(value.alias("value"), F.col("_metadata.file_path").alias("file"))
        files = rows.groupBy("file").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        values = rows.groupBy("value").agg(F.count("*").alias("rows"))
        # At most 16 files.
        reads = values.join(F.broadcast(files), F.col("value").between(F.col("low"), F.col("high")))
        per_value = reads.groupBy("value").agg(
            F.count("*").alias("files"), F.first("rows").alias("rows")
        )
        return per_value.agg(
            F.lit(name).alias("column_name"),
            F.sum("rows").alias("rows"),
            F.count("*").alias("n_values"),
            (F.avg("files") < 8).alias("narrow"),
        )

    return measured(columns[0]).unionByName(measured(columns[1]))


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source appended to a table a bronze flow created."""
    space = Workspace(spark)
    space.add_source("even", events(spark, sf_dir).filter("event_id % 2 = 0"))
    space.add_source("odd", events(spark, sf_dir).filter("event_id % 2 = 1"))
    flows.bootstrap_bronze_flow(
        spark, space.source, "even", f"{space.target}.events"
    ).awaitTermination()
    flows.bootstrap_incremental_flow(
        spark, space.source, "odd", f"{space.target}.events", flow="odd_events"
    ).awaitTermination()
    return space.rows("events").select(*EVENT_COLUMNS)


def multi_flow_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog flow and a file flow into one table, the first run again at the end."""
    space = Workspace(spark)
    columns = ["event_id", "user_id", "event_type", "value"]
    rows = events(spark, sf_dir).select(*columns)
    space.add_source("events", rows.filter("event_id % 2 = 0"))
    rows.filter("event_id % 2 = 1").write.csv(f"{space.root}/landed", header=True)
    target = f"{space.target}.events"

    def copy() -> None:
        flows.bootstrap_bronze_flow(spark, space.source, "events", target).awaitTermination()

    copy()
    files = landing.CsvLanding(
        "event_id BIGINT, user_id BIGINT, value DOUBLE", f"{space.root}/landed"
    )
    landing.start_landing_flow(spark, target, files, None).awaitTermination()
    copy()
    return space.rows("events").select(*columns, "_rescued_data")


def passthrough_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silver copy of every table on a name list."""
    space = Workspace(spark)
    names = ["first_half", "second_half"]
    for half, name in enumerate(names):
        space.add_source(name, events(spark, sf_dir).filter(F.col("event_id") % 2 == half))
    listed = f"{space.root}/names"
    spark.createDataFrame([(n,) for n in names], "table_name STRING").write.csv(
        listed, header=True
    )
    flows.await_all(
        flows.passthrough_flows(
            spark, read_name_list(spark, listed), space.source, space.target
        )
    )
    first, second = [
        space.rows(name).select(F.lit(name).alias("table_name"), *EVENT_COLUMNS) for name in names
    ]
    return first.unionByName(second)


SEQUENCE = ("ts", "event_id")


def scd1_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(events(spark, sf_dir), ["user_id"], F.struct(*SEQUENCE))


def scd1_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence that is only the day, and missing for every thirteenth event."""
    day = F.when(F.col("event_id") % 13 != 0, F.to_date("ts"))
    return latest_by_key(events(spark, sf_dir), ["event_type", "user_id"], day)


def _merge(space: Workspace, source: str, batches: int = BATCHES, **merge: object) -> None:
    scd1.bootstrap_scd1_flow(
        space.spark,
        space.source,
        source,
        ["user_id"],
        F.struct(*SEQUENCE),
        f"{space.target}.silver",
        options=space.in_batches(batches),
        trigger=flows.AVAILABLE_NOW,
        **merge,
    ).awaitTermination()


def silver(space: Workspace) -> DataFrame:
    """The merged table as SQL sees it, without its bucket."""
    return space.spark.table(f"{space.target}.silver").drop("key_bucket")


def scd1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    space.add_source("events", events(spark, sf_dir), F.col("ts"))
    _merge(space, "events", create_target_table=True, num_buckets=8)
    return silver(space)


def scd1_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest events first, then the older ones, then all of them once more."""
    space = Workspace(spark)
    rows = events(spark, sf_dir)
    late = F.col("event_type").isin("view", "click")
    for part in (rows.filter(~late), rows.filter(late), rows):
        space.add_source("events", part, F.col("ts").desc())
        _merge(space, "events", 2, create_target_table=True, num_buckets=8)
    return silver(space)


def scd1_prefilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that held every second event before the stream of the others began."""
    space = Workspace(spark)
    rows = events(spark, sf_dir)
    sequence = F.struct(*SEQUENCE)
    scd1.seed_target(
        spark, f"{space.target}.silver", rows.filter("event_id % 2 = 0"), ["user_id"], sequence, 8
    )
    space.add_source("events", rows.filter("event_id % 2 = 1"), F.col("ts"))
    _merge(space, "events")
    return silver(space)


def scd1_small_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then a batch of a few per customer: newer rows, older ones, new keys."""
    space = Workspace(spark)
    table = f"{space.target}.silver"
    orders = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.lit(1).alias("seq"), F.col("o_orderstatus").alias("state")
    )
    scd1.seed_target(spark, table, orders, ["o_orderkey"], "seq")

    def of_customer(key: Column, seq: int, state: str) -> DataFrame:
        return orders.groupBy("o_custkey").agg(key.alias("o_orderkey")).select(
            "o_orderkey", "o_custkey", F.lit(seq).alias("seq"), F.lit(state).alias("state")
        )

    newer = of_customer(F.max("o_orderkey"), 2, "newer")
    older = of_customer(F.min("o_orderkey"), 0, "older")
    brought = of_customer(-F.min("o_orderkey"), 1, "brought")
    batch = newer.unionByName(older).unionByName(brought)
    scd1.merge_batch(spark, table, batch, ["o_orderkey"], "seq", "changes", 0)
    return scd1.read_target(spark, table)


def scd1_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small batches, then other buckets, into a table whose columns look like ours."""
    space = Workspace(spark)
    named = events(spark, sf_dir).withColumns({"key_bucket": F.lit(7), "key_rank": F.col("value")})
    space.add_source("events", named, F.col("ts"))
    _merge(space, "events", 2 * BATCHES, create_target_table=True, num_buckets=3)
    table = f"{space.target}.silver"
    scd1.rebucket(spark, table, ["user_id"], F.struct(*SEQUENCE), 8)
    scd1.drop_stale(spark, table)
    rows = scd1.read_target(spark, table)
    return rows.filter("key_bucket = 7 AND key_rank <=> value").select(*EVENT_COLUMNS)


HINTS = "c_custkey BIGINT, c_acctbal DOUBLE"


def write_landing(spark: SparkSession, sf_dir: str, folder: str, sep: str = ",") -> None:
    """Customers as CSV text: odd keys without, even keys with a segment column."""
    customers = inputs.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    balance = (
        F.when(key % 50 == 0, "notnum")
        .when(key % 17 == 0, "NULL")
        .otherwise(F.col("c_acctbal").cast("string"))
    )
    odd = F.when(key % 50 == 25, F.concat_ws(sep, key, "c_name")).otherwise(
        F.concat_ws(sep, key, "c_name", balance)
    )
    even = F.concat_ws(sep, key, "c_mktsegment", "c_name", balance)
    for line, columns, rows in (
        (odd, ["c_custkey", "c_name", "c_acctbal"], customers.filter(key % 2 == 1)),
        (even, ["c_custkey", "c_mktsegment", "c_name", "c_acctbal"], customers.filter(key % 2 == 0)),
    ):
        text = rows.select(line.alias(sep.join(columns)))
        # One column holding whole lines, written so that nothing gets quoted.
        text.write.mode("append").options(header=True, sep="\u0001", quote="").csv(folder)
    customers.select("c_name").write.mode("append").text(folder)


def _land(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    space = Workspace(spark)
    write_landing(spark, sf_dir, f"{space.root}/landed", sep)
    files = landing.CsvLanding(
        HINTS, f"{space.root}/landed", sep, sort_columns=["c_custkey", "c_name"]
    )
    landing.create_landing_table(
        spark, f"{space.target}.customer", files
    ).awaitTermination()
    return space.rows("customer").select(
        "c_custkey",
        "c_name",
        "c_acctbal",
        "c_mktsegment",
        "_rescued_data",
        F.col("sort_struct.c_custkey").alias("sort_key"),
        F.col("sort_struct.c_name").alias("sort_name"),
    )


def landing_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _land(spark, sf_dir, ",")


def landing_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _land(spark, sf_dir, "|").drop("_rescued_data", "sort_key", "sort_name")


def landing_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = _land(spark, sf_dir, ",").filter(F.col("_rescued_data").isNotNull())
    return landed.select("c_custkey", "_rescued_data")


def landing_rescued_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with balances that are no numbers and fields beyond the header."""
    space = Workspace(spark)
    key, name = F.col("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit(', \\"x\\""'))
    balance = F.when(key % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws(
        ",", key, name, balance, F.when(key % 15 == 0, F.concat(F.lit('"a,b",,'), "c_mktsegment"))
    )
    inputs.table(spark, sf_dir, "customer").select(line.alias("c_custkey,c_name,c_acctbal")).write.options(
        header=True, sep="\u0001", quote=""
    ).csv(f"{space.root}/landed")
    files = landing.CsvLanding(HINTS, f"{space.root}/landed", rescue=landing.FIELDS)
    landing.create_landing_table(spark, f"{space.target}.customer", files).awaitTermination()
    field = {
        "refused": "$.c_acctbal", "beyond": "$._c3", "blank": "$._c4", "last": "$._c5"
    }
    return space.rows("customer").select(
        "c_custkey",
        "c_name",
        "c_acctbal",
        *[F.get_json_object("_rescued_data", at).alias(column) for column, at in field.items()],
        F.get_json_object("_rescued_data", "$._file_path").eqNullSafe(F.col("file_nm")).alias("has_path"),
    )


def landing_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without header, columns by position, into a table that exists."""
    space = Workspace(spark)
    target = f"{space.target}.parts"
    columns = "p_partkey BIGINT, p_brand STRING, p_size INT"
    rows = inputs.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    files = landing.CsvLanding(columns, f"{space.root}/landed", header=False)
    rows.filter("p_partkey % 2 = 0").write.csv(f"{space.root}/landed")
    landing.create_landing_table(spark, target, files).awaitTermination()
    rows.filter("p_partkey % 2 = 1").write.mode("append").csv(f"{space.root}/landed")
    landing.start_landing_flow(spark, target, files).awaitTermination()
    return space.rows("parts").select("p_partkey", "p_brand", "p_size", "_rescued_data")


def _controlled(space: Workspace, sf_dir: str) -> tuple[IngestionConfig, list[str]]:
    """A source table and control row per event type; errors are skipped."""
    rows = events(space.spark, sf_dir)
    kinds = sorted(row[0] for row in rows.select("event_type").distinct().collect())
    for kind in kinds:
        space.add_source(kind, rows.filter(F.col("event_type") == kind))
        space.add_source(f"{kind}_inc", rows.filter(F.col("event_type") == kind))
    control = rows.select("event_type").distinct().select(
        F.col("event_type").alias("table_name"),
        F.concat("event_type", F.lit("_inc")).alias("inc_table_name"),
        F.lit("APP").alias("source_system"),
        F.when(F.col("event_type") == "error", "Y").otherwise("N").alias("skip_table"),
    )
    control.createOrReplaceTempView(f"control_{space.source}")
    config = IngestionConfig(
        space.spark, "APP", schema_name=space.source, config_table=f"control_{space.source}"
    )
    return config, [kind for kind in kinds if kind != "error"]


def _all_rows(frames: list[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def config_bronze_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per configured type a bronze copy and a silver table of each user's last event."""
    space = Workspace(spark)
    config, kinds = _controlled(space, sf_dir)
    started = ingest.run_configured_tables(
        config,
        space.target,
        silver_keys=["user_id"],
        sequence_by="event_id",
        silver_options={"create_target_table": True, "num_buckets": 4},
    )
    failures = ingest.await_flows(spark, started).filter("error IS NOT NULL")
    bronze = [space.rows(f"{kind}_inc").withColumn("layer", F.lit("bronze")) for kind in kinds]
    silver = [
        scd1.read_target(spark, f"{space.target}.{kind}").withColumn("layer", F.lit("silver"))
        for kind in kinds
    ]
    rows = _all_rows([f.select("layer", *EVENT_COLUMNS) for f in bronze + silver])
    return rows.join(failures, F.lit(True), "left_anti")


def config_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append flows of the configured types into tables that exist already."""
    space = Workspace(spark)
    config, kinds = _controlled(space, sf_dir)
    schema = events(spark, sf_dir).schema
    for kind in kinds:
        targets.create_table(spark, f"{space.target}.{kind}_inc", schema)
    ingest.await_flows(spark, ingest.run_incremental_tables(config, space.target))
    return _all_rows([space.rows(f"{kind}_inc").select(*EVENT_COLUMNS) for kind in kinds])


def config_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each flow: one table is missing, one has no name, one comes twice."""
    space = Workspace(spark)
    config, kinds = _controlled(space, sf_dir)
    faulty = spark.createDataFrame(
        [("gone", "gone_inc"), ("nameless", None), ("twice", "same"), ("twice_more", "same")],
        "table_name STRING, inc_table_name STRING",
    ).select("*", F.lit("APP").alias("source_system"), F.lit("N").alias("skip_table"))
    rows = spark.table(config.config_table).unionByName(faulty)
    rows.createOrReplaceTempView(f"faulty_{space.source}")
    config.config_table = f"faulty_{space.source}"
    flows_done = ingest.await_flows(
        spark, ingest.run_configured_tables(config, space.target, use_historic_silver=False)
    )
    counts = [
        space.rows(f"{kind}_inc").agg(F.count("*").alias("rows")).select(
            F.lit(f"{kind}_inc").alias("name"), "rows"
        )
        for kind in kinds
    ]
    reason = F.when(F.col("error").contains("no name"), "no name").when(
        F.col("error").contains("registered 2 times"), "twice"
    )
    return flows_done.join(_all_rows(counts), F.col("source") == F.col("name"), "left").select(
        "layer",
        "source",
        F.when(F.col("error").isNotNull(), F.coalesce(reason, F.lit("not found"))).alias("error"),
        "rows",
    )


def environment_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze tables of an environment's list of tables, its flows really run."""
    space = Workspace(spark)
    config, _ = _controlled(space, sf_dir)
    started = ingest.run_environment(
        spark,
        "test",
        space.target,
        {"TEST": ["view", "click"], "LIVE": ["purchase"]},
        source_name="APP",
        schema_name=space.source,
        config_table=config.config_table,
    )
    done = ingest.await_flows(spark, started).filter("error IS NULL").select("source").collect()
    return _all_rows(
        [
            space.rows(r.source).select(F.lit(r.source).alias("flow"), *EVENT_COLUMNS)
            for r in done
        ]
    )


def session_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control rows of the source that a session parameter names."""
    space = Workspace(spark)
    config, _ = _controlled(space, sf_dir)
    spark.conf.set("source_name", "APP")
    try:
        named = IngestionConfig(spark, schema_name=space.source, config_table=config.config_table)
        spark.conf.set("source_name", "NONE")
        other = IngestionConfig(spark, schema_name=space.source, config_table=config.config_table)
    finally:
        spark.conf.unset("source_name")
    return named.rows().select("table_name", "source_system").unionByName(
        other.rows().select("table_name", "source_system")
    )


def table_properties_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties a bronze flow gives its table, beside the rows it copied."""
    space = Workspace(spark)
    dated = events(spark, sf_dir).withColumn("part_col", F.to_date("ts"))
    space.add_source("events", dated)
    table = f"{space.target}.events"
    flows.bootstrap_bronze_flow(
        spark, space.source, "events", table, properties={"steward": "nobody"}
    ).awaitTermination()
    wanted = ["quality", "steward", "delta.enableDeletionVectors", "delta.dataSkippingStatsColumns"]
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key").isin(wanted))
    return found.crossJoin(F.broadcast(space.rows("events").agg(F.count("*").alias("rows"))))


def landing_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many landed rows carry the name of a file that exists, by file type."""
    space = Workspace(spark)
    write_landing(spark, sf_dir, f"{space.root}/landed")
    files = landing.CsvLanding(HINTS, f"{space.root}/landed")
    landing.create_landing_table(spark, f"{space.target}.customer", files).awaitTermination()
    listed = spark.read.format("binaryFile").load(f"{space.root}/landed").select(
        F.element_at(F.split("path", "/"), -1).alias("name")
    )
    own = F.element_at(F.split("file_nm", "/"), -1)
    return (
        space.rows("customer")
        .select("c_custkey", own.alias("name"))
        .join(listed, "name")
        .groupBy(F.element_at(F.split("name", r"\."), -1).alias("file_type"))
        .agg(F.count("*").alias("rows"))
    )


def logged_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logged table with an update, appends, a compaction, strays and removed files.

    Customers by parts of ten: part 0 was written by commit 0 and rewritten by commit 1,
    whose old files are gone; 1, 2, 3 and 8 were appended before the flow began, 4, 5, 7
    and 9 after. Only part 6 never arrives: it comes with a commit that removes part 7.
    """
    space = Workspace(spark)
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    part = F.col("c_custkey") % 10
    root = f"{space.root}/logged"
    known: set[str] = set()

    def write(rows: DataFrame) -> list[str]:
        rows.repartition(2).write.mode("append").parquet(root)
        names = {n for n in storage.child_names(spark, root) if n.endswith(".parquet")}
        new = sorted(names - known)
        known.update(new)
        return new

    def commit(version: int, adds: list[str], removes: list[str] = (), change: bool = True) -> None:
        lines = [{"add": {"path": p, "size": 1, "dataChange": change}} for p in adds]
        lines += [{"remove": {"path": p, "dataChange": change}} for p in removes]
        text = "\n".join(map(json.dumps, lines))
        storage.publish_text(spark, f"{commit_log.log_folder(root)}/{version:020d}.json", text)

    def run() -> None:
        flows.bootstrap_bronze_flow(
            spark, space.source, "logged", f"{space.target}.logged"
        ).awaitTermination()

    old = write(customers.filter(part == 0))
    commit(0, old)
    spark.catalog.createTable(
        f"{space.source}.logged", path=root, source="parquet", schema=customers.schema
    )
    commit(1, write(customers.filter(part == 0).withColumn("c_name", F.upper("c_name"))), old)
    for name in old:
        storage.delete_folder(spark, f"{root}/{name}")
    appended = [write(customers.filter(part.isin(*parts))) for parts in ((1, 2), (3, 8))]
    for n, files in enumerate(appended):
        commit(2 + n, files)
    run()
    commit(4, write(customers.filter(part.isin(4, 9))))
    commit(5, write(customers.filter(part.isin(1, 2, 3, 8))), appended[0] + appended[1], change=False)
    storage.publish_text(
        spark, f"{commit_log.log_folder(root)}/{0:020d}.{5:020d}.compacted.json", '{"add":{"path":"x"}}'
    )
    run()
    replaced = write(customers.filter(part == 7))
    commit(6, write(customers.filter(part == 5)) + replaced)
    commit(7, write(customers.filter(part == 6)), replaced)
    run()
    run()
    return space.rows("logged").select("c_custkey", "c_name")


# Batches the packed table gets from its first flow.
SMALL_BATCHES = 50


def packed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of many small batches, packed between two runs of a stream that copies it."""
    space = Workspace(spark)
    rows = events(spark, sf_dir).select(*EVENT_COLUMNS)
    for name, share in (("early", F.col("event_id") % 2 == 0), ("late", F.col("event_id") % 2 == 1)):
        space.add_source(name, rows.filter(share).repartition(SMALL_BATCHES if name == "early" else 2))
    table, copied = f"{space.target}.small", f"{space.target}.copied"
    flows.bootstrap_bronze_flow(
        spark, space.source, "early", table, options={"maxFilesPerTrigger": "1"}
    ).awaitTermination()

    def copy() -> None:
        flows.bootstrap_bronze_flow(spark, space.target, "small", copied).awaitTermination()

    copy()
    packing.pack_batches(spark, table, ["event_type"], partly=True)
    flows.bootstrap_incremental_flow(
        spark, space.source, "late", table, flow="late"
    ).awaitTermination()
    copy()
    return space.rows("small").withColumn("held_by", F.lit("small")).unionByName(
        space.rows("copied").withColumn("held_by", F.lit("copied"))
    )


QUERIES = {
    "bronze_append": bronze_append,
    "bronze_clustered": bronze_clustered,
    "clustered_skipping": clustered_skipping,
    "incremental_append": incremental_append,
    "multi_flow_append": multi_flow_append,
    "passthrough_flows": passthrough_flows,
    "scd1_batch": scd1_batch,
    "scd1_ties": scd1_ties,
    "scd1_stream": scd1_stream,
    "scd1_out_of_order": scd1_out_of_order,
    "scd1_prefilled": scd1_prefilled,
    "scd1_gathered": scd1_gathered,
    "scd1_small_batch": scd1_small_batch,
    "landing_csv": landing_csv,
    "landing_evolved": landing_evolved,
    "landing_rescued": landing_rescued,
    "landing_rescued_fields": landing_rescued_fields,
    "landing_append": landing_append,
    "config_bronze_silver": config_bronze_silver,
    "config_incremental": config_incremental,
    "config_with_failures": config_with_failures,
    "environment_pipeline": environment_pipeline,
    "session_source": session_source,
    "table_properties": table_properties_query,
    "landing_lineage": landing_lineage,
    "logged_append": logged_append,
    "packed_batches": packed_batches,
}

COLUMNS_SQL = ", ".join(EVENT_COLUMNS)
ALL_EVENTS = f"SELECT {COLUMNS_SQL} FROM events"
LATEST = f"""{ALL_EVENTS}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1"""
LANDED_SQL = """
customers AS (
  SELECT c_custkey, c_name,
         CASE WHEN c_custkey % 50 NOT IN (0, 25) AND c_custkey % 17 <> 0 THEN c_acctbal END
           AS c_acctbal,
         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment,
         CASE WHEN c_custkey % 50 = 25 THEN c_custkey || ',' || c_name
              WHEN c_custkey % 50 = 0
              THEN c_custkey || ',' || c_mktsegment || ',' || c_name || ',notnum' END
           AS _rescued_data
  FROM customer)
"""

ORACLES = {
    "bronze_append": f"SELECT {COLUMNS_SQL}, CAST(ts AS DATE) AS part_col FROM events",
    "bronze_clustered": ALL_EVENTS,
    "clustered_skipping": " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, count(*) AS "rows",
  count(DISTINCT {name}) AS n_values, TRUE AS narrow FROM lineitem"""
        for name in ("l_partkey", "l_shipdate")
    ),
    "incremental_append": ALL_EVENTS,
    "multi_flow_append": """SELECT event_id, user_id, event_type, value,
  CAST(NULL AS VARCHAR) AS _rescued_data FROM events""",
    "packed_batches": f"""SELECT {COLUMNS_SQL}, held_by
FROM events, (VALUES ('small'), ('copied')) AS t(held_by)""",
    "passthrough_flows": f"""SELECT
  CASE WHEN event_id % 2 = 0 THEN 'first_half' ELSE 'second_half' END AS table_name, {COLUMNS_SQL}
FROM events""",
    "scd1_batch": LATEST,
    "scd1_ties": f"""{ALL_EVENTS} QUALIFY row_number() OVER (PARTITION BY event_type, user_id
  ORDER BY CASE WHEN event_id % 13 <> 0 THEN CAST(ts AS DATE) END DESC NULLS LAST,
           event_id DESC) = 1""",
    "scd1_stream": LATEST,
    "scd1_out_of_order": LATEST,
    "scd1_prefilled": LATEST,
    "scd1_gathered": LATEST,
    "scd1_small_batch": """WITH changes AS (
  SELECT max(o_orderkey) AS o_orderkey, o_custkey, 2 AS seq, 'newer' AS state FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT min(o_orderkey), o_custkey, 0, 'older' FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT -min(o_orderkey), o_custkey, 1, 'brought' FROM orders GROUP BY o_custkey)
SELECT * FROM (
  SELECT o_orderkey, o_custkey, 1 AS seq, o_orderstatus AS state FROM orders UNION ALL FROM changes)
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1""",
    "landing_csv": f"""WITH {LANDED_SQL}
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customers""",
    "landing_evolved": f"""WITH {LANDED_SQL}
SELECT c_custkey, c_name, c_acctbal, c_mktsegment, _rescued_data,
       c_custkey AS sort_key, c_name AS sort_name FROM customers""",
    "landing_rescued": f"""WITH {LANDED_SQL}
SELECT c_custkey, _rescued_data FROM customers WHERE _rescued_data IS NOT NULL""",
    "landing_rescued_fields": """SELECT c_custkey, c_name || ', "x"' AS c_name,
  CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 10 = 0 THEN 'n/a' END AS refused,
  CASE WHEN c_custkey % 15 = 0 THEN 'a,b' END AS beyond, CAST(NULL AS VARCHAR) AS blank,
  CASE WHEN c_custkey % 15 = 0 THEN c_mktsegment END AS last,
  c_custkey % 10 = 0 OR c_custkey % 15 = 0 AS has_path FROM customer""",
    "landing_append": """SELECT p_partkey, p_brand, p_size, CAST(NULL AS VARCHAR) AS _rescued_data
FROM part""",
    "config_bronze_silver": f"""SELECT 'bronze' AS layer, {COLUMNS_SQL} FROM events
WHERE event_type <> 'error'
UNION ALL
SELECT 'silver', {COLUMNS_SQL} FROM events WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1""",
    "config_incremental": f"{ALL_EVENTS} WHERE event_type <> 'error'",
    "config_with_failures": """SELECT 'bronze' AS layer, event_type || '_inc' AS source,
  CAST(NULL AS VARCHAR) AS error, count(*) AS "rows"
FROM events WHERE event_type <> 'error' GROUP BY event_type
UNION ALL SELECT * FROM (VALUES ('bronze', 'gone_inc', 'not found', NULL),
  ('bronze', NULL, 'no name', NULL), ('bronze', 'same', 'twice', NULL),
  ('bronze', 'same', 'twice', NULL))""",
    "environment_pipeline": f"""SELECT event_type || '_inc' AS flow, {COLUMNS_SQL}
FROM events WHERE event_type IN ('view', 'click')""",
    "session_source": """SELECT DISTINCT event_type AS table_name, 'APP' AS source_system
FROM events WHERE event_type <> 'error'""",
    "table_properties": """SELECT key, value, "rows" FROM (VALUES ('quality', 'bronze'),
  ('steward', 'nobody'), ('delta.enableDeletionVectors', 'true'),
  ('delta.dataSkippingStatsColumns', 'part_col')) AS p(key, value),
  (SELECT count(*) AS "rows" FROM events)""",
    "landing_lineage": "SELECT 'csv' AS file_type, count(*) AS \"rows\" FROM customer",
    "logged_append": """SELECT c_custkey,
  CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS c_name
FROM customer WHERE c_custkey % 10 <> 6""",
}
