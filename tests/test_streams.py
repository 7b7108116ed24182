"""Append flows, streamed upserts and commit-log streams."""

import uuid

import pyspark.sql.functions as F
import pytest
from pyspark.errors import StreamingQueryException

from lakeops.streaming import flows, scd1, targets
from tests.test_diagnostics import add, remove, write_log


@pytest.fixture
def space(spark, work):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{work}/{name}'")
    return name


def make_source(spark, work, space, name, df):
    path = f"{work}/{name}"
    df.write.mode("append").parquet(path)
    if not spark.catalog.tableExists(f"{space}.{name}"):
        spark.catalog.createTable(f"{space}.{name}", path=path, source="parquet", schema=df.schema)


def ids(df):
    return sorted(row[0] for row in df.select("id").collect())


def test_bronze_is_partitioned_by_its_date_and_keeps_properties(spark, work, space):
    dated = spark.range(50).withColumn(
        "part_col", F.expr("if(id = 7, NULL, date'2024-01-01' + int(id % 3))")
    )
    make_source(spark, work, space, "src", dated)
    query = flows.bootstrap_bronze_flow(
        spark, space, "src", f"{space}.tgt", properties={"team": "me"}
    )
    query.awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(50))
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {space}.tgt").collect()}
    assert properties["quality"] == "bronze" and properties["team"] == "me"
    assert properties["delta.dataSkippingStatsColumns"] == "part_col"
    one_day = spark.table(f"{space}.tgt").filter("part_col = date'2024-01-02'")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_col" in plan
    assert one_day.count() == 16
    assert spark.table(f"{space}.tgt").filter("part_col IS NULL").count() == 1


def test_restart_from_checkpoint_repeats_nothing(spark, work, space):
    make_source(spark, work, space, "src", spark.range(10))
    for extra in (None, spark.range(10, 20)):
        if extra is not None:
            make_source(spark, work, space, "src", extra)
        flows.bootstrap_bronze_flow(spark, space, "src", f"{space}.tgt").awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(20))


def test_replayed_batch_is_written_once(spark, work, space):
    schema = spark.range(1).schema
    targets.create_table(spark, f"{space}.tgt", schema)
    for _ in range(2):
        targets.append_batch(spark, f"{space}.tgt", "f/1", 0, spark.range(5))
    targets.append_batch(spark, f"{space}.tgt", "f/1", 1, spark.range(5, 8))
    targets.append_batch(spark, f"{space}.tgt", "g", 0, spark.range(8, 10))
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(10))


def test_dropped_table_finds_its_data_again(spark, work, space):
    schema = spark.range(1).schema
    for _ in range(2):
        targets.create_table(spark, f"{space}.tgt", schema, location=f"{work}/kept")
        if not targets.read_table(spark, f"{space}.tgt").count():
            targets.append_batch(spark, f"{space}.tgt", "f", 0, spark.range(5))
        assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(5))
        spark.sql(f"DROP TABLE {space}.tgt")


def test_flow_with_a_new_checkpoint_is_refused(spark, work, space):
    make_source(spark, work, space, "src", spark.range(5))
    targets.create_table(spark, f"{space}.tgt", spark.range(1).schema)
    source = flows.stream_table(spark, f"{space}.src")
    for n in (1, 2):
        query = flows.start_flow(
            spark, source, f"{space}.tgt", "f", (), flows.AVAILABLE_NOW, f"{work}/cp{n}"
        )
        if n == 1:
            query.awaitTermination()
            continue
        with pytest.raises(StreamingQueryException, match="another checkpoint"):
            query.awaitTermination()


def test_hot_cluster_value_is_spread_over_tasks(spark):
    rows = spark.range(40000).withColumn("k", F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid_out = targets.clustered_layout(rows, ["k"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in laid_out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40000 and max(sizes) < 40000 / 3
    assert laid_out.columns == ["id", "k", "p"]


def test_several_columns_are_laid_along_a_curve(spark):
    kinds = F.element_at(F.array(*[F.lit(k) for k in "aaabcd"]), (F.hash("id") % 3 + 3).cast("int"))
    rows = spark.range(40000).select(
        "id", kinds.alias("kind"), F.when(F.col("id") % 7 > 0, F.xxhash64("id")).alias("number")
    )
    laid_out = targets.clustered_layout(rows, ["kind", "number"], files=16)
    assert laid_out.columns == rows.columns and laid_out.exceptAll(rows).isEmpty()
    parts = laid_out.withColumn("p", F.spark_partition_id()).groupBy("p")
    found = parts.agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"))
    spread = [((r.high or 0) - (r.low or 0)) / 2**64 for r in found.collect()]
    assert len(spread) == 16 and sum(spread) / 16 < 0.5
    assert max(r.n for r in found.collect()) < 40000 / 8
    # Empty tables, constant and missing values, and columns without a plain order.
    assert targets.clustered_layout(rows.limit(0), ["kind", "number"]).count() == 0
    flat = rows.select(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))
    assert targets.clustered_layout(flat, ["a", "b"], files=4).count() == 40000
    nested = rows.select(F.struct("id").alias("a"), "kind")
    assert targets.clustered_layout(nested, ["a", "kind"]).count() == 40000


def test_new_source_columns_reach_the_target(spark, work, space):
    make_source(spark, work, space, "a", spark.range(3))
    make_source(spark, work, space, "b", spark.range(3, 5).withColumn("note", F.lit("n")))
    flows.bootstrap_bronze_flow(spark, space, "a", f"{space}.tgt").awaitTermination()
    flows.bootstrap_incremental_flow(
        spark, space, "b", f"{space}.tgt", flow="second"
    ).awaitTermination()
    rows = {r.id: r.note for r in targets.read_table(spark, f"{space}.tgt").collect()}
    assert rows == {0: None, 1: None, 2: None, 3: "n", 4: "n"}


def test_column_of_another_type_is_refused(spark, work, space):
    make_source(spark, work, space, "a", spark.range(3))
    make_source(spark, work, space, "b", spark.range(3).selectExpr("CAST(id AS STRING) AS id"))
    flows.bootstrap_bronze_flow(spark, space, "a", f"{space}.tgt").awaitTermination()
    query = flows.bootstrap_incremental_flow(spark, space, "b", f"{space}.tgt", flow="second")
    with pytest.raises(StreamingQueryException, match="column id is bigint, not string"):
        query.awaitTermination()
    scd1.create_target(spark, f"{space}.silver", spark.range(1).schema, 2)
    with pytest.raises(ValueError, match="column id is bigint"):
        text = spark.table(f"{space}.b")
        scd1.merge_batch(spark, f"{space}.silver", text, ["id"], "id", "f", 0)


def test_dates_are_rebalanced_and_constants_not_shuffled(spark):
    dated = spark.range(10).withColumn("part_col", F.current_date())
    plan = targets.clustered_layout(dated, ["part_col"])._jdf.queryExecution().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    assert "Exchange" not in targets.clustered_layout(dated, [])._jdf.queryExecution().toString()


def logged_table(spark, work, space, *, removing, skip=True):
    """A logged table whose flow has begun at its first commit; two more follow."""
    path = f"{work}/logged"
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    import os

    files = sorted(
        (f for f in os.listdir(path) if f.endswith(".parquet")),
        key=lambda f: spark.read.parquet(f"{path}/{f}").first()[0],
    )
    commits = [[add(files[0])], [add(files[1])]]
    commits.append([add(files[2]), remove(files[0])] if removing else [add(files[2])])
    write_log(path, commits[0])
    spark.catalog.createTable(f"{space}.logged", path=path, source="parquet")
    flows.bootstrap_bronze_flow(
        spark, space, "logged", f"{space}.tgt", skip_change_commits=skip
    ).awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(10))
    write_log(path, *commits[1:], first=1)
    return path


def test_commits_that_remove_data_are_skipped(spark, work, space):
    logged_table(spark, work, space, removing=True)
    flows.bootstrap_bronze_flow(
        spark, space, "logged", f"{space}.tgt", options={"maxFilesPerTrigger": "1"}
    ).awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(20))


def test_without_skipping_they_are_refused(spark, work, space):
    logged_table(spark, work, space, removing=True, skip=False)
    query = flows.bootstrap_bronze_flow(
        spark, space, "logged", f"{space}.tgt", skip_change_commits=False
    )
    with pytest.raises(StreamingQueryException, match="removes data"):
        query.awaitTermination()


def test_compaction_commits_add_no_rows(spark, work, space):
    path = logged_table(spark, work, space, removing=False, skip=False)
    write_log_at = f"{path}/_delta_log/{3:020d}.json"
    import json

    with open(write_log_at, "w") as out:
        for action in (add("gone.parquet", data_change=False), remove("x", data_change=False)):
            out.write(json.dumps(action) + "\n")
    flows.bootstrap_bronze_flow(
        spark, space, "logged", f"{space}.tgt", skip_change_commits=False
    ).awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(30))


def test_streamed_upsert_survives_restart_and_order(spark, work, space):
    rows = spark.range(200).selectExpr("id % 10 AS k", "id AS seq", "CAST(id AS STRING) AS v")
    target = f"{space}.silver"
    for part in (rows.filter("seq >= 100"), rows.filter("seq < 100"), rows):
        make_source(spark, work, space, "src", part.repartition(4))
        scd1.bootstrap_scd1_flow(
            spark, space, "src", ["k"], "seq", target, create_target_table=True, num_buckets=4,
            options={"maxFilesPerTrigger": "3"}, trigger=flows.AVAILABLE_NOW,
        ).awaitTermination()
    merged = sorted(tuple(r) for r in scd1.read_target(spark, target).collect())
    assert merged == [(k, 190 + k, str(190 + k)) for k in range(10)]


def test_upsert_needs_its_target(spark, work, space):
    make_source(spark, work, space, "src", spark.range(1))
    with pytest.raises(ValueError, match="no merged table"):
        scd1.bootstrap_scd1_flow(spark, space, "src", ["id"], "id", f"{space}.none")


def test_table_dropped_after_flows_ran_is_found_again(spark, work, space):
    dated = spark.range(6).withColumn("part_col", F.expr("date'2024-01-01' + int(id % 2)"))
    make_source(spark, work, space, "src", dated)
    for more in (0, 6):
        if more:
            spark.sql(f"DROP TABLE {space}.tgt")
            make_source(spark, work, space, "src", dated.selectExpr(f"id + {more} AS id", "part_col"))
        flows.bootstrap_bronze_flow(
            spark, space, "src", f"{space}.tgt", location=f"{work}/kept"
        ).awaitTermination()
        assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(6 + more))


def test_landing_to_bronze_to_silver(spark, work, space):
    import os

    from lakeops.streaming import landing

    files = landing.CsvLanding("id BIGINT, v INT", f"{work}/in", sort_columns=["v"])
    os.makedirs(f"{work}/in")
    for n, text in enumerate(("id,v\n1,1\n2,5\n", "id,v,note\n1,3,x\n2,4,y\n")):
        with open(f"{work}/in/{n}.csv", "w") as out:
            out.write(text)
        landing.create_landing_table(spark, f"{space}.raw", files).awaitTermination()
        scd1.bootstrap_scd1_flow(
            spark, space, "raw", ["id"], "sort_struct", f"{space}.silver",
            create_target_table=True, num_buckets=2,
            trigger=flows.AVAILABLE_NOW,
        ).awaitTermination()
    merged = scd1.read_target(spark, f"{space}.silver")
    assert sorted((r.id, r.v, r.note) for r in merged.collect()) == [(1, 3, "x"), (2, 5, None)]


def test_two_flows_at_once_share_a_target(spark, work, space):
    targets.create_table(spark, f"{space}.tgt", spark.range(1).schema)
    for name, start in (("a", 0), ("b", 50)):
        rows = spark.range(start, start + 50).withColumn("note", F.lit(name)).repartition(4)
        make_source(spark, work, space, name, rows)
    started = [
        flows.bootstrap_incremental_flow(
            spark, space, name, f"{space}.tgt", flow=name, options={"maxFilesPerTrigger": "1"}
        )
        for name in ("a", "b")
    ]
    flows.await_all(started)
    table = targets.read_table(spark, f"{space}.tgt")
    assert ids(table) == list(range(100)) and table.groupBy("note").count().count() == 2


def test_partitioned_logged_table_keeps_its_partition_column(spark, work, space):
    import os

    path = f"{work}/parted"
    rows = spark.range(10).withColumn("k", (F.col("id") % 2).cast("int"))
    rows.coalesce(1).write.partitionBy("k").parquet(path)
    files = [
        f"{folder}/{name}"
        for folder in ("k=0", "k=1")
        for name in os.listdir(f"{path}/{folder}")
        if name.endswith(".parquet")
    ]
    write_log(path, [add(files[0])], [add(files[1].replace("=", "%3D"))])
    spark.sql(
        f"CREATE TABLE {space}.parted (id BIGINT, k INT) USING parquet "
        f"PARTITIONED BY (k) LOCATION '{path}'"
    )
    flows.bootstrap_bronze_flow(spark, space, "parted", f"{space}.tgt").awaitTermination()
    found = {(r.id, r.k) for r in targets.read_table(spark, f"{space}.tgt").collect()}
    assert found == {(n, n % 2) for n in range(10)}


def test_logged_table_begins_with_its_live_files(spark, work, space):
    """Rows removed before are not copied, files vacuumed do not matter, nothing doubles."""
    import os

    path = f"{work}/live"
    names = []
    for first in (0, 100, 200):
        spark.range(first, first + 5).coalesce(1).write.mode("append").parquet(path)
        names += sorted({n for n in os.listdir(path) if n.endswith(".parquet")} - set(names))
    write_log(path, [add(names[0])], [remove(names[0]), add(names[1])])
    os.remove(f"{path}/{names[0]}")
    with open(f"{path}/_delta_log/{0:020d}.{1:020d}.compacted.json", "w") as out:
        out.write('{"add": {"path": "%s", "size": 1, "dataChange": true}}' % names[1])
    spark.catalog.createTable(f"{space}.live", path=path, source="parquet", schema=spark.range(1).schema)

    def run():
        flows.bootstrap_bronze_flow(spark, space, "live", f"{space}.tgt").awaitTermination()
        return ids(targets.read_table(spark, f"{space}.tgt"))

    assert run() == list(range(100, 105))
    assert run() == list(range(100, 105))
    write_log(path, [add(names[2])], first=2)
    assert run() == [*range(100, 105), *range(200, 205)]


def test_logged_files_are_read_in_slices(spark, work, space, monkeypatch):
    import os

    monkeypatch.setattr(flows, "FILES_PER_SLICE", 3)
    path = f"{work}/sliced"
    spark.range(40).repartition(10).write.parquet(path)
    names = sorted(n for n in os.listdir(path) if n.endswith(".parquet"))
    write_log(path, [add(n) for n in names])
    spark.catalog.createTable(f"{space}.sliced", path=path, source="parquet", schema=spark.range(1).schema)
    flows.bootstrap_bronze_flow(spark, space, "sliced", f"{space}.tgt").awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(40))
    assert spark.table(f"{space}.tgt").select(targets.BATCH).distinct().count() > 1


def test_an_unfinished_batch_stays_hidden(spark, work, space):
    import os

    make_source(spark, work, space, "src", spark.range(6))
    kept = {"location": f"{work}/kept"}
    flows.bootstrap_bronze_flow(spark, space, "src", f"{space}.tgt", **kept).awaitTermination()
    unfinished = f"{work}/kept/{targets.FLOW}=other/{targets.BATCH}=0"
    spark.range(3).write.parquet(unfinished)
    os.remove(f"{unfinished}/_SUCCESS")
    spark.sql(f"DROP TABLE {space}.tgt")
    flows.bootstrap_bronze_flow(spark, space, "src", f"{space}.tgt", **kept).awaitTermination()
    assert ids(targets.read_table(spark, f"{space}.tgt")) == list(range(6))
    with pytest.raises(ValueError, match="reserved"):
        targets.create_table(spark, f"{space}.bad", spark.range(1).withColumnRenamed("id", targets.FLOW).schema)


def test_a_malformed_commit_line_is_refused(spark, work, space):
    path = f"{work}/broken"
    spark.range(5).coalesce(1).write.parquet(path)
    write_log(path, [])
    with open(f"{path}/_delta_log/{1:020d}.json", "w") as out:
        out.write('{"add": {"path": "part-0.parquet", "si')
    spark.catalog.createTable(f"{space}.broken", path=path, source="parquet", schema=spark.range(1).schema)
    (known := f"{work}/state")
    with pytest.raises(Exception, match="malformed line"):
        source = flows.stream_table(spark, f"{space}.broken")
        batch = spark.read.schema(flows.commit_log.LINES_SCHEMA).options(**flows.commit_log.COMMIT_FILES).json(f"{path}/_delta_log")
        batch = batch.select(
            flows.commit_log.commit_version(F.col("_metadata.file_name")).alias("version"), "add", "remove", "fault"
        ).withColumn("table_name", F.lit("t"))
        flows.storage.publish_text(spark, f"{known}.start", "0")
        list(source.slices(batch, 1, known))
