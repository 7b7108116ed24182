"""Small batches written together."""

import datetime
import uuid

import pyspark.sql.functions as F
import pytest

from lakeops.streaming import flows, packing, targets
from tests.test_streams import ids, make_source, space  # noqa: F401


def partitions(spark, table):
    return {row[0] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()}


def filled(spark, table, batches=6, flow="f/1"):
    targets.create_table(spark, table, spark.range(1).schema)
    for n in range(batches):
        targets.append_batch(spark, table, flow, n, spark.range(10 * n, 10 * n + 10, 1, 1))


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_keeps_every_item_within_bounds(seed):
    sizes = {i: (i * 7919 + seed * 31) % 60 + 1 for i in range(200)}
    bins = packing.first_fit(sizes, 64)
    assert sorted(i for members in bins for i in members) == sorted(sizes)
    filled = [sum(sizes[i] for i in members) for members in bins]
    assert max(filled) <= 64
    # Two bins that would go into one cannot be left.
    assert sum(total <= 32 for total in filled) <= 1
    assert packing.first_fit({}, 64) == []


def test_packed_rows_stay_and_partitions_go(spark, work, space):  # noqa: F811
    table = f"{space}.t"
    filled(spark, table)
    filled(spark, table, 3, "g")
    assert packing.pack_batches(spark, table, ["id"], partly=True) == 7
    # The newest batch of each flow stays as it is.
    names = {"ingest_flow=f%2F1/ingest_batch=0", "ingest_flow=f%2F1/ingest_batch=5"}
    names |= {"ingest_flow=g/ingest_batch=0", "ingest_flow=g/ingest_batch=2"}
    assert partitions(spark, table) == names
    assert ids(spark.table(table)) == sorted([*range(60), *range(30)])
    by_flow = spark.table(table).groupBy(targets.FLOW).count().collect()
    assert {tuple(row) for row in by_flow} == {("f/1", 60), ("g", 30)}
    # Replayed batches do not come back, later ones are packed with later ones.
    for n in (0, 3):
        targets.append_batch(spark, table, "f/1", n, spark.range(10 * n, 10 * n + 10))
    assert partitions(spark, table) == names
    assert packing.pack_batches(spark, table, partly=True) == 0
    for n in (6, 7):
        targets.append_batch(spark, table, "f/1", n, spark.range(10 * n, 10 * n + 10))
    assert packing.pack_batches(spark, table) == 0
    assert packing.pack_batches(spark, table, partly=True) == 2
    assert ids(spark.table(table).filter(F.col(targets.FLOW) == "f/1")) == list(range(80))


def test_large_batches_and_bins_with_room_are_left(spark, work, space):  # noqa: F811
    table = f"{space}.t"
    filled(spark, table, 5)
    assert packing.pack_batches(spark, table, pack_bytes=100) == 0
    assert packing.pack_batches(spark, table, pack_bytes=1 << 30) == 0
    assert len(partitions(spark, table)) == 5


def test_streams_do_not_see_packs(spark, work, space):  # noqa: F811
    for n in range(5):
        make_source(spark, work, space, "src", spark.range(4 * n, 4 * n + 4, 1, 1))

    def run(source, target):
        flows.bootstrap_bronze_flow(
            spark, space, source, f"{space}.{target}", options={"maxFilesPerTrigger": "1"}
        ).awaitTermination()

    run("src", "bronze")
    run("bronze", "early")
    assert packing.pack_batches(spark, f"{space}.bronze", partly=True) == 4
    make_source(spark, work, space, "src", spark.range(20, 24))
    for source, target in (("src", "bronze"), ("bronze", "early"), ("bronze", "late")):
        run(source, target)
    for table in ("bronze", "early", "late"):
        assert ids(targets.read_table(spark, f"{space}.{table}")) == list(range(24))


def test_a_stopped_switch_is_finished(spark, work, space, monkeypatch):  # noqa: F811
    table = f"{space}.t"
    filled(spark, table)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(targets, "show_pack", stop)
        with pytest.raises(KeyboardInterrupt):
            packing.pack_batches(spark, table, partly=True)
    assert packing.pack_batches(spark, table, partly=True) == 0
    assert ids(spark.table(table)) == list(range(60))
    assert len(partitions(spark, table)) == 2


def test_dated_table_with_empty_batches_and_new_columns_is_found_again(spark, work):
    table = f"default.t_{uuid.uuid4().hex[:8]}"
    days = [datetime.date(2024, 1, 1 + n % 2) if n else None for n in range(5)]
    rows = [spark.createDataFrame([(n, day)], "id INT, day DATE") for n, day in enumerate(days)]
    location = f"{work}/dated"
    for again in (False, True):
        targets.create_table(spark, table, rows[0].schema, ["day"], location=location)
        if not again:
            for n, batch in enumerate([*rows, rows[0].filter("false"), rows[1]]):
                if n == 4:
                    batch = batch.withColumn("note", F.lit("new"))
                targets.add_missing_columns(spark, table, batch.schema)
                targets.append_batch(spark, table, "f", n, batch, ["day"])
            assert packing.pack_batches(spark, table, partly=True) == 6
        elif "note" not in spark.table(table).columns:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS (note STRING)")
        found = spark.table(table).select("id", "day", "note").collect()
        expected = [(n, day, "new" if n == 4 else None) for n, day in enumerate(days)]
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, [*expected, (1, days[1], None)]))
        assert spark.table(table).filter("day IS NULL").count() == 1
        spark.sql(f"DROP TABLE {table}")
