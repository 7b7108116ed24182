"""Contract of the type-1 upsert, batch core and merged target."""

import itertools
import uuid

import pyspark.sql.functions as F
import pytest

from lakeops.operators.upsert import latest_by_key
from lakeops.streaming import scd1



@pytest.fixture(autouse=True, params=["sent", "shuffled"])
def way(request, monkeypatch):
    """Every test merges batches both ways: sent to the scan, and shuffled with it."""
    if request.param == "shuffled":
        monkeypatch.setattr(scd1, "SENT_BYTES", 0)
    return request.param


SCHEMA = "k STRING, seq INT, a STRING, b INT"
OLD, NEW = ("x", 1, "old", 1), ("x", 2, None, 2)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def target_rows(spark, target):
    return rows(scd1.read_target(spark, target).select("k", "seq", "a", "b"))


def merge(spark, target, batch, batch_id=0):
    scd1.merge_batch(spark, target, batch, ["k"], "seq", "f", batch_id)


@pytest.fixture
def target(spark, work):
    return new_target(spark, work, 4)


def new_target(spark, work, buckets):
    name = f"merged_{uuid.uuid4().hex[:10]}"
    scd1.create_target(spark, name, frame(spark).schema, buckets, location=f"{work}/{name}")
    return name


def test_newest_whole_row_wins(spark):
    assert rows(latest_by_key(frame(spark, OLD, NEW), ["k"], "seq")) == [NEW]


def test_null_keys_are_one_group_and_null_sequence_is_lowest(spark):
    df = frame(spark, (None, 1, "p", 1), (None, 2, "q", 1), ("n", None, "only", 1))
    assert rows(latest_by_key(df, ["k"], "seq")) == sorted(
        [(None, 2, "q", 1), ("n", None, "only", 1)], key=repr
    )
    df = frame(spark, ("n", None, "late", 9), ("n", -5, "known", 1))
    assert rows(latest_by_key(df, ["k"], "seq")) == [("n", -5, "known", 1)]


def test_ties_go_to_the_highest_remaining_columns(spark):
    tied = [("x", 1, "m", 1), ("x", 1, "m", 3), ("x", 1, None, 9), ("x", 1, "c", 5)]
    for order in itertools.permutations(tied):
        assert rows(latest_by_key(frame(spark, *order), ["k"], "seq")) == [("x", 1, "m", 3)]


def test_keys_and_sequence_may_be_columns(spark):
    df = frame(spark, ("X", 1, "a", 1), ("x", 2, "b", 1))
    assert rows(latest_by_key(df, [F.lower("k")], F.struct("seq", "b"))) == [("x", 2, "b", 1)]


def test_columns_without_order_do_not_break_ties(spark):
    df = spark.sql("SELECT 'x' AS k, 1 AS seq, map('a', 1) AS m")
    assert latest_by_key(df, ["k"], "seq").count() == 1


def test_losing_rows_go_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS seq")
    plan = latest_by_key(df, ["k"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_late_row_changes_nothing(spark, target):
    merge(spark, target, frame(spark, NEW))
    merge(spark, target, frame(spark, OLD), 1)
    assert target_rows(spark, target) == [NEW]


def test_any_batch_order_gives_the_same_table(spark, work):
    batches = [
        [("x", 3, "c", 1), ("y", 1, "a", 1)],
        [("x", 1, "a", 1), (None, 1, "n", 0)],
        [("y", 1, "b", 0), ("x", 2, None, 7)],
    ]
    results = set()
    for order in itertools.permutations(batches):
        target = new_target(spark, work, 2)
        for i, batch in enumerate(order):
            merge(spark, target, frame(spark, *batch), i)
        results.add(repr(target_rows(spark, target)))
    assert len(results) == 1


def test_a_batch_that_failed_half_way_is_merged_again(spark, target, monkeypatch):
    old = [(str(i), 1, "old", i) for i in range(20)]
    new = [(str(i), 2, "new", i) for i in range(20)]
    merge(spark, target, frame(spark, *old))
    real, seen = type(spark).sql, []

    def failing(self, query, *more, **args):
        if "SET LOCATION" in query:
            seen.append(query)
            if len(seen) == 3:
                raise OSError("lost")
        return real(self, query, *more, **args)

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", failing)
        with pytest.raises(OSError):
            merge(spark, target, frame(spark, *new), 1)
    assert scd1.read_target(spark, target).count() == 20
    merge(spark, target, frame(spark, *new), 1)
    assert target_rows(spark, target) == sorted(new, key=repr)


def test_seeded_target_keeps_its_rows(spark):
    name = f"seeded_{uuid.uuid4().hex[:10]}"
    scd1.seed_target(spark, name, frame(spark, NEW, ("y", 1, "k", 1)), ["k"], "seq", 4)
    merge(spark, name, frame(spark, OLD, ("y", 2, "k2", 2)))
    assert target_rows(spark, name) == [NEW, ("y", 2, "k2", 2)]
    assert spark.table(name).count() == 2


def test_new_columns_are_added_and_old_rows_read_null(spark, target):
    merge(spark, target, frame(spark, OLD, ("y", 1, "k", 1)))
    merge(spark, target, frame(spark, NEW).withColumn("extra", F.lit("e")), 1)
    merge(spark, target, frame(spark, ("z", 1, "n", 1)), 2)
    table = scd1.read_target(spark, target)
    assert {r.k: r.extra for r in table.collect()} == {"x": "e", "y": None, "z": None}


def test_columns_named_like_ours_survive(spark, work):
    named = frame(spark, OLD, ("y", 1, "k", 1)).withColumns(
        {"key_bucket": F.lit(7), "key_rank": F.lit("r"), "key_piece": F.lit(1)}
    )
    scd1.seed_target(spark, (name := f"named_{uuid.uuid4().hex[:10]}"), named, ["k"], "seq", 2)
    scd1.merge_batch(spark, name, named.withColumn("seq", F.lit(9)), ["k"], "seq", "f", 0)
    found = scd1.read_target(spark, name)
    assert rows(found.select("k", "seq", "key_bucket", "key_rank", "key_piece")) == [
        ("x", 9, 7, "r", 1), ("y", 9, 7, "r", 1),
    ]
    assert rows(latest_by_key(named, ["k"], "seq").select("k", "key_rank")) == [("x", "r"), ("y", "r")]
    with pytest.raises(ValueError, match="reserved"):
        merge(spark, new_target(spark, work, 2), frame(spark, OLD).withColumn("key_bucket", F.lit(1)))


def test_only_touched_buckets_are_rewritten(spark, work):
    target = new_target(spark, work, 16)
    merge(spark, target, frame(spark, *[(str(i), 1, "a", i) for i in range(100)]))
    before = set(spark.table(target).inputFiles())
    merge(spark, target, frame(spark, ("5", 2, "b", 5)), 1)
    after = set(spark.table(target).inputFiles())
    assert len(after - before) == 1 and scd1.read_target(spark, target).count() == 100


def test_a_large_bucket_is_split_over_tasks_and_files(spark, work, monkeypatch):
    target = new_target(spark, work, 1)
    many = [(str(i), 1, "a", i) for i in range(300)]
    merge(spark, target, frame(spark, *many))
    assert len(spark.table(target).inputFiles()) == 1
    monkeypatch.setattr(scd1, "PIECE_BYTES", 500)
    monkeypatch.setattr(scd1, "SENT_BYTES", 0)
    merge(spark, target, frame(spark, ("5", 2, "b", 5)), 1)
    assert len(spark.table(target).inputFiles()) > 3
    assert target_rows(spark, target) == sorted([r for r in many if r[0] != "5"] + [("5", 2, "b", 5)], key=repr)


def test_another_number_of_buckets(spark, target):
    all_rows = [(str(i), 1, "a", i) for i in range(50)] + [(None, 1, "n", 0)]
    merge(spark, target, frame(spark, *all_rows))
    for buckets in (9, 2):
        scd1.rebucket(spark, target, ["k"], "seq", buckets)
        assert target_rows(spark, target) == sorted(all_rows, key=repr)
        assert spark.sql(f"SHOW PARTITIONS {target}").count() <= buckets
    merge(spark, target, frame(spark, ("5", 2, "b", 5)), 1)
    assert scd1.read_target(spark, target).filter("seq = 2").count() == 1
    assert scd1.read_target(spark, target).count() == 51


def test_stale_batches_are_dropped(spark, target):
    for i in range(4):
        merge(spark, target, frame(spark, ("x", i, "a", i)), i)
    assert len(scd1.drop_stale(spark, target)) == 3
    assert scd1.drop_stale(spark, target) == []
    assert target_rows(spark, target) == [("x", 3, "a", 3)]


def test_missing_target_is_refused(spark):
    with pytest.raises(ValueError, match="no merged table"):
        merge(spark, "no_such_merged_table", frame(spark, NEW))
    spark.range(1).write.mode("overwrite").saveAsTable("not_merged")
    with pytest.raises(ValueError, match="another table"):
        merge(spark, "not_merged", frame(spark, NEW))


def test_clustered_target(spark, target):
    batch = frame(spark, *[(str(i), 1, "a", -i) for i in range(20)])
    scd1.merge_batch(spark, target, batch, ["k"], "seq", "f", 0, cluster_by=["b"])
    assert scd1.read_target(spark, target).count() == 20


def test_an_empty_batch_changes_nothing(spark, target):
    merge(spark, target, frame(spark, NEW))
    merge(spark, target, frame(spark), 1)
    assert target_rows(spark, target) == [NEW]


def test_a_first_load_is_split_by_its_own_size(spark, work, monkeypatch):
    monkeypatch.setattr(scd1, "PIECE_BYTES", 2000)
    monkeypatch.setattr(scd1, "SENT_BYTES", 0)
    target = new_target(spark, work, 1)
    many = [(str(i), 1, f"a{i}", i) for i in range(2000)]
    merge(spark, target, frame(spark, *many))
    assert len(spark.table(target).inputFiles()) > 3
    assert target_rows(spark, target) == sorted(many, key=repr)


def test_current_rows_are_not_shuffled_for_a_small_batch(spark, work):
    path = f"{work}/batch"
    frame(spark, *[(str(i), i % 5, "new", i) for i in range(0, 900, 3)]).withColumn(
        "key_bucket", scd1.key_bucket(["k"], 4)
    ).write.parquet(path)
    target = new_target(spark, work, 4)
    merge(spark, target, frame(spark, *[(str(i), 2, "old", i) for i in range(600)]))
    merged = scd1.updated_rows(spark.table(target), spark.read.parquet(path), "key_bucket", ["k"], "seq")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if line.strip()]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "merged_" in line and "seq" in line.split("ReadSchema")[-1]]
    assert len(scans) == 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    above, now = [], depth(lines[scans[0]])
    for line in reversed(lines[: scans[0]]):
        if depth(line) < now:
            above.append(line.lstrip(" :+-|").split("(")[0].strip())
            now = depth(line)
    assert not [name for name in above if name.endswith("Exchange")]
    old = {str(i): (2, "old") for i in range(600)}
    new = {str(i): (i % 5, "new") for i in range(0, 900, 3)}
    expected = {k: max((v for v in (old.get(k), new.get(k)) if v), key=lambda v: (v[0], v[1])) for k in old | new}
    assert {r.k: (r.seq, r.a) for r in merged.collect()} == expected
