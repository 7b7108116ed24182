"""Hand-written commit logs: every documented edge of the file diagnostics."""

import json
import os
import statistics
from pathlib import Path

import pytest

from lakeops.functions.sizes import BYTES_PER_MB
from lakeops.operators import filestats
from lakeops.plans import diagnose
from lakeops.sources import commit_log, inventory, live_view


def add(path, size=1, data_change=True):
    return {"add": {"path": path, "size": size, "dataChange": data_change, "modificationTime": 0}}


def remove(path, data_change=True):
    return {"remove": {"path": path, "dataChange": data_change, "deletionTimestamp": 0}}


def write_log(folder, *commits, first=0):
    log = os.path.join(folder, "_delta_log")
    os.makedirs(log, exist_ok=True)
    for version, commit in enumerate(commits, first):
        with open(os.path.join(log, f"{version:020d}.json"), "w") as out:
            out.writelines(json.dumps(action) + "\n" for action in commit)
    return folder


def read(spark, **folders):
    return commit_log.read_commit_log(spark, folders)


def paths(files):
    return sorted(row.relative_path for row in files.collect())


def test_all_adds_counts_removed_and_readded_files(spark, work):
    write_log(work, [add("a"), add("b")], [remove("a")], [add("a", 5)], [remove("b")])
    actions = read(spark, t=work)
    assert paths(commit_log.added_files(actions)) == ["a", "a", "b"]
    live = commit_log.live_files(actions).collect()
    assert [(r.relative_path, r.size_in_bytes, r.version) for r in live] == [("a", 5, 2)]


def test_add_and_remove_of_a_path_in_one_commit_leaves_it_live(spark, work):
    write_log(work, [add("a", 1)], [remove("a"), add("a", 2)])
    live = commit_log.live_files(read(spark, t=work)).collect()
    assert [r.size_in_bytes for r in live] == [2]


def test_append_only_drops_whole_commits_that_remove_data(spark, work):
    write_log(
        work,
        [add("a"), add("b")],
        [add("c"), remove("a")],
        [add("d", data_change=False), remove("b", data_change=False)],
    )
    assert paths(commit_log.append_only_files(read(spark, t=work))) == ["a", "b", "d"]


def test_commit_match_is_per_table(spark, work):
    first = write_log(f"{work}/x", [add("a"), remove("z")])
    second = write_log(f"{work}/y", [add("b")])
    files = commit_log.append_only_files(read(spark, x=first, y=second)).collect()
    assert [(r.table_name, r.relative_path) for r in files] == [("y", "b")]


def test_paths_with_escapes_and_absolute_paths(spark, work):
    write_log(work, [add("p%20q/x+y.parquet"), add("s3://bucket/z.parquet"), add("/abs/f")])
    files = commit_log.added_files(read(spark, t=work + "/"), decoded=True).collect()
    by_path = {r.relative_path: r for r in files}
    escaped = by_path["p%20q/x+y.parquet"]
    assert escaped.full_path == f"{work}/p%20q/x+y.parquet"
    assert escaped.decoded_path == f"{work}/p q/x+y.parquet"
    assert by_path["s3://bucket/z.parquet"].decoded_path == "s3://bucket/z.parquet"
    assert by_path["s3://bucket/z.parquet"].full_path == f"{work}/s3://bucket/z.parquet"
    assert by_path["/abs/f"].decoded_path == "/abs/f"


def test_folder_names_with_blanks_are_matched_to_their_table(spark, work):
    folder = write_log(f"{work}/my table+1", [add("a")])
    assert [r.table_name for r in read(spark, t=folder).collect()] == ["t"]


def test_other_json_files_are_read_but_have_no_version(spark, work):
    write_log(work, [add("a")])
    with open(f"{work}/_delta_log/extra.json", "w") as out:
        out.write(json.dumps(add("b")) + "\n")
    rows = commit_log.added_files(read(spark, t=work)).collect()
    assert {(r.relative_path, r.version) for r in rows} == {("a", 0), ("b", None)}


def test_log_without_adds_gives_zeros(spark, work):
    write_log(work, [remove("a")])
    row = diagnose.analyze_table(spark, work).first()
    assert (row.num_files, row.total_size_bytes, row.average_file_size_mb) == (0, 0, 0.0)
    assert row.descriptive_stats is None and row.error is None
    profile = diagnose.analyze_tables(spark, [work, f"{work}/gone"])
    assert filestats.distribution_of(profile, empty_bins=True).count() == 4
    report = {(r.table_name, r.metric): r.value for r in filestats.report(profile).collect()}
    assert report[work, "num_files"] == 0.0 and {name for name, _ in report} == {work}


def test_bins_are_half_open_and_null_counts_as_largest(spark, work):
    edges = [BYTES_PER_MB * n for n in (1, 10, 100)]
    write_log(work, [add(f"f{i}", s) for i, s in enumerate([0, edges[0] - 1, *edges, None])])
    files = commit_log.added_files(read(spark, t=work))
    counts = {r.size_bin: r["count"] for r in filestats.file_size_distribution(files).collect()}
    assert counts == {"<1MB": 2, "1MB-10MB": 1, "10MB-100MB": 1, ">100MB": 2}
    fused = filestats.distribution_of(filestats.file_profile(files))
    assert {r.size_bin: r["count"] for r in fused.collect()} == counts
    own = filestats.file_size_distribution(files, "unknown").collect()
    assert {r.size_bin: r["count"] for r in own}["unknown"] == 1


def test_empty_bins_only_on_request(spark, work):
    write_log(work, [add("a", 5)])
    profile = filestats.file_profile(commit_log.added_files(read(spark, t=work)))
    assert filestats.distribution_of(profile).count() == 1
    assert filestats.distribution_of(profile, empty_bins=True).count() == 4


def test_average_counts_files_of_unknown_size_and_mean_does_not(spark, work):
    write_log(work, [add("a", 10), add("b", 20), add("c", None)])
    row = filestats.file_size_statistics(commit_log.added_files(read(spark, t=work))).first()
    assert (row.num_files, row.average_file_size_bytes) == (3, 10.0)
    assert (row.descriptive_stats["count"], row.descriptive_stats["mean"]) == (2.0, 15.0)


def test_single_file_has_no_deviation(spark, work):
    write_log(work, [add("a", 10)])
    profile = filestats.file_profile(commit_log.added_files(read(spark, t=work)))
    assert profile.first().descriptive_stats.stddev is None
    assert "stddev" not in [r.metric for r in filestats.report(profile).collect()]


def test_many_tables_keep_going_past_one_that_fails(spark, work):
    good = write_log(f"{work}/good", [add("a", 7)])
    rows = diagnose.analyze_tables(spark, [good, f"{work}/gone", "no.such.table", good]).collect()
    by_name = {r.table_name: r for r in rows}
    assert len(rows) == 3
    assert by_name[good].total_size_bytes == 7 and by_name[good].error is None
    assert "no commit log" in by_name[f"{work}/gone"].error
    assert by_name["no.such.table"].error and by_name["no.such.table"].num_files is None


def test_all_tables_failing_is_still_a_result(spark, work):
    rows = diagnose.analyze_tables(spark, [f"{work}/gone"]).collect()
    assert len(rows) == 1 and rows[0].error


def test_configured_tables(spark, work):
    good = write_log(f"{work}/good", [add("a", 7)])
    control = spark.createDataFrame([(good,), (good,)], "table_name STRING")
    assert [r.num_files for r in diagnose.analyze_configured(spark, control).collect()] == [1]
    stats = filestats.file_size_statistics(
        commit_log.added_files(read(spark, **{good: good, "other": good}))
    )
    assert [r.table_name for r in filestats.configured_statistics(control, stats).collect()] == [
        good
    ]


def test_detail_from_log_and_from_files(spark, work):
    spark.range(100).repartition(4).write.mode("append").parquet(f"{work}/t")
    write_log(f"{work}/t", [add("a", 10), add("b", 5)], [remove("a")])
    spark.catalog.createTable("detail_t", path=f"{work}/t", source="parquet")
    logged = diagnose.table_detail(spark, ["detail_t", "gone.t"]).collect()
    by_name = {r.table_name: r for r in logged}
    assert (by_name["detail_t"].num_files, by_name["detail_t"].size_in_bytes) == (1, 5)
    assert by_name["gone.t"].error and by_name["gone.t"].num_files is None
    spark.range(1).coalesce(1).write.parquet(f"{work}/plain")
    spark.catalog.createTable("detail_plain", path=f"{work}/plain", source="parquet")
    both = diagnose.table_detail(spark, ["detail_plain", "detail_t", "gone.t"]).collect()
    assert {r.table_name: r.num_files for r in both} == {
        "detail_plain": 1, "detail_t": 1, "gone.t": None,
    }
    listed = diagnose.table_detail(spark, ["detail_t"], diagnose.FILES).first()
    on_disk = [f for f in os.listdir(f"{work}/t") if f.endswith(".parquet")]
    assert listed.num_files == len(on_disk) == 4
    assert listed.size_in_bytes == sum(os.path.getsize(f"{work}/t/{f}") for f in on_disk)


def test_inventory_counts_nested_folders_once_per_table(spark, work):
    spark.range(10).selectExpr("id", "id % 2 AS k").coalesce(1).write.partitionBy("k").parquet(
        f"{work}/a b"
    )
    spark.range(1).coalesce(1).write.parquet(f"{work}/c")
    files = inventory.read_file_inventory(spark, {"x": f"{work}/a b", "y": f"{work}/c"})
    assert {(r.table_name, r["count"]) for r in files.groupBy("table_name").count().collect()} == {
        ("x", 2),
        ("y", 1),
    }


def test_inventory_does_not_read_file_contents(spark, work):
    spark.range(1).write.parquet(f"{work}/t")
    plan = inventory.read_file_inventory(spark, {"t": f"{work}/t"})._jdf.queryExecution()
    assert "content" not in plan.executedPlan().toString()


def test_one_scan_and_no_inference_for_many_tables(spark, work):
    folders = {f"t{i}": write_log(f"{work}/t{i}", [add("a", i)]) for i in range(5)}
    profile = filestats.file_profile(commit_log.added_files(read(spark, **folders)))
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan
    assert "remove" not in plan.split("ReadSchema")[1]


def test_profile_totals_add_up(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    from spark_queries import inputs

    files = commit_log.added_files(inputs.actions(spark, sf))
    profile = filestats.file_profile(files)
    for row in profile.collect():
        assert sum(b["count"] for b in row.size_distribution) == row.num_files
    assert contract.queries()["file_size_stats"](spark, sf).count() == profile.count()


@pytest.mark.parametrize("mode", [diagnose.ALL_ADDS, diagnose.LIVE, diagnose.FILES])
def test_modes_share_one_shape(spark, work, mode):
    spark.range(1).write.parquet(f"{work}/t")
    write_log(f"{work}/t", [add("a", 3)])
    columns = diagnose.analyze_table(spark, f"{work}/t", mode).columns
    assert columns[0] == "table_name" and columns[-1] == "error"


def test_live_files_come_from_checkpoints_too(spark, work):
    log = f"{work}/_delta_log"
    write_log(work, [add("late", 5)], [remove("old1")], first=11)
    held = [(f"old{i}", 10) for i in range(11)]
    rows = spark.createDataFrame(held, "path STRING, size BIGINT").selectExpr(
        "named_struct('path', path, 'size', size, 'dataChange', true, 'modificationTime', 0L) AS add",
        "CAST(NULL AS STRUCT<path: STRING, dataChange: BOOLEAN, deletionTimestamp: BIGINT>) AS remove",
    )
    rows.coalesce(1).write.parquet(f"{work}/held")
    part = next(n for n in os.listdir(f"{work}/held") if n.endswith(".parquet"))
    os.rename(f"{work}/held/{part}", f"{log}/{10:020d}.checkpoint.parquet")
    with open(f"{log}/{12:020d}.checkpoint.{1:010d}.{2:010d}.parquet", "w"):
        pass  # one part of two: not complete
    row = diagnose.table_detail(spark, [work], diagnose.LIVE).first()
    assert (row.num_files, row.size_in_bytes, row.error) == (11, 105, None)
    os.remove(f"{log}/{11:020d}.json")
    row = diagnose.table_detail(spark, [work], diagnose.LIVE).first()
    assert row.num_files is None and "lacks commit 11" in row.error


@pytest.mark.parametrize("kind", ["orc", "json", "csv"])
def test_files_of_every_format_count(spark, work, kind):
    spark.range(20).repartition(3).write.format(kind).save(f"{work}/t")
    os.makedirs(f"{work}/t/_hidden")
    with open(f"{work}/t/_hidden/x", "w") as out:
        out.write("x")
    row = diagnose.table_detail(spark, [f"{work}/t"], diagnose.FILES).first()
    on_disk = [n for n in os.listdir(f"{work}/t") if n.startswith("part-")]
    assert row.num_files == len(on_disk) == 3
    assert row.size_in_bytes == sum(os.path.getsize(f"{work}/t/{n}") for n in on_disk)


def checkpointed(spark, folder, rows, parts):
    """A log whose checkpoint, in parts, holds ``rows`` adds of size 1 in its first part."""
    for part in range(1, parts + 1):
        held = [((f"c{i}", 1, True, 0), None) for i in range(rows if part == 1 else 0)]
        draft = f"{folder}/draft{part}"
        spark.createDataFrame(held, commit_log.ACTIONS_SCHEMA).coalesce(1).write.parquet(draft)
        written = next(Path(draft).glob("part-*.parquet"))
        name = f"{3:020d}.checkpoint.{part:010d}.{parts:010d}.parquet"
        Path(folder, "_delta_log").mkdir(exist_ok=True)
        written.rename(Path(folder, "_delta_log", name))
    return Path(folder, "_delta_log")


def test_faults_cost_their_own_table_only(spark, tmp_path):
    logs = {}
    for name in ("good", "cut", "footer", "pages", "typed"):
        (tmp_path / name).mkdir()
        logs[name] = checkpointed(spark, str(tmp_path / name), 5000, 2)
        line = '{"add": {"path": "new", "size": 2}}\n'
        extra = {"cut": '{"add": {"path": "lo', "typed": '{"add": {"path": "x", "size": "big"}}'}.get(name, "\n")
        (logs[name] / f"{4:020d}.json").write_text(line + extra)
    first = f"{3:020d}.checkpoint.{1:010d}.{2:010d}.parquet"
    whole = (logs["footer"] / first).read_bytes()
    for log in logs.values():
        for crc in log.glob(".*.crc"):
            crc.unlink()
    (logs["footer"] / first).write_bytes(whole[: len(whole) // 2])
    (logs["pages"] / first).write_bytes(whole[:4] + bytes(2000) + whole[2004:])
    names = [str(tmp_path / name) for name in logs]
    for rows in (
        diagnose.analyze_tables(spark, names, diagnose.LIVE).collect(),
        diagnose.table_detail(spark, names, diagnose.LIVE).collect(),
    ):
        found = {r.table_name.rsplit("/", 1)[1]: r for r in rows}
        assert (found["good"].num_files, found["good"].error) == (5001, None)
        for name, fault in (
            ("cut", "malformed line in 00000000000000000004.json: "),
            ("typed", "malformed line in 00000000000000000004.json: "),
            ("footer", f"unreadable checkpoint {first}"),
            ("pages", f"unreadable checkpoint {first}"),
        ):
            assert found[name].num_files is None and found[name].error.startswith(fault)
    adds = {r.table_name.rsplit("/", 1)[1]: r for r in diagnose.analyze_tables(spark, names).collect()}
    assert {n: (r.num_files, r.error is None) for n, r in adds.items()} == {
        "good": (1, True), "cut": (None, False), "footer": (1, True), "pages": (1, True), "typed": (None, False)
    }


def test_only_new_commits_are_read(spark, work):
    def commit(table, version, *lines):
        log = f"{work}/{table}/_delta_log"
        os.makedirs(log, exist_ok=True)
        with open(f"{log}/{version:020d}.json", "w") as out:
            out.writelines(json.dumps(line) + "\n" if isinstance(line, dict) else line for line in lines)

    def added(name, size):
        return {"add": {"path": name, "size": size, "dataChange": True}}

    def found():
        rows = diagnose.analyze_new_commits(spark, [f"{work}/{t}" for t in "abcd"], f"{work}/store").collect()
        return {r.table_name[-1]: r for r in rows}

    mb = 1024 * 1024
    for table in "abc":
        commit(table, 0, added("p0", 10), added("p1", 20 * mb))
    commit("d", 0, {"commitInfo": {}})
    first = found()
    assert [first[t].num_files for t in "abcd"] == [2, 2, 2, 0]
    assert first["d"].descriptive_stats["count"] in (0, None)
    # What was read is not read again: garbage there goes unseen.
    commit("a", 0, "{{{")
    commit("a", 1, added("p2", None), added("p3", 7))
    commit("b", 1, added("p2", 1), '{"add": {"pa')
    os.rename(f"{work}/c/_delta_log/{0:020d}.json", f"{work}/c/_delta_log/{5:020d}.json")
    second = found()
    sizes = [10, 20 * mb, 7]
    stats = second["a"].descriptive_stats
    assert (second["a"].num_files, second["a"].total_size_bytes, stats["count"]) == (4, sum(sizes), 3)
    assert stats["stddev"] == pytest.approx(statistics.stdev(sizes), rel=1e-12)
    assert (stats["min"], stats["max"]) == (7, 20 * mb)
    assert [row["count"] for row in second["a"].size_distribution] == [2, 0, 1, 1]
    assert second["b"].num_files is None and "malformed line" in second["b"].error
    assert "gone" in second["c"].error
    # A mended commit goes on where its table stopped; without news nothing changes.
    commit("b", 1, added("p2", 1))
    third = found()
    assert third["b"].num_files == 3 and third["b"].error is None
    assert third["a"] == second["a"] and found()["b"] == third["b"]


def live_now(spark, locations):
    found = diagnose.table_files(spark, locations, diagnose.LIVE)
    return sorted(found.collect(), key=str)


def kept_now(spark, store, names=None):
    return sorted(live_view.read(spark, store, names).collect(), key=str)


def test_kept_view_follows_every_commit(spark, work, monkeypatch):
    locations = {name: f"{work}/{name}" for name in ("a", "b")}
    store = f"{work}/store"
    write_log(locations["a"], [add("p1"), add("p2", 5)], [remove("p1")])
    write_log(locations["b"], [add("p1", 7)])
    news = [
        ("a", [add("p1", 9), remove("p2")]),
        ("b", [remove("p1"), add("p3", 4)]),
        ("a", [add("p2", 6), remove("p2")]),
        ("b", [{"commitInfo": {}}]),
        ("a", [add("p4", None), remove("nowhere")]),
    ]
    version = {"a": 2, "b": 1}
    monkeypatch.setattr(live_view, "MERGE_PIECES", 3)
    monkeypatch.setattr(live_view, "MERGE_SHARE", 1e9)
    assert live_view.refresh(spark, locations, store) == {}
    assert kept_now(spark, store) == live_now(spark, locations)
    before = kept_now(spark, store)
    earlier = live_view.read(spark, store)
    for table, lines in news:
        write_log(locations[table], lines, first=version[table])
        version[table] += 1
        # What was read is not opened again.
        old = Path(locations[table], "_delta_log", f"{0:020d}.json")
        text = old.read_text()
        old.write_text("{{{")
        assert live_view.refresh(spark, locations, store) == {}
        old.write_text(text)
        assert kept_now(spark, store) == live_now(spark, locations)
    assert sorted(earlier.collect(), key=str) == before
    manifest = live_view.newest(spark, store)
    pieces = {number for kept in manifest.tables.values() for number in kept.pieces}
    assert manifest.merged > 0 and len(pieces) <= 3
    # Nothing new: nothing is written.
    assert live_view.refresh(spark, locations, store) == {}
    assert live_view.newest(spark, store) == manifest
    assert live_view.drop_unused(spark, store)
    assert kept_now(spark, store) == live_now(spark, locations)
    assert {r.table_name for r in kept_now(spark, store, ["b"])} == {"b"}


def test_kept_view_of_broken_and_replaced_logs(spark, work):
    locations = {name: f"{work}/{name}" for name in ("good", "cut", "moved", "gone")}
    store = f"{work}/store"
    for folder in locations.values():
        write_log(folder, [add("p1", 3)], [add("p2", 4)])
    assert live_view.refresh(spark, locations, store) == {}
    log = {name: Path(folder, "_delta_log") for name, folder in locations.items()}
    for name in locations:
        write_log(locations[name], [remove("p1"), add("p3", 5)], first=2)
    whole = (log["cut"] / f"{2:020d}.json").read_text()
    (log["cut"] / f"{2:020d}.json").write_text(whole[:-9])
    # A log that starts over is shorter than what was read of it.
    for version in (1, 2):
        (log["moved"] / f"{version:020d}.json").unlink()
    (log["gone"] / f"{1:020d}.json").unlink()
    faults = live_view.refresh(spark, locations, store)
    assert set(faults) == {"cut", "gone"}
    assert "malformed line" in faults["cut"] and "lacks commit 1" in faults["gone"]

    def paths():
        rows = live_view.read(spark, store).groupBy("table_name").agg({"relative_path": "collect_set"})
        return {row[0]: set(row[1]) for row in rows.collect()}

    assert paths() == {
        "good": {"p2", "p3"}, "cut": {"p1", "p2"}, "moved": {"p1"}, "gone": {"p1", "p2"}
    }
    (log["cut"] / f"{2:020d}.json").write_text(whole)
    names = list(locations.values())
    assert set(live_view.refresh(spark, locations, store)) == {"gone"}
    assert paths()["cut"] == {"p2", "p3"}
    rows = {r.table_name: r for r in diagnose.analyze_live_view(spark, [*names, f"{work}/none"], f"{work}/other").collect()}
    assert {n[len(work) + 1 :]: (r.num_files, r.error is None) for n, r in rows.items()} == {
        "good": (2, True), "cut": (2, True), "moved": (1, True), "gone": (None, False), "none": (None, False)
    }


def test_kept_view_without_any_table(spark, work):
    assert live_view.refresh(spark, {}, f"{work}/store") == {}
    assert kept_now(spark, f"{work}/store") == []


def test_first_pieces_of_a_kept_view_are_not_shuffled(spark, work, monkeypatch):
    monkeypatch.setattr(live_view, "MERGE_SHARE", 1e9)
    locations = {"a": f"{work}/a"}
    write_log(locations["a"], [add(f"p{i}", i) for i in range(50)])
    live_view.refresh(spark, locations, f"{work}/store")
    write_log(locations["a"], [remove("p1")], first=1)
    live_view.refresh(spark, locations, f"{work}/store")
    files = live_view.read(spark, f"{work}/store")
    assert files.count() == 49
    plan = files._jdf.queryExecution().executedPlan().toString()
    anti = next(line for line in plan.splitlines() if "LeftAnti" in line)
    assert "BroadcastHashJoin" in anti
