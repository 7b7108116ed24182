"""CSV landing: headers, hints, rescue, incremental pick-up."""

import gzip
import json
import os
import uuid

import pytest

from lakeops.streaming import landing, targets
from lakeops.streaming.landing import CsvLanding, file_age, read_files

HINTS = "id BIGINT, amount DOUBLE"


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "wb") as out:
        out.write(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return path


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_columns_are_matched_by_name(spark, work):
    files = [
        put(work, "a.csv", "id,amount\n1,1.5\n"),
        put(work, "b.csv", "id,note,amount\n2,hi,2.5\n"),
        put(work, "c.csv", "﻿id,amount\n3,3.5\n"),
        put(work, "d [x].csv", "\n\nid,amount\n4,4.5\n"),
        put(work, "e.csv.gz", "amount,id\n5.5,5\n"),
        put(work, "f.csv", '"id","no,te",amount\n6,"a,b",6.5\n'),
        put(work, "empty.csv", ""),
    ]
    df = read_files(spark, CsvLanding(HINTS, work), files)
    assert rows(df, "id", "amount", "note") == [
        (1, 1.5, None), (2, 2.5, "hi"), (3, 3.5, None), (4, 4.5, None), (5, 5.5, None), (6, 6.5, None),
    ]
    assert rows(df.filter("id = 6"), "`no,te`") == [("a,b",)]
    assert {rescued for _, rescued in rows(df, "id", "_rescued_data")} == {None}
    assert df.filter("file_nm LIKE '%e.csv.gz'").count() == 1


def test_bad_fields_and_short_rows_are_rescued(spark, work):
    path = put(work, "a.csv", "id,amount\n1,x\n2\n3,3.0,extra\n4,NULL\n5,\n")
    df = read_files(spark, CsvLanding(HINTS, work), [path])
    assert rows(df, "id", "amount", "_rescued_data") == [
        (1, None, "1,x"), (2, None, "2"), (3, 3.0, "3,3.0,extra"), (4, None, None), (5, None, None),
    ]


def test_refused_fields_are_rescued_by_name(spark, work):
    lines = ['1,x,"q"', "2", '3,3.0,n,"e \\"1\\", f",,NULL,z', ",y,n", "4,NULL,n", 'u,"v,w",n', "5,5.0,n"]
    path = put(work, "a.csv", "id,amount,note\n" + "\n".join(lines) + "\n")
    df = read_files(spark, CsvLanding(HINTS, work, rescue=landing.FIELDS), [path])
    found = {}
    for row in df.collect():
        kept = json.loads(row["_rescued_data"]) if row["_rescued_data"] else None
        assert kept is None or kept.pop("_file_path") == row["file_nm"]
        found[row["id"], row["amount"], row["note"]] = kept
    assert found == {
        (1, None, "q"): {"amount": "x"},
        (2, None, None): None,
        (3, 3.0, "n"): {"_c3": 'e "1", f', "_c6": "z"},
        (None, None, "n"): found[None, None, "n"],
        (4, None, "n"): None,
        (5, 5.0, "n"): None,
    }
    bad = [json.loads(r[0]) for r in df.filter("id IS NULL").select("_rescued_data").collect()]
    assert sorted((b.get("id", ""), b["amount"]) for b in bad) == [("", "y"), ("u", "v,w")]
    with pytest.raises(ValueError, match="rescue"):
        CsvLanding(HINTS, work, rescue="none")


def test_hinted_columns_exist_even_if_no_file_has_them(spark, work):
    path = put(work, "a.csv", "ID|x\n1|NULL\n")
    df = read_files(spark, CsvLanding(HINTS, work, delimiter="|"), [path])
    assert df.columns == ["ID", "x", "_rescued_data", "file_nm", "amount"]
    assert rows(df, "id", "x", "amount") == [(1, None, None)]
    none = read_files(spark, CsvLanding(HINTS, work), [])
    assert none.count() == 0 and {"id", "amount", "file_nm"} <= set(none.columns)


def test_repeated_and_blank_header_names(spark, work):
    path = put(work, "a.csv", "id,v,v,\n1,a,b,c\n")
    df = read_files(spark, CsvLanding(HINTS, work), [path])
    assert rows(df, *df.columns[:4]) == [(1, "a", "b", "c")]


@pytest.mark.parametrize(
    "line", ["id,v,V,,NULL,id2", 'a,"b ""q"" c",A, x ', "one", '"x,y",\\"z', "é,É,e"]
)
def test_headers_are_named_as_the_reader_names_them(spark, work, line):
    path = put(work, "h.csv", f"{line}\n")
    files = CsvLanding(HINTS, work)
    by_reader = spark.read.options(**files.csv_options).csv(path).columns
    assert read_files(spark, files, [path]).columns[: len(by_reader)] == by_reader


HEADS = {
    "a.csv": ("id,b\n1,2\n", "id,b"),
    "b c%20[x].csv": ("\r\n  \r\nid;é\r1;2", "id;é"),
    "c.csv.gz": ("\n\n" + "x" * 200_000 + "\nrest", "x" * 200_000),
    "d.csv": ("only", "only"),
    "e.csv": ("\n \n\n", None),
    "f.csv": ("", None),
    "g.csv": ("\ufeffid,b\n" + "1,2\n" * 50_000, "id,b"),
}


@pytest.mark.parametrize("closed", [False, True])
def test_first_lines_are_read_by_one_job(spark, work, monkeypatch, closed):
    """Also in a store that Arrow cannot open, whose files Spark's reader lists by URL."""
    if closed:
        monkeypatch.setattr(landing, "_opener", lambda path: None)
    paths = {put(work, name, text): line for name, (text, line) in HEADS.items()}
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = landing.first_lines(spark, list(paths)).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {os.path.basename(r.path): r.line for r in found} == {
        os.path.basename(path): line for path, line in paths.items() if line
    }
    assert jobs <= 5  # one for every stage, whatever the number of files


def test_files_in_a_closed_store_are_landed(spark, work, monkeypatch):
    monkeypatch.setattr(landing, "_opener", lambda path: None)
    files = [put(work, f"{n} [x].csv", f"id,c{n}\n{n},x\n") for n in range(3)]
    df = read_files(spark, CsvLanding(HINTS, work), [f"file:{path}" for path in files])
    assert rows(df, "id", "c1") == [(0, None), (1, "x"), (2, None)]


@pytest.mark.parametrize(
    ("text", "age"), [("14 days", "14d"), ("14d", "14d"), ("1 week", "7d"), ("2 hours", "2h")]
)
def test_file_age(text, age):
    assert file_age(text) == age


def test_file_age_rejects_nonsense():
    with pytest.raises(ValueError, match="not a file age"):
        file_age("soon")


@pytest.fixture
def target(spark, work):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{work}/{name}'")
    return f"{name}.landed"


def test_files_are_landed_once_and_new_columns_added(spark, work, target):
    folder = f"{work}/in"
    files = CsvLanding(HINTS, folder, sort_columns=["id", "note"], files_per_batch=1)
    put(folder, "a.csv", "id,amount,note\n1,1.5,n\n")
    put(folder, "a.txt", "id,amount\n9,9.5\n")
    landing.create_landing_table(spark, target, files).awaitTermination()
    put(folder, "b.csv", "id,more,amount,note\n2,m,2.5,z\n")
    put(folder, "sub_c.csv", "id,amount,note\n3,3.5,y\n")
    landing.create_landing_table(spark, target, files).awaitTermination()
    table = targets.read_table(spark, target)
    assert rows(table, "id", "amount", "note", "more") == [
        (1, 1.5, "n", None), (2, 2.5, "z", "m"), (3, 3.5, "y", None),
    ]
    assert rows(table, "sort_struct.id", "sort_struct.note") == [(1, "n"), (2, "z"), (3, "y")]
    assert table.filter("insert_ts IS NULL OR part_col <> CAST(insert_ts AS DATE)").count() == 0
    assert table.filter("file_nm LIKE '%.csv'").count() == 3


def test_sequence_defaults_to_the_load_date(spark, work, target):
    put(f"{work}/in", "a.csv", "id,amount\n1,1.5\n")
    files = CsvLanding(HINTS, f"{work}/in")
    landing.create_landing_table(spark, target, files).awaitTermination()
    assert dict(targets.read_table(spark, target).dtypes)["sort_struct"] == "date"
    assert targets.read_table(spark, target).filter("sort_struct = part_col").count() == 1


def test_without_header_columns_are_positional(spark, work, target):
    put(f"{work}/in", "a.csv", "1,1.5\n2,2.5\n")
    files = CsvLanding(HINTS, f"{work}/in", header=False)
    landing.create_landing_table(spark, target, files).awaitTermination()
    assert rows(targets.read_table(spark, target), "id", "amount") == [(1, 1.5), (2, 2.5)]


def test_discovery_reads_no_file_contents(spark, work):
    put(f"{work}/in", "a.csv", "id\n1\n")
    seen = []
    query = (
        landing.discover_files(spark, CsvLanding(HINTS, f"{work}/in"))
        .writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect()))
        .option("checkpointLocation", f"{work}/cp")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString()
    assert len(seen) == 1 and "ReadSchema: struct<path:string,length:bigint>" in plan
