import pytest

from lakeops.functions.tables import cluster_columns, format_cluster_columns, table_properties
from lakeops.functions.text import name_list
from lakeops.operators import control
from lakeops.plans import ingest
from lakeops.sources.control import IngestionConfig, read_name_list
from lakeops.streaming import flows

ROWS = [
    ("A", "A_INC", "S1", "N"),
    ("B", None, "S1", "N"),
    ("C", "C_INC", "S2", "N"),
    ("D", "D_INC", "S1", "Y"),
    ("E", "E_INC", "S1", None),
]
COLUMNS = "table_name STRING, inc_table_name STRING, source_system STRING, skip_table STRING"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def names(df, column="table_name"):
    return [row[column] for row in df.orderBy("table_name").collect()]


def test_null_flag_is_excluded(rows):
    assert names(control.select_rows(rows)) == ["A", "B", "C"]
    assert names(control.select_rows(rows, skip_table="Y")) == ["D"]


@pytest.mark.parametrize("source", [None, ""])
def test_empty_source_means_no_filter(rows, source):
    assert names(control.select_rows(rows, source)) == ["A", "B", "C"]


def test_source_and_table_filters(spark, rows):
    assert names(control.select_rows(rows, "S1", ["A", "C"])) == ["A"]
    assert names(control.select_rows(rows, "S1", [])) == ["A", "B"]
    wanted = spark.createDataFrame([("B",), ("B",)], "table_name STRING")
    assert names(control.select_rows(rows, None, wanted)) == ["B"]


def test_incremental_name_falls_back_only_when_the_column_is_absent(rows):
    kept = control.with_incremental_names(rows)
    assert names(kept, "inc_table_name")[1] is None
    filled = control.with_incremental_names(rows, null_fallback=True)
    assert names(filled, "inc_table_name")[1] == "B"
    absent = control.with_incremental_names(rows.drop("inc_table_name"))
    assert names(absent, "inc_table_name") == ["A", "B", "C", "D", "E"]


def test_table_list_marks_incremental_names(rows):
    listed = control.table_list(rows.drop("inc_table_name"), "S1").collect()
    assert {(r.table_name, r.inc_table_name, r.is_incremental) for r in listed} == {
        ("A", "A", False),
        ("B", "B", False),
    }


def test_environment_filter():
    tables = {"dev": ["A"], "PRD": ("B", "C")}
    assert control.environment_filter("DEV", tables) == ["A"]
    assert control.environment_filter("prd", tables) == ["B", "C"]
    assert control.environment_filter("test", tables) is None
    assert control.environment_filter("dev", tables, ["X"]) == ["X"]


def test_source_name_comes_from_the_session(spark, rows):
    rows.createOrReplaceTempView("control_conf")
    assert IngestionConfig(spark, schema_name="s", config_table="control_conf").source_name is None
    spark.conf.set("source_name", "S2")
    try:
        config = IngestionConfig(spark, schema_name="s", config_table="control_conf")
        assert names(config.rows()) == ["C"]
        assert IngestionConfig(spark, "S1", schema_name="s", config_table="control_conf").source_name == "S1"
    finally:
        spark.conf.unset("source_name")


def test_name_list_is_not_trimmed_unless_asked(spark):
    df = spark.createDataFrame([("a, b,,c",)], "v STRING")
    assert [r[0] for r in df.select(name_list(df.v)).collect()] == ["a", " b", "", "c"]
    assert [r[0] for r in df.select(name_list(df.v, trim=True)).collect()] == ["a", "b", "c"]


def test_name_list_file_with_byte_order_mark(spark, work):
    with open(f"{work}/names.csv", "wb") as out:
        out.write(b"\xef\xbb\xbftable_name\nfirst_half\nsecond_half\n")
    assert names(read_name_list(spark, f"{work}/names.csv")) == ["first_half", "second_half"]


def test_cluster_columns_and_properties():
    assert cluster_columns(None) == [] and cluster_columns("a") == ["a"]
    assert cluster_columns(None, ["part_col"]) == ["part_col"]
    assert format_cluster_columns(["c1", "c2"]) == "c1,c2" and format_cluster_columns(None) == ""
    built = table_properties("bronze", ["a", "b"], {"quality": "gold", "x": "y"})
    assert built == {
        "quality": "gold",
        "delta.enableDeletionVectors": "true",
        "delta.dataSkippingStatsColumns": "a,b",
        "x": "y",
    }
    assert "delta.dataSkippingStatsColumns" not in table_properties("silver", None)


def test_flow_names_must_be_unique(spark):
    with pytest.raises(ValueError, match="registered twice: A"):
        flows.distinct_names(["A", "B", "A"])


def test_faulty_names_do_not_stop_a_run(spark):
    rows = [("A", "X", "S", "N"), ("B", "X", "S", "N"), ("C", None, "S", "N"), ("D", None, "S", "N")]
    spark.createDataFrame(rows, COLUMNS).createOrReplaceTempView("control_faulty")
    config = IngestionConfig(spark, schema_name="no_schema", config_table="control_faulty")
    done = ingest.await_flows(spark, ingest.run_configured_tables(config, "t")).collect()
    assert [r.error for r in done] == [
        *["t.X is registered 2 times"] * 2, *["the control table gives no name"] * 2,
    ]
    missing = ingest.run_configured_tables(config, "t", null_fallback=True, table_filter=["C"])
    assert "not be found" in ingest.await_flows(spark, missing).first().error


def test_the_next_flow_starts_when_any_has_ended(monkeypatch):
    class Query:
        def __init__(self, looks):
            self.looks = looks

        @property
        def isActive(self):
            self.looks -= 1
            return self.looks > 0

    monkeypatch.setattr(ingest, "ACTIVE_FLOWS", 2)
    monkeypatch.setattr(ingest, "POLL_SECONDS", 0)
    planned = [ingest.Flow("bronze", str(i), str(i)) for i in range(5)]

    def start(flow):
        if flow.source == "3":
            raise ValueError("bad")
        return Query(10**9 if flow.source == "0" else 3)

    started = ingest._start_all(planned, start, flows.AVAILABLE_NOW)
    assert [f.error for f in started] == [None, None, None, "bad", None]


def test_environment_run_selects_its_tables(spark):
    spark.createDataFrame([("OTHER", "X", "S", "N")], COLUMNS).createOrReplaceTempView("control_env")
    config = {"schema_name": "s", "config_table": "control_env"}
    assert ingest.run_environment(spark, "DEV", "t", {"DEV": ["ITEM"]}, **config) == []
    started = ingest.run_environment(spark, "DEV", "t", {"DEV": ["OTHER"]}, **config)
    assert [(f.layer, f.source, f.target) for f in started] == [("bronze", "X", "t.X")]
    assert started[0].error
