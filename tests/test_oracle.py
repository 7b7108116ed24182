"""Every registered query against its SQL on DuckDB."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as contract  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = [p.stem for p in Path(SF_DIR).glob("*.parquet")]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "asDict"):
        return tuple(sorted((k, repr(comparable(v))) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, repr(comparable(v))) for k, v in value.items()))
    if isinstance(value, list):
        return tuple(comparable(v) for v in value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(comparable(row[i]) for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    rows = result.collect()
    sql = contract.oracle_sql().get(name)
    assert rows, name
    if sql is None:
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    expected = sorted_rows(columns, cursor.fetchall())
    assert len(rows) == len(expected)
    assert sorted_rows(result.columns, rows) == expected


def test_entry_is_the_flagship(spark):
    assert contract.entry(spark).count() > 0
