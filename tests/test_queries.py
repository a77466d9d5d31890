"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") or not k[2:3].isdigit()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(DIR)):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return connection


def same(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    found = sorted(tuple(map(same, r)) for r in got.select(*columns).collect())
    order = [want.columns.index(c) for c in columns]
    assert found == sorted(tuple(same(r[i]) for i in order) for r in want.fetchall())
