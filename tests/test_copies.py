"""Tables in which every case comes several times, with keys of its own."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from dossier.operators import joins as J

from test_queries import DIR, same

SHIFTS = {
    "orders": {"o_orderkey": 16800, "o_custkey": 1500}, "lineitem": {"l_orderkey": 16800, "l_partkey": 2000}, "customer": {"c_custkey": 1500},
    "part": {"p_partkey": 2000}, "events": {"event_id": 16800},
}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    folder, duck = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for name in sorted(os.listdir(DIR)):
        table = name.removesuffix(".parquet")
        if table in SHIFTS:
            shifted = ", ".join(f"{c} + {by} * i as {c}" for c, by in SHIFTS[table].items())
            duck.execute(f"copy (select t.* replace ({shifted}) from range(3) r(i), '{DIR}/{name}' t) to '{folder}/{name}' (format parquet)")
        else:
            shutil.copyfile(f"{DIR}/{name}", folder / name)
        duck.execute(f"create view {table} as select * from '{folder}/{name}'")
    return str(folder), duck


@pytest.mark.parametrize("name", ["batch_summary", "upsert_cases"])
def test_query_of_copies_equals_sql(spark, copies, name):
    folder, duck = copies
    got, want = entry.queries()[name](spark, folder), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(same, r)) for r in got.select(*columns).collect()) == sorted(tuple(same(r[i]) for i in order) for r in want.fetchall())


def test_pairs_of_a_date_are_dealt_out_in_blocks(spark):
    files = spark.range(50).selectExpr("id as file_id", "if(id = 49, null, date_add(date'2024-01-01', cast(id % 2 as int))) as file_date")
    cases = spark.range(31).selectExpr("id as case_id", "if(id = 30, null, date'2024-01-01') as start_date")
    found = J.date_pairs(files, cases, 5)
    assert sorted(map(tuple, found.collect())) == [(f, c) for f in range(0, 50, 2) for c in range(30)]
    assert found.rdd.getNumPartitions() >= 30
    assert J.date_pairs(files, cases.where("case_id = 30"), 5).isEmpty()
