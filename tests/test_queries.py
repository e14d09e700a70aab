"""Each registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def rows(cursor_rows):
    return sorted(repr(tuple(r)) for r in cursor_rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert rows(got.select(columns).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
