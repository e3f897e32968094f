"""Registered queries against DuckDB on the smallest data set."""

import datetime as dt
import os

import duckdb
import pytest

from marginalia.plans.registry import QUERIES
from marginalia.sources.corpora import TABLES
from oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def plain(rows, order):
    def value(v):
        return v.isoformat() if isinstance(v, dt.datetime) else repr(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    got = plain([tuple(r) for r in df.select(*columns).collect()], range(len(columns)))
    assert got == plain(want.fetchall(), [want.columns.index(c) for c in columns])
