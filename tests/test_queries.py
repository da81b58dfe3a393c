"""Every registered domain query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tenantry.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=repr)
    a = order(tuple(r[c] for c in columns) for r in got.collect())
    b = order(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
    assert a == b
