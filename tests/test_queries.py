"""Every named query against its SQL in DuckDB, on the smallest data."""

import math
import os

import duckdb
import pytest

from weirflow.plans import catalog, detector, streams  # noqa: F401  they register their queries
from weirflow.plans.oracle import SQL
from weirflow.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"

def said(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}{'/*.parquet' if os.path.isdir(f'{DATA}/{name}') else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df, sql = QUERIES[name](spark, DATA), db.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    ours = sorted(tuple(said(r[c]) for c in sorted(df.columns)) for r in df.collect())
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert ours == sorted(tuple(said(r[k]) for k in at) for r in sql.fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
