"""Every catalog query against the same question asked in SQL."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from stallkeeper.plans import registry

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def form(value):
    if isinstance(value, float | Decimal):
        return None if math.isnan(value) else round(float(value), 6)
    return list(value) if isinstance(value, list | tuple) else value


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, oracle, name):
    got = QUERIES[name](spark, TABLES)
    asked = oracle.execute(SQL[name])
    columns = [c[0] for c in asked.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = [tuple(form(row[columns.index(c)]) for c in order) for row in asked.fetchall()]
    rows = [tuple(form(r[c]) for c in order) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
