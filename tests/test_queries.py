"""Every registered query with SQL gives the same rows as DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    data = got.collect()
    assert data
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert rows(got.columns, data) == rows(columns, want.fetchall())
