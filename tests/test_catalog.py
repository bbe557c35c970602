"""Every query with SQL equals DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from strandline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    return round(float(x), 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=repr)
    place = [expected.columns.index(c) for c in columns]
    other = sorted([tuple(plain(r[k]) for k in place) for r in expected.fetchall()], key=repr)
    assert len(rows) == len(other) and len(rows) > 0
    assert rows == other


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs_alike_twice(spark, sf, name):
    rows = [sorted(map(repr, catalog.QUERIES[name](spark, sf).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]
