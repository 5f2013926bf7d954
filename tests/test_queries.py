"""Every query of the log engine against its SQL in DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from loglake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(rows, order):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.10g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = plain([tuple(r) for r in got.collect()], [got.columns.index(c) for c in columns])
    b = plain(want.fetchall(), [want.columns.index(c) for c in columns])
    assert a == b


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
