"""Every query with SQL equals DuckDB on the same tables; those without run."""

import math
import os

import duckdb
import pytest

from vellumark.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    out = duck.execute(ORACLE[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in out.fetchall()), key=str)
    assert got == want


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)
