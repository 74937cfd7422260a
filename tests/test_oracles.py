"""Every query with SQL gives the same rows in DuckDB; the others run."""

import math
import os

import duckdb
import pytest

from heliograph.plans import registry

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = [tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(_plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
