"""Every registered query against its SQL in DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from veritide import registry

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(cols).collect()]
    if name not in registry.ORACLES:
        assert got
        return
    names = ", ".join(f'"{c}"' for c in cols)
    want = [tuple(plain(v) for v in r) for r in con.execute(f"select {names} from ({registry.ORACLES[name]})").fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
