"""Each core query against its SQL, and the entry's contract."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__
from vakya.plans import queries as core

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(core.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
