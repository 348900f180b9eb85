"""Every core query with SQL gives the same rows on a second engine."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import core, extra, more

SQL = core.ORACLE | more.ORACLE | extra.ORACLE
QUERIES = core.QUERIES | more.QUERIES | extra.QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
