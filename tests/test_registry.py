"""Every registered query against its SQL on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from codeloom.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(cols) == len(set(cols))
        return
    res = duck.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(dict(zip(names, r))[c]) for c in cols)) for r in res.fetchall())
    assert got == want
