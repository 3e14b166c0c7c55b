"""Every reference query with an SQL twin gives the twin's rows."""

import glob
import math
import os

import duckdb
import pytest

from rillmark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got, twin = df.collect(), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    columns = sorted(df.columns)
    at = [twin.columns.index(c) for c in columns]
    assert sorted("|".join(norm(r[c]) for c in columns) for r in got) == sorted("|".join(norm(r[k]) for k in at) for r in twin.fetchall())
    assert got
