"""Every registered query runs on the smallest tables; those with SQL give what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

#: Queries outside the subpackage for training data, whose tests stand beside it.
NAMES = [n for m in entry._parts() if not m.__name__.startswith("quarry.llm") for n in m.QUERIES]


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.5f}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    got = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        for df in (got, want):
            for c in df.columns:
                if c in want and (pd.api.types.is_float_dtype(want[c]) or pd.api.types.is_float_dtype(got[c])):
                    df[c] = df[c].astype(float)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
