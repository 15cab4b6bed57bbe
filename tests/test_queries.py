"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as driver
from contactloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
        return f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def rows(df):
    if len(df) > 100_000:  # numbers and names only
        df = df[sorted(df.columns)]
        df = df.astype({c: float for c in df.columns if df[c].dtype.kind in "iuf"})
        return df.sort_values(list(df.columns)).to_numpy().tolist()
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = driver.queries()[name](spark, str(DATA)).toPandas()
    want = duck.sql(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.sql())))
def test_others_give_rows(spark, name):
    assert driver.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
