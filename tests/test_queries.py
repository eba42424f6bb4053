"""Every registered core query against its SQL, in another engine."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracewright.plans import cases, problems, scalars
from tracewright.plans import queries as core

MODULES = (problems, core, cases, scalars)
CASES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, (list, np.ndarray)):
        return str([plain(y) for y in x])
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def shaped(df):
    df = df[sorted(df.columns)].map(plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(CASES))
def test_query(spark, data, duck, name):
    got = CASES[name](spark, data).toPandas()
    assert len(got.columns)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        pd.testing.assert_frame_equal(shaped(got), shaped(want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "period", "reason", "orphans"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
