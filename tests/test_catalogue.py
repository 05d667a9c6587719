"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scriptorium import catalogue

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else int(x) if x == int(x) else round(x, 6)
    return int(x) if isinstance(x, np.integer) else x


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(str(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, tables, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), tables.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
