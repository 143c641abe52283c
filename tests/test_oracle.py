"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from maskwright import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_oracle(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(plain(ours), plain(theirs), check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
