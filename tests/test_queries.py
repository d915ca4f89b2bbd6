"""Every registered reference query against its SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corrgrid.plans import REFERENCE as QUERIES
from corrgrid.plans import REFERENCE_SQL as ORACLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda x: "null" if pd.isna(x) else (f"{float(x):.4f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x))
    return sorted(tuple(show(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_point_runs_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
