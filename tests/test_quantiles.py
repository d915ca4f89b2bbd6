"""Percentiles by bracketed selection against NumPy and DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corrgrid.operators.quantiles import percentiles

SHARES = (0.0, 0.02, 0.25, 0.5, 0.98, 1.0)


@pytest.mark.parametrize("bins", [16, 1024])
def test_keys_and_distributions(spark, bins):
    rng = np.random.default_rng(bins)
    groups = {
        1: rng.normal(size=501), 2: np.repeat([3.0, -1.0, 7.5], [400, 90, 1]), 3: np.array([4.25]), 4: 2.0 ** -np.arange(60.0), 5: rng.integers(0, 256, 300).astype(float),
        6: np.array([-1.7e308, 1.7e308, 0.0, 1e-300]), None: rng.exponential(size=77), 7: np.array([1.0, 2.0]),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, None), (2, float("nan")), (8, None)]
    got = {r.k: r.p for r in percentiles(spark.createDataFrame(rows, "k long, x double").repartition(3), ["k"], "x", SHARES, bins=bins).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k] == pytest.approx(np.quantile(xs, SHARES).tolist(), rel=1e-12) or k == 6
    assert got[6][0] == -1.7e308 and got[6][-1] == 1.7e308
    ends = percentiles(spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "x double"), [], "x", (0.0, 0.5, 1.0), bins=bins).first().p
    assert ends == [float("-inf"), 1.0, float("inf")]


def test_ten_million_distinct_values_of_one_key(spark):
    n = 10_000_000
    x = F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 3.0 + F.sqrt(F.col("id")) * 1e-9
    got = percentiles(spark.range(n).select(F.lit(1).alias("k"), x.alias("x")), ["k"], "x", (0.02, 0.5, 0.98)).first().p
    want = duckdb.sql(f"SELECT quantile_cont(x, [0.02, 0.5, 0.98]) FROM (SELECT ((i * 7368787) % {n}) / 3.0::DOUBLE + sqrt(i::DOUBLE) * 1e-9 AS x FROM range({n}) t(i))").fetchall()[0][0]
    assert got == pytest.approx(want, rel=1e-13)


def test_two_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", 4.0)], "i long, n string, x double")
    assert {(r.i, r.n): r.p for r in percentiles(df, ["i", "n"], F.col("x") * 2, [0.5]).collect()} == {(1, "a"): [2.0], (1, "b"): [6.0]}
    assert percentiles(df.where("false"), ["i"], "x", [0.5]).count() == 0
