"""Reports without a median do not select one; percentiles compute their values once."""

import pytest

from corrgrid.operators import points, quantiles
from corrgrid.plans import REFERENCE


@pytest.mark.parametrize("name", ["ground_control", "metric_rows", "text_summary"])
def test_no_median_without_need(spark, monkeypatch, name):
    monkeypatch.setattr(points, "percentiles", lambda *args, **more: pytest.fail("a median that nobody reads"))
    assert "pair_id" in REFERENCE[name](spark, "/root/testdata/sf0.001").columns


def test_values_are_written_once_and_unfiltered(spark, monkeypatch):
    made, keep = [], quantiles.staged
    monkeypatch.setattr(quantiles, "staged", lambda df: made.append(df.columns) or keep(df))
    assert quantiles.percentiles(spark.createDataFrame([(1, 2.0), (1, None)], "k long, x double"), ["k"], "x", [0.5]).first().p == [2.0]
    assert made[0] == ["_k0", "_v"] and made.count(["_k0", "_v"]) == 1
