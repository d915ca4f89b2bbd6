"""Prior homographies, common frames and interpolated histogram matching against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrgrid.operators import frames, raster

CORNERS = "image_id long, corner string, x long, y long, lon double, lat double"
REFERENCE = "image_id long, gsd_lon double, gsd_lat double, lon0 double, lat0 double"


def quad(image, w, h, places):
    return [(image, c, x, y, *p) for c, (x, y), p in zip(("UL", "UR", "LR", "LL"), ((0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)), places)]


def test_corners_map_exactly(spark):
    places = [(10.02, 1.0), (10.11, 1.01), (10.1, 0.9), (10.0, 0.91)]
    rows = quad(1, 700, 500, places) + quad(2, 9, 9, [(10.0, 1.0)] * 4) + quad(3, 10, 10, places)[:3]
    ref = spark.createDataFrame([(i, 1e-4, 2e-4, 9.9, 1.1) for i in (1, 2, 3)], REFERENCE)
    got = {r.image_id: r.prior for r in frames.prior_homography(spark.createDataFrame(rows, CORNERS), ref).collect()}
    h = np.array(got[1]).reshape(3, 3)
    for _, _, x, y, lon, lat in quad(1, 700, 500, places):
        p = h @ [x, y, 1]
        assert p[:2] / p[2] == pytest.approx([(lon - 9.9) / 1e-4, (1.1 - lat) / 2e-4], abs=1e-6)
    assert got[2] is None and got[3] is None


def test_common_frame(spark):
    h = [1.1, 0.02, 5.0, -0.03, 0.9, 7.0, 1e-5, -2e-5, 1.0]
    rows = [(1, 5.0, 0.25, h), (2, 0.5, 2.0, h), (3, 1.0, 2.0, None), (4, None, 2.0, h)]
    got = {r.i: r for r in frames.harmonise(spark.createDataFrame(rows, "i long, reference_gsd double, source_gsd double, prior array<double>")).collect()}
    assert (got[1].scale_ratio, got[1].matching_gsd, got[1].source_factor, got[1].reference_factor) == (20.0, 5.0, 20.0, 1.0)
    d = lambda f: np.array([[1 / f, 0, (1 / f - 1) / 2], [0, 1 / f, (1 / f - 1) / 2], [0, 0, 1]])
    for i, fs, fr in ((1, 20.0, 1.0), (2, 1.0, 4.0)):
        want = d(fr) @ np.array(h).reshape(3, 3) @ np.linalg.inv(d(fs))
        assert got[i].h0 == pytest.approx((want / want[2, 2]).ravel().tolist(), rel=1e-9) and got[i].prior_used == "corners"
    assert got[3].h0 == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0] and got[3].prior_used == "scale" and got[4].h0 is None and got[4].matching_gsd is None


@pytest.mark.parametrize("most", [3, 256, 65536])
def test_histogram_match_interpolates(spark, most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(0, most, 4000), (rng.normal(0.5, 0.1, 4000).clip(0, 1) * (most - 1)).astype(int)
    px = spark.createDataFrame([(0, i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))] + [(1, 0, 5, None)], "image_id long, i long, a int, b int")
    got = {r.level: r.mapped for r in raster.match_histogram(px, "a", "b").where("image_id = 0").collect()}
    levels, n = np.unique(a, return_counts=True)
    targets, m = np.unique(b, return_counts=True)
    want = np.interp(np.cumsum(n) / n.sum(), np.cumsum(m) / m.sum(), targets)
    assert list(got) and [got[x] for x in levels.tolist()] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9)
    assert raster.match_histogram(px, "a", "b").where(F.col("image_id") == 1).count() == 0
