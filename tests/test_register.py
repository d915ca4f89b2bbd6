"""Registration of pairs in one call."""

import numpy as np
import pytest

from corrgrid.operators.knn import two_nearest, two_nearest_by_pair
from corrgrid.operators.register import match_pairs, register_pairs

FEATURES = "image_id long, kp_id long, x double, y double, v array<double>"
H = np.array([[0.9, -0.1, 12.0], [0.12, 1.05, -8.0], [1e-5, -2e-5, 1.0]])


def images(noise=0.02, outliers=60):
    rng = np.random.default_rng(5)
    v, xy = rng.normal(size=(260, 16)), rng.uniform(0, 400, (260, 2))
    p = np.column_stack([xy, np.ones(260)]) @ H.T
    uv = p[:, :2] / p[:, 2:]
    uv[:outliers] = rng.uniform(0, 400, (outliers, 2))
    w = v + rng.normal(0, noise, v.shape)
    rows = [(1, i, *map(float, xy[i]), v[i].tolist()) for i in range(260)] + [(2, 1000 + i, *map(float, uv[i]), w[i].tolist()) for i in range(260)]
    return rows + [(3, i, 1.0 * i, 2.0 * i, rng.normal(size=16).tolist()) for i in range(50)] + [(4, 0, 1.0, 1.0, v[0].tolist()), (5, 0, None, 1.0, None)]


def test_a_row_per_pair(spark):
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 1, 4), (13, 1, 77), (14, 2, 1), (15, 5, 1)], "pair_id long, source_id long, reference_id long")
    f = spark.createDataFrame(images(), FEATURES).repartition(3)
    got = {r.pair_id: r for r in register_pairs(pairs, f, ratio=0.5, canvas=(400.0, 400.0)).collect()}
    assert {k: r.status for k, r in got.items()} == {10: "success", 11: "insufficient_matches", 12: "insufficient_matches", 13: "no_features", 14: "success", 15: "no_features"}
    r = got[10]
    assert r.n_matches == 260 and abs(r.inliers - 200) <= 2 and np.array(r.h) == pytest.approx(H.ravel(), abs=1e-4) and r.inlier_ratio == r.inliers / 260
    assert np.array(got[14].h).reshape(3, 3) @ H / (np.array(got[14].h).reshape(3, 3) @ H)[2, 2] == pytest.approx(np.eye(3), abs=1e-2) and got[11].h is None
    only = register_pairs(pairs, f, weights={"inlier_ratio": 2.0}).where("pair_id = 10").first()
    assert only.quality == pytest.approx(100 * only.inlier_ratio)
    with pytest.raises(ValueError):
        register_pairs(pairs, f, weights={"colour": 1.0})
    assert match_pairs(pairs, f, both_ways=True).where("pair_id = 10").count() == 260


def test_neighbours_within_pairs_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    side = lambda n, k: [(int(p), i, rng.integers(-3, 4, k).astype(float).tolist()) for i, p in enumerate(rng.integers(0, 3, n))]
    schema = "pair_id long, id long, v array<double>"
    a, b = side(200, 5), side(300, 5)
    want = set()
    for p, i, v in a:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for q, j, w in b if q == p)
        want.add((p, i, d[0][1], d[0][0], d[1][0]))
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert {tuple(r) for r in two_nearest_by_pair(left, right, block=17).collect()} == {tuple(r) for r in two_nearest_by_pair(left, right).collect()} == want
    whole = {tuple(r) for r in two_nearest(left.where("pair_id = 1"), right.where("pair_id = 1"), 9).collect()}
    assert whole == {r[1:] for r in want if r[0] == 1}
