"""Clusters with adaptive bounds against plain integer k-means and against DuckDB."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from corrgrid.llm.centroids import Bounds, clusters, clusters_sql, distances
from corrgrid.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plain(rows, k, rounds, dim, factor=256):
    """rows: (id, components). Lloyd's rounds in Python integers."""
    v = [[int(factor * x // 1) for x in e] for _, e in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "g", rows[i][0] or 0, v[i]))
    c = [v[i] for i in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda: [min(range(len(c)), key=lambda j: (d(x, c[j]), j)) for x in v]
    for _ in range(rounds):
        at = nearest()
        for j in range(len(c)):
            if own := [v[i] for i in range(len(v)) if at[i] == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    at = nearest()
    dist = [d(v[i], c[at[i]]) for i in range(len(v))]
    return sorted(
        (rows[i][0] if rows[i][0] is not None else -1, at[i], dist[i], sum(dist[j] for j in range(len(v)) if at[j] == at[i]), sum(dist), hashlib.sha256(",".join(map(str, c[at[i]])).encode()).hexdigest())
        for i in range(len(v))
    )


def shown(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("spread, k, rounds", [(3.0, 12, 6), (0.02, 9, 5), (40000.0, 3, 4), (1.0, 1, 2), (1.0, 2, 3)])
def test_plain_rounds(spark, spread, k, rounds):
    rng = random.Random(k)
    centres = [[rng.gauss(0, spread) for _ in range(5)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, spread / 4) for x in rng.choice(centres)]) for i in range(400)]
    rows += [rows[0], (None, [0.0] * 5), (None, [spread] * 5)]
    history = []
    got = clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=5, k=k, rounds=rounds, history=history)
    assert shown(got) == plain(rows, k, rounds, 5)
    assert history[0]["scans"] == k * len(rows) and len(history) == rounds + 1
    if k >= 9:  # the bounds spare most distances
        assert sum(h["scans"] for h in history[1:]) < 0.5 * rounds * k * len(rows)


def test_bounds_stay_below_distances():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-500, 500, (300, 4)), rng.integers(-500, 500, (20, 4))
    s = Bounds(v, 5)
    s.scan(np.arange(300), c)
    for turn in range(8):
        new = c + rng.integers(-30, 30, c.shape)
        s.keep(5 - turn // 3)
        s.move(new, np.sqrt(((new - c) ** 2).sum(axis=1)))
        c, d = new, np.sqrt(distances(v, new))
        assert (s.cluster == distances(v, c).argmin(axis=1)).all()
        assert (s.low <= np.take_along_axis(d, s.near, 1) + 1e-6).all() and (s.upper >= d[np.arange(300), s.cluster] - 1e-6).all()
        other = d.copy()
        np.put_along_axis(other, np.column_stack([s.cluster, s.near]), np.inf, 1)
        assert (s.rest <= other.min(axis=1) + 1e-6).all()


def test_query_against_duckdb(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    got = QUERIES["op12_clusters_drake"](spark, DIR)
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(clusters_sql()).fetchall())


def test_corners(spark):
    ok = [[float(i), 1.0] for i in range(5)]
    rows = [(1, ok[0]), (1, ok[0]), (2, ok[1]), (None, ok[2]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.selectExpr("*", "7 AS v", "7 AS cluster", "7 AS was", "7 AS upper", "7 AS near", "7 AS low", "7 AS rest", "7 AS distance", "7 AS inertia", "7 AS label")
    kept = [(i, e) for i, e in rows[:4]]
    assert shown(clusters(df, dim=2)) == shown(clusters(clash, dim=2)) == plain(kept, 40, 5, 2)
    assert clusters(df.where("false"), dim=2).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dim=2)
