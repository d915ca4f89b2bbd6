"""Neighbourhood operators on tiles against plain NumPy on whole images."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corrgrid.operators import tiles as T
from corrgrid.sources.derived import large_tiles


def table(spark, a, tile, image=3, drop=()):
    rows = [(image, ty, tx, *a.shape, *(b := a[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]).shape, bytearray(T.packed(b))) for ty in range(-(-a.shape[0] // tile)) for tx in range(-(-a.shape[1] // tile)) if (ty, tx) not in drop]
    return spark.createDataFrame(rows, T.HEAD + ", data binary").repartition(3)


def whole(df, plane="data", tile=T.TILE):
    out = None
    for r in df.collect():
        if out is None:
            out = np.full((r.height, r.width), np.inf)
        out[r.ty * tile : r.ty * tile + r.rows, r.tx * tile : r.tx * tile + r.cols] = np.frombuffer(r[plane], "<f4").reshape(r.rows, r.cols)
    return out


def image(shape, holes=0.0, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, shape).astype(float)
    a[rng.random(shape) < holes] = np.nan
    return a


def correlate(a, kernel):
    k = kernel.shape[0] // 2
    p = np.pad(a, k, mode="reflect")
    return sum(kernel[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * k + 1) for j in range(2 * k + 1))


def disc(k):
    r = k // 2
    half = [int(np.rint(r * np.sqrt(max(0, (r * r - d * d)) / (r * r)))) for d in range(-r, r + 1)]
    return np.array([[abs(x) <= w for x in range(-r, r + 1)] for w in half])


def slowly(a, mask, pick):
    r = mask.shape[0] // 2
    p = np.pad(a, r, constant_values=np.nan)
    out = np.full(a.shape, np.nan)
    for i, j in np.argwhere(mask):
        out = pick(out, p[i : i + a.shape[0], j : j + a.shape[1]])
    out[np.isnan(a)] = np.nan
    return out


@pytest.mark.parametrize("side", [512, 1024, 2048])
def test_sobel_on_large_images(spark, side):
    a = image((side, side - 56), 0.001, side)
    got = T.sobel(table(spark, a, T.TILE))
    x = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    assert np.array_equal(whole(got, "gx"), correlate(a, x), equal_nan=True) and np.array_equal(whole(got, "gy"), correlate(a, x.T), equal_nan=True)


@pytest.mark.parametrize("k, tile, shape", [(3, 16, (40, 33)), (5, 16, (40, 33)), (5, 2, (7, 9)), (5, 64, (3, 5))])
def test_gradients_with_reflected_borders(spark, k, tile, shape):
    a = image(shape)
    s, d = T.GRADIENT[k]
    got = T.sobel(table(spark, a, tile), k, tile=tile)
    assert np.array_equal(whole(got, "gx", tile), correlate(a, np.outer(s, d))) and np.array_equal(whole(got, "gy", tile), correlate(a, np.outer(d, s)))
    taps = [0.25, 0.5, 0.25]
    assert np.allclose(whole(T.smooth(table(spark, a, tile), taps, tile=tile), tile=tile), correlate(a, np.outer(taps, taps)), rtol=1e-6)


@pytest.mark.parametrize("k, tile", [(3, 16), (7, 16), (31, 16), (51, 32), (51, 256)])
def test_ellipses(spark, k, tile):
    a, mask = image((100, 90), 0.1, k), disc(k)
    t = table(spark, a, tile)
    least, most = slowly(a, mask, np.fmin), slowly(a, mask, np.fmax)
    same = lambda df, want: np.array_equal(whole(df, tile=tile), want, equal_nan=True)
    assert same(T.erode(t, k, tile=tile), least) and same(T.dilate(t, k, tile=tile), most)
    opened = slowly(least, mask, np.fmax)
    assert same(T.opening(t, k, tile=tile), opened) and same(T.closing(t, k, tile=tile), slowly(most, mask, np.fmin))
    assert same(T.illumination_bias(t, k, tile=tile), np.clip(a - opened + 128, 0, 255))


def test_opening_of_a_large_image(spark):
    a = image((1024, 1024), 0.05, 5)
    mask = disc(31)
    assert np.array_equal(whole(T.opening(table(spark, a, T.TILE), 31)), slowly(slowly(a, mask, np.fmin), mask, np.fmax), equal_nan=True)


def test_cost_of_an_ellipse_is_linear_in_its_height():
    calls = []
    for k in (25, 51, 101):
        n = [0]

        def pick(x, y, n=n):
            n[0] += 1
            return np.fmin(x, y)

        T.extreme(np.zeros((8, 8)), T.chords(k), pick)
        calls.append(n[0] / k)
    assert max(calls) < 2


def test_square_shapes_repeats_and_absent_tiles(spark):
    a = image((40, 40), 0, 9)
    mask = np.ones((3, 3), bool)
    twice = slowly(slowly(a, mask, np.fmax), mask, np.fmax)
    assert np.array_equal(whole(T.dilate(table(spark, a, 16), 3, shape="square", times=2, tile=16), tile=16), twice)
    got = whole(T.erode(table(spark, a, 16, drop={(1, 1)}), 3, tile=16), tile=16)
    assert (got[16:32, 16:32] == np.inf).all()
    b = a.copy()
    b[16:32, 16:32] = np.nan
    rest = ~np.isnan(b)
    assert np.array_equal(got[rest], slowly(b, disc(3), np.fmin)[rest])
    with pytest.raises(ValueError):
        T.erode(table(spark, a, 16), 4)
    assert T.sobel(table(spark, a, 16).where("false"), tile=16).count() == 0


def test_pixels_and_back(spark):
    a = image((37, 50), 0.2, 2)
    px = [(1, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(37) for c in range(50) if (r + c) % 11] + [(1, 99, 0, 5.0), (1, -1, 0, 5.0)]
    t = T.from_pixels(spark.createDataFrame(px, "image_id long, row long, col long, v double"), "v", 37, 50, tile=16)
    back = {(r.row, r.col): r.data for r in T.to_pixels(t, tile=16).collect()}
    assert len(back) == a.size and all(back[r, c] == (None if np.isnan(a[r, c]) or not (r + c) % 11 else a[r, c]) for r in range(37) for c in range(50))


def test_tasks_take_one_tile_at_a_time(spark, monkeypatch):
    """Python memory of a task over a batch of 100 tiles: that of a few, not of all."""
    found = []
    t = table(spark, image((64, 64)), 64)
    monkeypatch.setattr(type(t), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    T.to_pixels(t)
    T.neighbourhood(t, 1, lambda a, halo: (a,))
    large_tiles(spark, "/root/testdata/sf0.001")
    n, const = 100, lambda v: pa.array(np.full(100, v, np.int32))
    head = {"image_id": pa.array(np.zeros(n, np.int64)), "ty": const(1), "tx": const(1), **{c: const(4 * T.TILE) for c in ("height", "width")}, **{c: const(T.TILE) for c in ("rows", "cols")}}
    tiles = pa.RecordBatch.from_pydict({**head, "data": pa.array([bytes(4 * T.TILE**2)] * n)})
    cells = pa.RecordBatch.from_pydict({"ty": head["ty"], "tx": head["tx"], "cells": pa.array([[{"cy": i // 32, "cx": i % 32, "base": 7} for i in range(1024)]] * n)})
    for f, batch in zip(found, (tiles, tiles, cells), strict=True):
        list(f(iter([batch.slice(0, 1)])))
        tracemalloc.start()
        for out in f(iter([batch])):
            assert out.num_rows <= T.TILE**2
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 * 4 * T.TILE**2, f


@pytest.mark.parametrize("before, after", [("64m", f"{T.BATCH_BYTES}b"), ("1m", "1m"), ("2048b", "2048b")])
def test_batches_of_tiles_are_bounded(spark, before, after):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, before)
        T.small_batches(spark)
        assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, was)
