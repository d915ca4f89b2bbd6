"""Template refinement: known shifts, patches over tile borders, clipped, flat and edge matches."""

import numpy as np
import pytest

from corrgrid.operators import subpixel, tiles

RNG = np.random.default_rng(4)
WAVES = [(RNG.uniform(-0.5, 0.5), RNG.uniform(-0.5, 0.5), RNG.uniform(0, 6), RNG.uniform(5, 20)) for _ in range(200)]
MATCH = "m long, image_id long, x0 double, y0 double, x1 double, y1 double"


def scene(shape, dx=0.0, dy=0.0):
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    return 128 + sum(a * np.sin(u * (x - dx) + v * (y - dy) + p) for u, v, p, a in WAVES)


def table(spark, a, tile):
    rows = [(0, ty, tx, *a.shape, *(b := a[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]).shape, bytearray(tiles.packed(b))) for ty in range(-(-a.shape[0] // tile)) for tx in range(-(-a.shape[1] // tile))]
    return spark.createDataFrame(rows, tiles.HEAD + ", data binary")


@pytest.mark.parametrize("dx, dy, tile, centred", [(0.3, -0.6, 32, True), (2.45, 1.1, 16, True), (-3.2, 0.5, 256, True)])
def test_known_shifts(spark, dx, dy, tile, centred, monkeypatch):
    monkeypatch.setattr(subpixel, "CROWD", 3)
    a, b = table(spark, scene((90, 100)), tile), table(spark, scene((90, 100), dx, dy), tile)
    rows = [(i, 0, float(x), float(y), float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(15, 85, 14) for y in range(15, 75, 12))]
    rows += [(100, 0, 3.0, 40.0, 3.0, 40.0), (101, 0, 50.0, 88.0, 50.0, 88.0), (102, 7, 50.0, 50.0, 50.0, 50.0), (103, 0, None, 50.0, 50.0, 50.0), (104, 0, 40.0, 40.0, 40.0 + dx - 5.5, 40.0)]
    got = {r.m: r for r in subpixel.refine(spark.createDataFrame(rows, MATCH).repartition(3), a, b, radius=10, centred=centred, joint=True, tile=tile).collect()}
    assert len(got) == len(rows)
    for i, _, x, y, _, _ in rows[:-5]:
        r = got[i]
        assert r.status == "refined" and abs(r.rx - x - dx) < 0.1 and abs(r.ry - y - dy) < 0.1 and r.score > 0.9 and r.shift == pytest.approx(np.hypot(r.rx - x, r.ry - y))
    assert [got[i].status for i in (100, 101, 102, 103)] == ["clipped"] * 4 and got[101].rx == 50.0 and got[101].shift is None
    assert got[104].status in ("edge", "refined") and (got[104].status == "refined" or got[104].rx == 40.0 + dx - 5.5)
    axes = {r.m: r for r in subpixel.refine(spark.createDataFrame(rows, MATCH), a, b, tile=tile).collect()}
    assert np.median([max(abs(axes[i].rx - x - dx), abs(axes[i].ry - y - dy)) for i, _, x, y, _, _ in rows[:-5]]) < 0.2
    stats = subpixel.shift_stats(subpixel.refine(spark.createDataFrame(rows[:-1], MATCH), a, b, radius=10, joint=True, tile=tile)).first()
    assert (stats.n, stats.refined) == (len(rows) - 1, len(rows) - 5) and abs(stats.mean_shift - np.hypot(dx, dy)) < 0.1


def test_fractions_flat_images_and_no_matches(spark):
    image = scene((60, 60))
    a = table(spark, image, 32)
    m = spark.createDataFrame([(1, 0, 30.25, 29.75, 31.0, 30.0)], MATCH)
    r = subpixel.refine(m, a, a, keep_fraction=True, tile=32).first()
    assert (r.rx, r.ry) == (pytest.approx(30.25, abs=0.1), pytest.approx(29.75, abs=0.1))
    flat = table(spark, np.full((60, 60), 9.0), 32)
    assert subpixel.refine(m, flat, a, tile=32).first().status == "flat" and subpixel.refine(m.where("false"), a, a, tile=32).count() == 0
    holed = image.copy()
    holed[33, 33] = np.nan
    assert subpixel.refine(m, table(spark, holed, 32), a, tile=32).first().status == "clipped"


def test_matches_that_share_regions(spark, monkeypatch):
    a, b = table(spark, scene((90, 100)), 32), table(spark, scene((90, 100), 0.3, -0.6), 32)
    rows = [(i, 0, float(x), float(y), float(x + i % 3 - 1), float(y - i % 2)) for i, (x, y) in enumerate((x, y) for x in range(5, 98, 6) for y in range(5, 88, 7))] + [(500, None, 40.0, 40.0, 40.0, 40.0)]
    m = spark.createDataFrame(rows, MATCH)
    alone = sorted(subpixel.refine(m, a, b, tile=32).collect(), key=lambda r: r.m)
    for name, value in {"CELL": 40, "FEW": 2, "CROWD": 5}.items():
        monkeypatch.setattr(subpixel, name, value)
    shared = sorted(subpixel.refine(m, a, b, tile=32).collect(), key=lambda r: r.m)
    assert shared == alone and len(alone) == len(rows) and {r.status for r in alone} == {"clipped", "refined"}


def test_parts_grow_with_the_images_and_not_with_the_matches(spark):
    a = table(spark, scene((200, 200)), 64)
    rows = [(i, 0, 40.0 + i % 50, 40.0 + i // 50, 41.0 + i % 50, 39.0 + i // 50) for i in range(2500)]
    held = []
    keep = subpixel._parts
    subpixel._parts = lambda *args: held.append(keep(*args)) or held[-1]
    try:
        subpixel.refine(spark.createDataFrame(rows, MATCH), a, a, tile=64)
    finally:
        subpixel._parts = keep
    assert sum(len(r.data) for p in held for r in p.select("data").collect()) < 1_000_000  # patches of all matches: 9 MB


@pytest.mark.parametrize("kind", ["grey", "scene", "flat", "faint", "hole", "far"])
@pytest.mark.parametrize("centred", [True, False])
def test_sums_by_displacement_equal_those_of_each_match(monkeypatch, kind, centred):
    """What crowded matches share gives what each gives alone, to the bit, and the plain correlation."""
    rng = np.random.default_rng(6)
    image = np.floor(rng.uniform(0, 256, (90, 95))) if kind == "grey" else scene((90, 95))
    if kind == "flat":
        image[10:70, 10:70] = 0.5
    if kind == "faint":
        image = 1e5 + image / 1e3
    if kind == "hole":
        image[45, 45] = np.nan
    src = rng.integers(15, 70, (40, 2))
    ref = rng.integers(15, 70, (40, 2)) if kind == "far" else src + rng.integers(-3, 3, (40, 2))
    for radius, search in ((8, 4), (3, 2), (1, 1)):
        t, n = 2 * radius + 1, 2 * search + 1
        p, q = src - radius, ref - radius - search
        got = []
        for share in (0, 1 << 40):
            monkeypatch.setattr(subpixel, "SHARE", share)
            got.append(subpixel._surfaces(image, image, p, q, t, n, centred))
        assert all(np.array_equal(x, y, equal_nan=True) for x, y in zip(*got, strict=True))
        c, hole, flat = got[0]
        for i, ((y, x), (v, u)) in enumerate(zip(p, q, strict=True)):
            template, window = image[y : y + t, x : x + t], image[v : v + t + n - 1, u : u + t + n - 1]
            assert hole[i] == (np.isnan(template).any() or np.isnan(window).any()) and flat[i] == (np.ptp(template) == 0)
            if not hole[i] and not (flat[i] and centred):
                assert c[i] == pytest.approx(subpixel.surface(template, window, centred).ravel(), abs=1e-9)


def test_crowded_matches_are_not_correlated_one_by_one(monkeypatch):
    image = scene((288, 288))
    src = RNG.integers(20, 260, (3000, 2))
    ref = src + RNG.integers(-2, 3, src.shape)
    for name in ("surface", "_alone"):
        monkeypatch.setattr(subpixel, name, lambda *args: pytest.fail("one match alone"))
    c = subpixel._surfaces(image, image, src - 8, ref - 12, 17, 9, True)[0]
    at = np.column_stack(np.unravel_index(c.argmax(axis=1), (9, 9))) - 4
    assert np.array_equal(ref + at, src)


def test_columns_handed_on_and_coordinates_that_are_no_number(spark):
    a = table(spark, scene((60, 60)), 32)
    rows = [(1, 0, 30.0, 30.0, 31.0, 30.0, "a"), (2, 0, float("nan"), 30.0, 31.0, 30.0, "b"), (3, 0, 30.0, 30.0, 31.0, None, None)]
    m = spark.createDataFrame(rows, MATCH + ", name string")
    got = {r.m: r for r in subpixel.refine(m, a, a, keep=("x0", "name"), tile=32).collect()}
    assert [(got[i].name, got[i].status) for i in (1, 2, 3)] == [("a", "refined"), ("b", "clipped"), (None, "clipped")] and got[1].x0 == 30.0 and got[3].x0 == 30.0
