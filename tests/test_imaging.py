"""Analytic answers of filters, estimation, products and exports."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrgrid.operators import catalog, estimate, exports, filters
from corrgrid.sources import products
from corrgrid.streaming import progress as stages

H = (0.98, -0.12, 14.0, 0.11, 1.01, -7.5, 2e-5, -1e-5, 1.0)
SCHEMA = "pair_id long, k long, x0 double, y0 double, x1 double, y1 double"


def project(h, x, y):
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def scene(n, outliers=0.0, noise=0.0, seed=1, pair=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(0, 500, 2)
        u, v = project(H, x, y)
        if rng.random() < outliers:
            u, v = rng.uniform(0, 500, 2)
        rows.append((pair, i, float(x), float(y), float(u + rng.normal(0, noise)), float(v + rng.normal(0, noise))))
    return rows


def image(spark, a):
    rows = [(0, int(r), int(c), None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, row long, col long, v double")


def grid(df, shape, v="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[v] is not None and 0 <= r.row < shape[0] and 0 <= r.col < shape[1]:
            out[r.row, r.col] = r[v]
    return out


def test_homography_from_sums_is_exact(spark):
    got = estimate.fit_homography(spark.createDataFrame(scene(30), SCHEMA)).first()
    assert got.n == 30 and got.h == pytest.approx(H, abs=1e-6)


def test_degenerate_points_fix_no_homography(spark):
    line = [(0, i, float(i), float(i), float(i), float(i)) for i in range(10)]
    few = [(1, i, float(i), float(i * i), 0.0, 0.0) for i in range(3)]
    assert [r.h for r in estimate.fit_homography(spark.createDataFrame(line + few, SCHEMA)).collect()] == [None, None]


def test_polynomial_fits_a_quadratic(spark):
    rows = [(0, i, 0.01 * u * u + v, u - 0.02 * u * v + 3, float(u), float(v)) for i, (u, v) in enumerate((float(a), float(b)) for a in range(6) for b in range(5))]
    m = spark.createDataFrame(rows, SCHEMA)
    got = estimate.predict_polynomial(m, estimate.fit_polynomial(m)).collect()
    assert all(math.dist((r.px, r.py), (r.x0, r.y0)) < 1e-6 for r in got)


def test_inverse_times_matrix_is_identity(spark):
    h = [F.lit(x) for x in H]
    got = spark.range(1).select(F.array(*estimate.compose(estimate.invert(h), h)).alias("g")).first().g
    assert got == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-9)


def test_transform_checks(spark):
    bad = [(-1.0, 0, 0, 0, 1, 0, 0, 0, 1), (10.0, 0, 0, 0, 10, 0, 0, 0, 1), (1.0, 0, 0, 0, 1, 0, -1, 0, 1), (float("nan"), 0, 0, 0, 1, 0, 0, 0, 1)]
    ok = lambda h: spark.range(1).select(estimate.valid_transform([F.lit(float(x)) for x in h], 100.0, 100.0)).first()[0]
    assert ok(H) and not any(ok(h) for h in bad)


def test_checkpoint_rmse_needs_points(spark):
    rows = [(0, i, x, y, 1.1 * x + 3, 1.1 * y + 3) for i, (_, _, x, y, _, _) in enumerate(scene(60))] + [(1, i, 0.0, 0.0, 0.0, 0.0) for i in range(4)]
    got = {r.pair_id: r for r in estimate.checkpoint_rmse(spark.createDataFrame(rows, SCHEMA), ("pair_id", "k")).collect()}
    assert got[0].rmse < 1e-6 and 4 <= got[0].n_test <= 25
    assert 1 not in got or got[1].rmse is None


def test_first_component_is_the_loading(spark):
    rng = np.random.default_rng(1)
    load = np.linspace(1, 3, 6)
    x = rng.normal(size=(400, 1)) * load + rng.normal(0, 0.01, (400, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, [None] * 6)], "id long, v array<double>")
    w, share, mean = estimate.first_component(df, "v", 6)
    assert share > 0.99 and w == pytest.approx(load / np.linalg.norm(load), abs=1e-2)
    pc = {r.id: r.pc1 for r in estimate.project_component(df, "v", w, mean).collect()}
    assert pc[0] == pytest.approx(float((x[0] - x.mean(0)) @ w)) and pc[999] is None


def test_warp_moves_a_peak_and_no_data(spark):
    a = np.zeros((50, 50))
    a[30, 20] = 1
    a[:5, :5] = np.nan
    got = filters.warp(image(spark, a), "v", (1, 0, -7, 0, 1, -3, 0, 0, 1))
    v, s = grid(got, a.shape), grid(got, a.shape, "support")
    assert np.unravel_index(np.nanargmax(v), v.shape) == (33, 27)
    assert (s[3:8, 7:12] == 0).all() and s[20, 20] == 1


@pytest.mark.parametrize("cubic", [False, True])
def test_warp_by_identity_changes_nothing(spark, cubic):
    a = np.random.default_rng(0).uniform(0, 9, (12, 9))
    assert grid(filters.warp(image(spark, a), "v", (1, 0, 0, 0, 1, 0, 0, 0, 1), cubic), a.shape) == pytest.approx(a)


def test_morphology_of_a_block(spark):
    a = np.zeros((12, 12))
    a[3:8, 4:9] = 5
    a[1, 1] = 9
    px = image(spark, a)
    opened = grid(filters.opening(px, "v", 1), a.shape)
    assert opened[1, 1] == 0 and (opened[3:8, 4:9] == 5).all() and opened.sum() == 125
    assert grid(filters.erode(px, "v", 1), a.shape).sum() == 45 and grid(filters.dilate(px, "v", 1), a.shape)[0, 0] == 9


def test_separable_filter_keeps_a_constant_and_leaves_borders(spark):
    t = filters.gaussian_taps(1.0, 2)
    got = grid(filters.separable(image(spark, np.full((9, 9), 4.0)), F.col("v"), t, t), (9, 9))
    assert got[2:7, 2:7] == pytest.approx(4) and np.isnan(got[0]).all()


def test_equalisation_of_one_level_and_of_a_ramp(spark):
    flat = grid(filters.clahe(image(spark, np.full((16, 16), 7.0)), "v"), (16, 16))
    assert np.ptp(flat) == 0
    ramp = grid(filters.clahe(image(spark, np.tile(np.arange(32) * 4.0, (32, 1))), "v", 16), (32, 32))
    assert (np.diff(ramp, axis=1) >= 0).all()


def test_circle_is_found(spark):
    y, x = np.mgrid[:41, :41]
    d = np.hypot(y - 20, x - 20)
    ring = np.abs(d - 6) < 0.6
    rows = [(0, int(r), int(c), float(c - 20), float(r - 20)) for r, c in zip(*np.nonzero(ring), strict=True)]
    edges = spark.createDataFrame(rows, "image_id long, row long, col long, gx double, gy double")
    best = filters.circles(edges, "gx", "gy", range(4, 9), 1.0, 5, 8).orderBy(F.desc("votes")).first()
    assert (best.cy, best.cx, best.r) == (20, 20, 6)


LABEL = """<?xml version="1.0"?>
<Product xmlns="urn:x"><File_Area_Observational><File><file_name>{file}</file_name></File>
<{kind}><offset unit="byte">{offset}</offset><axis_index_order>Last Index Fastest</axis_index_order>
<Element_Array><data_type>{dtype}</data_type>{scale}</Element_Array>{axes}{special}</{kind}></File_Area_Observational>
<sun_azimuth>135.5</sun_azimuth><pixel_resolution unit="km/pixel">.005</pixel_resolution>{corners}</Product>"""


def label(file, offset, dtype, axes, scale="", special="", corners="", kind="Array_2D_Image"):
    shown = "".join(f"<Axis_Array><axis_name>{n}</axis_name><elements>{k}</elements><sequence_number>{i}</sequence_number></Axis_Array>" for i, (n, k) in reversed(list(enumerate(axes, 1))))
    return LABEL.format(file=file, offset=offset, dtype=dtype, axes=shown, scale=scale, special=special, corners=corners, kind=kind)


def test_product_round_trip(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(b"\0" * 64 + struct.pack(">84H", *range(84)))
    corners = "".join(f"<{c}_longitude>{lon}</{c}_longitude><{c}_latitude>{lat}</{c}_latitude>" for c, lon, lat in (("upper_left", 350, 1), ("upper_right", 350.1, 1), ("lower_left", 350, 0.9), ("lower_right", 350.1, 0.9)))
    (tmp_path / "a.xml").write_text(label("a.img", 64, "UnsignedMSB2", [("Line", 12), ("Sample", 7)], corners=corners))
    (tmp_path / "b.img").write_bytes(struct.pack("<4h", 1, 2, 0, 4))
    (tmp_path / "b.xml").write_text(label("b.img", 0, "SignedLSB2", [("Line", 2), ("Sample", 2)], "<scaling_factor>.5</scaling_factor><value_offset>10</value_offset>", "<Special_Constants><missing_constant>0x0</missing_constant></Special_Constants>"))
    (tmp_path / "c.img").write_bytes(np.arange(60, dtype=">f4").tobytes())
    (tmp_path / "c.xml").write_text(label("c.img", 0, "IEEE754MSBSingle", [("Line", 5), ("Band", 3), ("Sample", 4)], kind="Array_3D_Spectrum"))
    (tmp_path / "d.xml").write_text("<broken")
    (tmp_path / "e.img").write_bytes(b"\0" * 6)
    (tmp_path / "e.xml").write_text(label("e.img", 0, "SignedLSB2", [("Line", 2), ("Sample", 2)]))
    found = products.read_labels(spark, str(tmp_path))
    by = {r.label_path.rsplit("/", 1)[-1]: r.asDict(recursive=True) for r in found.collect()}
    assert "malformed" in by["d.xml"]["error"] and by["a.xml"]["gsd_m"] == pytest.approx(5) and by["a.xml"]["metadata"] == {"sun_azimuth": 135.5}
    read = lambda k: products.read_array(spark, by[f"{k}.xml"], str(tmp_path / f"{k}.img"))
    a = {(r.row, r.col): r.v for r in read("a").collect()}
    assert a == {(r, c): 7.0 * r + c for r in range(12) for c in range(7)}
    assert {(r.row, r.col): r.v for r in read("b").collect()} == {(0, 0): 10.5, (0, 1): 11.0, (1, 0): None, (1, 1): 12.0}
    cube = np.arange(60).reshape(5, 3, 4)
    assert all(r.v == cube[r.row, r.band, r.col] for r in read("c").collect()) and read("c").count() == 60
    with pytest.raises(products.ProductError):
        read("e")
    box = products.footprint(found).first()
    assert (box.min_lon, box.max_lat) == (pytest.approx(-10), 1)


def test_map_request_orders_axes_by_version(spark):
    box = spark.createDataFrame([(10.0, -5.0, 10.2, -4.9)], "min_lon double, min_lat double, max_lon double, max_lat double")
    plan = exports.grid_plan(box, 100.0, 512)
    row = plan.select("*", exports.map_request("1.1.1").alias("old"), exports.map_request("1.3.0").alias("new")).first()
    assert 95 < row.gsd_m <= 100 and max(exports.grid_plan(box, 1.0, 512).first()[4:6]) == 512
    assert "SRS=EPSG:4326&bbox=10.0000000000,-5." in row.old and "CRS=EPSG:4326&bbox=-5.0000000000,10." in row.new


def test_image_kind_by_first_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"II*\0rest"),), (bytearray(b"<html>"),), (bytearray(b"\xff\xd8\xff\xe0"),)], "c binary")
    assert [r[0] for r in df.select(exports.image_kind(F.col("c"))).collect()] == ["tiff", None, "jpeg"]


def test_pairs_leave_out_an_image_with_itself(spark):
    got = catalog.pair_with(spark.createDataFrame([(1,), (2,), (9,)], "i long"), "i", (1, 2)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1), (9, 1), (9, 2)]


def test_tail_writes_each_event_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stages.tail(stream, str(tmp_path / "out"), str(tmp_path / "check"), most=9)
    q.processAllAvailable()
    q.stop()
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == events.count() and out.where("elided").count() == events.where("length(props) > 9").count()


def test_bias_removal_keeps_no_data(spark):
    a = np.full((6, 6), 50.0)
    a[2, 2] = np.nan
    got = grid(filters.illumination_bias(image(spark, a), "v", 1), a.shape)
    assert np.isnan(got[2, 2]) and got[0, 0] == 128
