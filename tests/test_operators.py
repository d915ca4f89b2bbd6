"""Analytic answers of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from corrgrid.operators import catalog, filters, knn, points, raster, robust
from corrgrid.streaming import progress as stages


def matches(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "pair_id long, x0 double, y0 double, x1 double, y1 double")


def test_point_rmse(spark):
    got = points.point_rmse(matches(spark, [(0.0, 0.0, 3.0, 4.0), (1.0, 1.0, 1.0, 1.0)])).first()
    assert got.rmse == pytest.approx(math.sqrt(12.5))


def test_similarity_round_trip(spark):
    t, s = math.radians(6), 1.3
    rows = [(float(x), float(y), s * (math.cos(t) * x - math.sin(t) * y) + 5, s * (math.sin(t) * x + math.cos(t) * y) - 2) for x in range(5) for y in range(4)]
    got = points.fit_similarity(matches(spark, rows)).first()
    assert (got.scale, got.rotation, got.tx, got.ty) == pytest.approx((s, 6, 5, -2))


def test_affine_of_collinear_points_is_null(spark):
    assert points.fit_affine(matches(spark, [(float(i), float(i), float(i), 0.0) for i in range(10)])).first().a is None


def test_projection_at_infinity_is_null(spark):
    x, _ = points.project(F.lit(1.0), F.lit(0.0), (1, 0, 0, 0, 1, 0, -1, 0, 1))
    assert spark.range(1).select(x).first()[0] is None


def test_zncc_of_affine_images(spark):
    px = spark.createDataFrame([(i // 50, i % 50, 0, float(i * i % 97), None if i == 3 else 3.0 * (i * i % 97) + 7) for i in range(50)], "image_id long, row long, col long, a double, b double")
    assert raster.correlation(px, "a", "b").first().zncc == pytest.approx(1)
    assert raster.correlation(px.withColumn("b", F.lit(1.0)), "a", "b").first().zncc is None


def test_area_reduce_keeps_a_ramp_and_no_data(spark):
    px = spark.createDataFrame([(0, r, c, None if r >= 4 and c >= 4 else 1.0) for r in range(8) for c in range(8)], "image_id long, row long, col long, v double")
    got = {(r.row, r.col): r.v for r in raster.area_reduce(px, "v", 4.0).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 1.0}


def test_two_nearest_across_blocks(spark):
    rows = [(i, [float(i), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: (r.nn, r.d1) for r in knn.two_nearest(df, df.withColumn("v", F.transform("v", lambda x: x + 0.25)), block=7).collect()}
    assert got[10] == (10, pytest.approx(math.sqrt(0.125)))


def test_merge_takes_the_latest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, at int")
    assert {r.k: r.v for r in catalog.merge(old, new, "k", "at").collect()} == {1: "c", 2: "b", 3: "e"}


def test_progress_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stages.progress_stream(stream).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    show = lambda df: sorted(map(tuple, df.select("user_id", "n_events", "progress").collect()))
    assert show(spark.table("progress")) == show(stages.progress(events))


def test_both_ends_must_be_inside_their_masks(spark):
    mask = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "image_id long, row long, col long")
    rows = [(1, 2.4, 1.0, 4.0, 3.0, 9), (2, 2.0, 1.0, 4.0, 9.0, 9), (3, None, 1.0, 4.0, 3.0, 9), (4, 2.6, 1.0, 4.0, 3.0, 9), (5, 2.5, 1.0, 4.5, 3.0, 9)]
    m = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, row long")
    ends = [(0, "x0", "y0"), (1, "x1", "y1")]
    assert sorted(r.id for r in filters.ends_inside(m, mask, ends).collect()) == [1, 5]
    assert filters.ends_inside(m, mask.limit(0), ends).isEmpty()


@pytest.mark.parametrize("size", [3, 7, 20, 300])
def test_small_pairs_get_every_hypothesis(spark, size):
    rows = [(i, float(i * 37 % 101), float(i * i * 13 % 97), float(i * 37 % 101) + 2, float(i * i * 13 % 97) - 1) for i in range(size)]
    m = spark.createDataFrame(rows, "k long, x0 double, y0 double, x1 double, y1 double").withColumn("pair_id", F.lit(0).cast("long"))
    _, held = robust.blocks(m, ["k"])
    got = [h for r in robust.hypotheses(held, "homography", 64, 0).collect() for h in r.hs]
    assert len(got) == 64 if size >= 4 else not got
