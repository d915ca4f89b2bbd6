"""Queries on large rasters (tiles with halo exchange, products as labelled arrays) and registration of whole pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgrid.operators import points, register, subpixel, tiles
from corrgrid.plans.registry import query
from corrgrid.sources import arrays
from corrgrid.sources.derived import H_TRUE, LARGE_SQL, large_tiles
from corrgrid.staging import shared_dir, staged

_L = f"WITH {LARGE_SQL}"


def _gradient_sql(k: int) -> str:
    """Per image row, sums of the two gradients with reflected borders; no data in the neighbourhood leaves a pixel out."""
    smooth, slope = tiles.GRADIENT[k]
    h = k // 2
    mirror = lambda i: f"CASE WHEN {i} < 0 THEN -{i} WHEN {i} >= side THEN 2 * side - 2 - {i} ELSE {i} END"
    taps = lambda x, ws, over: " + ".join(f"{w} * lead({x}, {i}) OVER ({over})" for i, w in enumerate(ws))
    return f"""{_L},
    edges AS MATERIALIZED (SELECT i, {mirror('i')} AS at FROM side, range(-{h}, side + {h}) t(i)),
    whole AS MATERIALIZED (SELECT r.i AS r, c.i AS c, v FROM edges r, edges c JOIN large ON row = r.at AND col = c.at),
    across AS (SELECT r, c + {h} AS c, {taps('v', slope, 'PARTITION BY r ORDER BY c')} AS d, {taps('v', smooth, 'PARTITION BY r ORDER BY c')} AS s FROM whole),
    down AS (SELECT r + {h} AS r, c, {taps('d', smooth, 'PARTITION BY c ORDER BY r')} AS gx, {taps('s', slope, 'PARTITION BY c ORDER BY r')} AS gy FROM across)
    SELECT r AS row, count(gx + gy)::BIGINT AS n, sum(gx)::BIGINT AS gx, sum(gy)::BIGINT AS gy, sum(gx * gx + gy * gy)::BIGINT AS energy FROM down, side WHERE r BETWEEN 0 AND side - 1 AND c BETWEEN 0 AND side - 1 GROUP BY r"""


def _gradient(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    px = tiles.to_pixels(tiles.sobel(large_tiles(spark, sf_dir), k), "gx", "gy")
    whole = lambda c, name: F.sum(c).cast("long").alias(name)
    return px.groupBy("row").agg(F.count(F.col("gx") + F.col("gy")).alias("n"), whole("gx", "gx"), whole("gy", "gy"), whole(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"), "energy"))


@query("tiled_sobel", _gradient_sql(3))
def tiled_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradient(spark, sf_dir, 3)


@query("tiled_sobel_5", _gradient_sql(5))
def tiled_sobel_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradient(spark, sf_dir, 5)


def _ellipse_sql(src: str, out: str, k: int, pick: str) -> str:
    """Extremes over an ellipse: windows along the rows by chord, then shifted rows; no data takes no part and stays."""
    half, best = tiles.chords(k), "least" if pick == "min" else "greatest"
    rows = ", ".join(f"{pick}(v) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS h{w}" for w in sorted(set(half)))
    shift = lambda d, w: f"h{w}" if not d else f"lead(h{w}, {d}) OVER c" if d > 0 else f"lag(h{w}, {-d}) OVER c"
    every = ", ".join(shift(i - k // 2, w) for i, w in enumerate(half))
    return f"{out}_r AS (SELECT row, col, v, {rows} FROM {src}), {out} AS MATERIALIZED (SELECT row, col, CASE WHEN v IS NOT NULL THEN {best}({every}) END AS v FROM {out}_r WINDOW c AS (PARTITION BY col ORDER BY row))"


@query("tiled_opening", f"{_L}, {_ellipse_sql('large', 'e', 31, 'min')}, {_ellipse_sql('e', 'o', 31, 'max')} SELECT o.row, count(o.v)::BIGINT AS n, sum(o.v)::BIGINT AS opened, sum(least(greatest(l.v - o.v + 128, 0), 255))::BIGINT AS flat FROM o JOIN large l USING (row, col) GROUP BY o.row")
def tiled_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background by an ellipse of side 31 and the image less it, per row of the large image."""
    t = large_tiles(spark, sf_dir)
    opened = tiles.to_pixels(tiles.opening(t, 31)).select("row", F.col("data").alias("o"), F.lit(None).cast("double").alias("f"))
    flat = tiles.to_pixels(tiles.illumination_bias(t, 31)).select("row", F.lit(None).cast("double").alias("o"), F.col("data").alias("f"))
    return opened.unionAll(flat).groupBy("row").agg(F.count("o").alias("n"), F.sum("o").cast("long").alias("opened"), F.sum("f").cast("long").alias("flat"))


def _products(spark: SparkSession, sf_dir: str) -> str:
    """The large image's tiles as labelled products in a new folder."""
    path = f"{shared_dir(spark)}/products-{uuid.uuid4().hex}"
    t = large_tiles(spark, sf_dir).select(F.concat_ws("-", F.lit("tile"), "ty", "tx").alias("name"), "rows", "cols", F.col("data").alias("values"))
    arrays.write_arrays(t, path)
    return path


@query("product_scan", f"{_L} SELECT 'tile-' || (row // 256) || '-' || (col // 256) AS name, row % 256 AS row, count(v)::BIGINT AS n, sum(v)::BIGINT AS total FROM large WHERE row % 256 BETWEEN 96 AND 159 GROUP BY ALL")
def product_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 96 to 159 of every product: only their bytes are read."""
    px = arrays.read_arrays(spark, _products(spark, sf_dir)).where("row between 96 and 159")
    return px.groupBy(F.regexp_extract("label_path", r"([^/]+)\.xml$", 1).alias("name"), "row").agg(F.count("v").alias("n"), F.sum("v").cast("long").alias("total"))


@query("template_shifts", "SELECT (o_orderkey % 4)::INT AS class, count(*) AS n, 0::BIGINT AS wrong FROM orders GROUP BY ALL")
def template_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the large image, shown up to two pixels off, find their places again: wrong counts those that do not."""
    t = staged(large_tiles(spark, sf_dir), options={"parquet.block.size": str(16 << 20)})  # read as source and as reference
    side = t.select("height").first()[0]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y = (F.col("o_orderkey") * 37) % side, (F.col("o_custkey") * 53 + F.col("o_orderkey")) % side
    m = o.select(F.col("o_orderkey").alias("m"), F.lit(0).alias("image_id"), x.alias("x0"), y.alias("y0"), (x + F.col("o_orderkey") % 5 - 2).alias("x1"), (y + F.col("o_custkey") % 5 - 2).alias("y1"))
    found = subpixel.refine(m, t, t, keep=("x0", "y0"))
    wrong = (F.col("status") == "edge") | ((F.col("status") == "refined") & ((F.abs(F.col("rx") - F.col("x0")) > 0.5) | (F.abs(F.col("ry") - F.col("y0")) > 0.5)))
    return found.groupBy((F.col("m") % 4).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"))


@query("register_pairs", """WITH n AS (SELECT vec_id % 4 AS image, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL)
    SELECT image AS pair_id, n AS n_matches, n AS inliers, 'success' AS status, TRUE AS near_truth FROM n
    UNION ALL SELECT 4 + image, 0, 0, 'insufficient_matches', NULL FROM n UNION ALL SELECT 8, 0, 0, 'no_features', NULL""")
def register_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four images and their projected likenesses: each pair of an image and its own likeness, and four wrong pairs."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") % 4).alias("image_id"), F.col("vec_id").alias("kp_id"), ((F.col("vec_id") * 37) % 997).cast("double").alias("x"), ((F.col("vec_id") * 101) % 991).cast("double").alias("y"), F.col("embedding").alias("v"))
    px, py = points.project(F.col("x"), F.col("y"), H_TRUE)
    features = e.unionByName(e.select((F.col("image_id") + 10).alias("image_id"), "kp_id", px.alias("x"), py.alias("y"), "v"))
    own = e.select("image_id").distinct()
    pairs = own.select(F.col("image_id").alias("pair_id"), F.col("image_id").alias("source_id"), (F.col("image_id") + 10).alias("reference_id"))
    wrong = own.select((F.col("image_id") + 4).alias("pair_id"), F.col("image_id").alias("source_id"), ((F.col("image_id") + 1) % 4 + 10).alias("reference_id"))
    none = spark.range(1).select(F.lit(8).cast("long").alias("pair_id"), F.lit(0).cast("long").alias("source_id"), F.lit(99).cast("long").alias("reference_id"))
    got = register.register_pairs(pairs.unionByName(wrong).unionByName(none), features, canvas=(1000.0, 1000.0))
    worst = F.greatest(*[F.abs(F.col("h")[i] - h) for i, h in enumerate(H_TRUE)])
    return got.select("pair_id", "n_matches", "inliers", "status", F.when(F.col("h").isNotNull(), worst < 1e-4).alias("near_truth"))
