"""Queries of pixel frames, match chains, scores from measured inputs, whole exports and the whole run catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrgrid.functions import geo
from corrgrid.operators import catalog, estimate, exports, frames, matching, points, raster
from corrgrid.plans import imaging, queries
from corrgrid.plans.registry import ORACLES, query, rounded
from corrgrid.sources.derived import H_TRUE, MATCHES_SQL, PIXELS_SQL, matches, pixels, read

_M, _P, _E, _BOX = f"WITH {MATCHES_SQL}", f"WITH {PIXELS_SQL}", queries._E, imaging._BOX
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ROWS = _KEY.split(", ")


# --- frames --------------------------------------------------------------------------------------
@query("pixel_scale", f"{_M} SELECT {_KEY}, round((x0+0.5)*0.25::DOUBLE-0.5,4) AS coarse, round((x0+0.5)/0.25::DOUBLE-0.5,4) AS fine FROM m")
def pixel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matches(spark, sf_dir).select(*_ROWS, frames.rescale(F.col("x0"), 0.25).alias("coarse"), frames.unscale(F.col("x0"), 0.25).alias("fine")))


@query("projection_variants", f"{_M}, p AS (SELECT *, 0.98*x0+ -0.12*y0+14.0 u, 0.11*x0+1.01*y0+ -7.5 v, 2e-5*x0+ -1e-5*y0+1.0 w FROM m) SELECT {_KEY}, round(u/(w+1e-8),4) AS px, round(v/(w+1e-8),4) AS py, round(u,4) AS flat_x, round(v,4) AS flat_y FROM p")
def projection_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, w = (H_TRUE[k] * F.col("x0") + H_TRUE[k + 1] * F.col("y0") + H_TRUE[k + 2] for k in (0, 3, 6))
    return rounded(matches(spark, sf_dir).select(*_ROWS, (u / (w + 1e-8)).alias("px"), (v / (w + 1e-8)).alias("py"), u.alias("flat_x"), v.alias("flat_y")))


@query("grey", f"{_P} SELECT image_id, row, col, round(0.299::DOUBLE*a+0.587::DOUBLE*b+0.114::DOUBLE*(255-b),4) AS grey FROM px")
def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels(spark, sf_dir).select(*raster.AT, frames.grey(F.col("a"), F.col("b"), 255 - F.col("b")).alias("grey")))


@query("normalise_globally", f"{_P} SELECT image_id, row, col, round((a-(SELECT min(a) FROM px))/((SELECT max(a)-min(a) FROM px)+1e-8::DOUBLE),4) AS v FROM px")
def normalise_globally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.normalise_globally(pixels(spark, sf_dir), "a", "v").select(*raster.AT, "v"))


@query("scale_ratio", "WITH s AS (SELECT n_nationkey k, 0.25::DOUBLE*(n_nationkey+1) gsd FROM nation WHERE n_nationkey%5<>0) SELECT c_custkey AS image_id, round(coalesce(b.gsd,1.0::DOUBLE)/coalesce(a.gsd,1.0::DOUBLE),4) AS scale FROM customer LEFT JOIN s a ON a.k=c_nationkey LEFT JOIN s b ON b.k=(c_nationkey+1)%25")
def scale_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_nationkey").alias("src"), ((F.col("c_nationkey") + 1) % 25).alias("ref"))
    sensors = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("sensor"), (0.25 * (F.col("n_nationkey") + 1)).alias("gsd"))
    return rounded(frames.scale_ratio(images, sensors, "src", "ref").select("image_id", "scale"))


@query("resample_plan", _BOX + ", s AS (SELECT image_id, width_px, height_px, (image_id%9+1)/5.0::DOUBLE f FROM g) SELECT image_id, CASE WHEN abs(f-1)<0.01 THEN 'keep' WHEN f<1 THEN 'area' ELSE 'cubic' END AS method, CASE WHEN abs(f-1)<0.01 THEN width_px ELSE floor(width_px*f)::BIGINT END AS width, CASE WHEN abs(f-1)<0.01 THEN height_px ELSE floor(height_px*f)::BIGINT END AS height FROM s")
def resample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = (F.col("image_id") % 9 + 1) / 5.0
    return imaging._grid(spark, sf_dir).select("image_id", frames.resampling(f, F.col("width_px"), F.col("height_px")).alias("s")).select("image_id", "s.*")


_FIT = "least(1.0::DOUBLE, 256.0::DOUBLE/greatest(width_px,height_px))"


@query("network_size", _BOX + f", s AS (SELECT *, greatest(floor(width_px*{_FIT}/8)*8,8)::BIGINT nw, greatest(floor(height_px*{_FIT}/8)*8,8)::BIGINT nh FROM g) SELECT image_id, nw AS width, nh AS height, round(width_px/nw,4) AS fx, round(height_px/nh,4) AS fy FROM s")
def network_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = imaging._grid(spark, sf_dir).select("image_id", frames.network_size(F.col("width_px"), F.col("height_px"), 256).alias("s"))
    return rounded(s.select("image_id", "s.*"))


_CORNERS = _BOX + ", k AS (SELECT image_id, unnest(['UL','UR','LR','LL']) corner, unnest([0,width_px-1,width_px-1,0]) x, unnest([0,0,height_px-1,height_px-1]) y, unnest([min_lon,max_lon,max_lon,min_lon]) lon, unnest([max_lat,max_lat,min_lat,min_lat]) lat FROM g)"


@query("corner_pixels", _CORNERS + " SELECT image_id, corner, x::BIGINT AS x, y::BIGINT AS y, round(lon,4) AS lon, round(lat,4) AS lat FROM k")
def corner_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.corner_pixels(imaging._grid(spark, sf_dir)))


@query("footprint_gsd", _BOX + ", m AS (SELECT *, pi()*1737400::DOUBLE/180 d FROM g) SELECT image_id, round(sqrt((max_lon-min_lon)*cos(radians((min_lat+max_lat)/2))*d/greatest(width_px-1,1)*(max_lat-min_lat)*d/greatest(height_px-1,1)),3) AS by_corners, round(sqrt(wide*high/(width_px*height_px)),3) AS by_box FROM m")
def footprint_gsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = imaging._grid(spark, sf_dir)
    by_corners = frames.footprint_gsd(frames.corner_pixels(g)).withColumnRenamed("gsd_m", "by_corners")
    return rounded(g.select("image_id", frames.box_gsd().alias("by_box")).join(by_corners, "image_id"), 3)


@query("harmonised_frames", _CORNERS + """, r AS (SELECT image_id, corner, x, y, ((lon + 0.01 * lat) - (min_lon - 0.5)) / ((max_lon - min_lon) / 1000) AS col, ((max_lat + 0.25) - lat) / ((max_lat - min_lat) / 800) AS row,
        (image_id % 9 + 1) / 5.0::DOUBLE AS sg, (image_id % 4 + 1) / 2.0::DOUBLE AS rg FROM k JOIN g USING (image_id)), f AS (SELECT *, greatest(sg, rg) AS gsd FROM r)
    SELECT image_id, corner, round(col, 3) AS col, round(row, 3) AS row, round((col + 0.5) / (gsd / rg) - 0.5, 3) AS small_col, round((row + 0.5) / (gsd / rg) - 0.5, 3) AS small_row, round(gsd, 3) AS matching_gsd, round(rg / sg, 3) AS scale_ratio FROM f""")
def harmonised_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's corners through its prior homography, at full size and in the common frame."""
    g = imaging._grid(spark, sf_dir)
    corners = frames.corner_pixels(g).withColumn("lon", F.col("lon") + 0.01 * F.col("lat"))  # sheared against the map
    reference = g.select("image_id", ((F.col("max_lon") - F.col("min_lon")) / 1000).alias("gsd_lon"), ((F.col("max_lat") - F.col("min_lat")) / 800).alias("gsd_lat"), (F.col("min_lon") - 0.5).alias("lon0"), (F.col("max_lat") + 0.25).alias("lat0"))
    distances = g.select("image_id", ((F.col("image_id") % 9 + 1) / 5.0).alias("source_gsd"), ((F.col("image_id") % 4 + 1) / 2.0).alias("reference_gsd"))
    common = frames.harmonise(distances.join(frames.prior_homography(corners, reference), "image_id"))
    at = corners.join(common, "image_id")
    small = lambda c: (F.col(c) + 0.5) / F.col("source_factor") - 0.5
    (col, row), (small_col, small_row) = estimate.project_by("prior", F.col("x"), F.col("y")), estimate.project_by("h0", small("x"), small("y"))
    return rounded(at.select("image_id", "corner", col.alias("col"), row.alias("row"), small_col.alias("small_col"), small_row.alias("small_row"), "matching_gsd", "scale_ratio"), 3)


@query("padded_box", _BOX + " SELECT image_id, round((min_lon+max_lon)/2,4) AS lon, round((min_lat+max_lat)/2,4) AS lat, round(greatest(-180,min_lon-(max_lon-min_lon)*0.1),4) AS min_lon, round(greatest(-90,min_lat-(max_lat-min_lat)*0.1),4) AS min_lat, round(least(180,max_lon+(max_lon-min_lon)*0.1),4) AS max_lon, round(least(90,max_lat+(max_lat-min_lat)*0.1),4) AS max_lat FROM g")
def padded_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    box = [c.alias(n) for c, n in zip(frames.padded(0.1), ("min_lon", "min_lat", "max_lon", "max_lat"), strict=True)]
    return rounded(imaging._grid(spark, sf_dir).select("image_id", mid("min_lon", "max_lon").alias("lon"), mid("min_lat", "max_lat").alias("lat"), *box))


# --- matches -------------------------------------------------------------------------------------
@query("keypoint_look_up", "SELECT l_orderkey, l_linenumber, l_partkey AS idx0, l_suppkey AS idx1, (p_partkey*37%1000)::DOUBLE AS x0, (p_size*20)::DOUBLE AS y0, (s_suppkey*17%1000)::DOUBLE AS x1, (s_nationkey*40)::DOUBLE AS y1 FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey")
def keypoint_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("idx0"), F.col("l_suppkey").alias("idx1"))
    point = lambda df, k, x, y: df.select(F.col(k).alias("idx"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    left = point(read(spark, sf_dir, "part"), "p_partkey", F.col("p_partkey") * 37 % 1000, F.col("p_size") * 20)
    right = point(read(spark, sf_dir, "supplier"), "s_suppkey", F.col("s_suppkey") * 17 % 1000, F.col("s_nationkey") * 40)
    return matching.look_up(ids, left, right).select("l_orderkey", "l_linenumber", "idx0", "idx1", "x0", "y0", "x1", "y1")


def _held(v: str) -> str:
    return f"{v} >= t*224 AND {v} < t*224+256"


@query("tile_union", f"{_M}, t AS (SELECT unnest(range(0,5)) t) SELECT pair_id, y.t AS ty, x.t AS tx, count(*) AS n FROM m JOIN t y ON {_held('y0').replace('t*', 'y.t*')} AND {_held('y1').replace('t*', 'y.t*')} JOIN t x ON {_held('x0').replace('t*', 'x.t*')} AND {_held('x1').replace('t*', 'x.t*')} WHERE least(x0,y0,x1,y1)>=0 AND greatest(x0,y0,x1,y1)<1000 GROUP BY ALL")
def tile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.tile_union(matches(spark, sf_dir), 1000, 256, 32).groupBy("pair_id", "ty", "tx").agg(F.count(F.lit(1)).alias("n"))


@query("scale_union", f"{_M}, u AS (SELECT pair_id, s, x0/s x, y0/s y FROM m, (SELECT unnest([0.5,0.75,1.0,1.5,2.0]::DOUBLE[]) s)) SELECT pair_id, floor(x/125)::BIGINT AS cx, floor(y/125)::BIGINT AS cy, count(*) AS n, count(DISTINCT s) AS scales FROM u WHERE x<1000 AND y<1000 GROUP BY ALL")
def scale_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = matching.scale_union(matches(spark, sf_dir), (0.5, 0.75, 1.0, 1.5, 2.0), "x0", "y0").where("x0 < 1000 and y0 < 1000")
    return u.groupBy("pair_id", F.floor(F.col("x0") / 125).alias("cx"), F.floor(F.col("y0") / 125).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scale").alias("scales"))


@query("pixel_alignment", f"{_P} SELECT x.row, x.col, x.a AS ref, y.a AS reg FROM px x JOIN px y USING (row, col) WHERE x.image_id=0 AND y.image_id=1 AND x.a IS NOT NULL AND y.a IS NOT NULL")
def pixel_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return matching.align(px.where("image_id = 0"), px.where("image_id = 1"), "a")


@query("whole_image_errors", f"{_P} SELECT count(*) AS n, round(sqrt(avg((x.b-y.b)**2)),4) AS rmse, round(avg(abs(x.b-y.b)),4) AS mae, CASE WHEN count(*)>=100 THEN 'ok' ELSE 'insufficient_overlap' END AS status FROM px x JOIN px y USING (row, col) WHERE x.image_id=0 AND y.image_id=1")
def whole_image_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    apart, n = F.col("ref") - F.col("reg"), F.count(F.lit(1))
    both = matching.align(px.where("image_id = 0"), px.where("image_id = 1"), "b")
    return rounded(both.agg(n.alias("n"), F.sqrt(F.avg(apart * apart)).alias("rmse"), F.avg(F.abs(apart)).alias("mae"), F.when(n >= 100, "ok").otherwise("insufficient_overlap").alias("status")))


@query("shown_matches", f"{_M} SELECT pair_id, {_KEY}, row_number() OVER (PARTITION BY pair_id ORDER BY {queries._KEYS})::INTEGER AS place FROM m QUALIFY place <= 50")
def shown_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("confidence"), *_ROWS, F.col("l_extendedprice")]
    return exports.numbered(matches(spark, sf_dir), "pair_id", order).where("idx < 50").select("pair_id", *_ROWS, (F.col("idx") + 1).cast("int").alias("place"))


@query("subpixel_stats", f"{_M}, {_E} SELECT pair_id, count_if(e<1) AS refined, round(avg(e) FILTER (e<1),4) AS mean_shift, round(max(e) FILTER (e<1),4) AS max_shift FROM e GROUP BY pair_id")
def subpixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(points.residual(H_TRUE) < 1, points.residual(H_TRUE))
    return rounded(matches(spark, sf_dir).groupBy("pair_id").agg(F.count(shift).alias("refined"), F.avg(shift).alias("mean_shift"), F.max(shift).alias("max_shift")))


@query("heat_map", f"{_M}, g AS (SELECT pair_id, floor(x0/100)::BIGINT cx, floor(y0/100)::BIGINT cy, count(*) n FROM m GROUP BY ALL) SELECT pair_id, cx, cy, round(n/greatest(max(n) OVER (PARTITION BY pair_id),1),4) AS heat FROM g")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matches(spark, sf_dir).groupBy("pair_id", F.floor(F.col("x0") / 100).alias("cx"), F.floor(F.col("y0") / 100).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(g.select("pair_id", "cx", "cy", (F.col("n") / F.greatest(F.max("n").over(Window.partitionBy("pair_id")), F.lit(1))).alias("heat")))


# --- scores from measured inputs -----------------------------------------------------------------
@query("gradient_zncc", _P + queries._SOBEL + " SELECT image_id, round(corr(sqrt(gx*gx+gy*gy), sqrt(hx*hx+hy*hy)),4) AS zncc FROM s GROUP BY image_id")
def gradient_zncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    return rounded(raster.correlation(queries._sobel(spark, sf_dir).select("image_id", size("gx", "gy").alias("g"), size("hx", "hy").alias("h")), "g", "h", flat=queries.NAN).select("image_id", "zncc"))


_BIN = "least(floor(({v}-min({v}) OVER w)*256.0::DOUBLE/nullif(max({v}) OVER w-min({v}) OVER w,0)),255)::BIGINT"


@query("mutual_information_256", _P + f", q AS (SELECT image_id, {_BIN.format(v='a')} i, {_BIN.format(v='b')} k FROM px WHERE a IS NOT NULL WINDOW w AS (PARTITION BY image_id)), j AS (SELECT image_id, i, k, count(*) n FROM q GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY image_id,i) ni, sum(n) OVER (PARTITION BY image_id,k) nk, sum(n) OVER (PARTITION BY image_id) nn FROM j) SELECT image_id, round(sum(n/nn*ln((n/nn)/((ni/nn)*(nk/nn)+1e-8))),4) AS mi FROM w GROUP BY image_id")
def mutual_information_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.mutual_information_ranged(pixels(spark, sf_dir).where("a is not null"), "a", "b", 256))


def _of(name: str) -> str:
    return f"({ORACLES[name]})"


@query("quality_first", f"SELECT image_id, round(least(greatest(100*(0.3::DOUBLE*greatest(z.zncc,0)+0.3::DOUBLE*(s.ssim+1)/2+0.2::DOUBLE*greatest(g.gradient_corr,0)+0.2::DOUBLE*exp(-i.mi/100)),0),100),3) AS score FROM {_of('zncc')} z JOIN {_of('ssim')} s USING (image_id) JOIN {_of('gradient_correlation')} g USING (image_id) JOIN {_of('mutual_information_256')} i USING (image_id)")
def quality_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [queries.zncc(spark, sf_dir).select("image_id", "zncc"), queries.ssim(spark, sf_dir).select("image_id", "ssim"), queries.gradient_correlation(spark, sf_dir), mutual_information_256(spark, sf_dir)]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(p, "image_id")
    up = lambda c: F.greatest(F.col(c), F.lit(0.0))
    score = 100 * (0.3 * up("zncc") + 0.3 * (F.col("ssim") + 1) / 2 + 0.2 * up("gradient_corr") + 0.2 * F.exp(-F.col("mi") / 100))
    return rounded(one.select("image_id", F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)).alias("score")), 3)


@query("quality_measured", f"SELECT r.pair_id, round(least(greatest(25*greatest(z.zncc,0)+25*(s.ssim+1)/2+20*r.inlier_ratio+15*o.score/100+15*r.subpixel/r.n,0),100),3) AS score FROM {_of('residual_report')} r JOIN {_of('occupancy')} o USING (pair_id) JOIN {_of('zncc')} z ON z.image_id=r.pair_id%2 JOIN {_of('ssim')} s ON s.image_id=r.pair_id%2")
def quality_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = queries.residual_report(spark, sf_dir).withColumn("image_id", F.col("pair_id") % 2)
    r = r.join(queries.occupancy(spark, sf_dir).select("pair_id", F.col("score").alias("spread")), "pair_id")
    r = r.join(queries.zncc(spark, sf_dir).select("image_id", "zncc"), "image_id").join(queries.ssim(spark, sf_dir).select("image_id", "ssim"), "image_id")
    return rounded(r.select("pair_id", geo.quality(F.col("zncc"), F.col("ssim"), F.col("inlier_ratio"), F.col("spread"), F.col("subpixel") / F.col("n")).alias("score")), 3)


# --- exports -------------------------------------------------------------------------------------
_PRED = "printf('%.4f', ((0.98*x0+ -0.12*y0+14.0)/(2e-5*x0+ -1e-5*y0+1.0))::DOUBLE) AS pred_ref_x, printf('%.4f', ((0.11*x0+1.01*y0+ -7.5)/(2e-5*x0+ -1e-5*y0+1.0))::DOUBLE) AS pred_ref_y"


# Halves round up, as Spark's format does; printf would go by the binary fraction.
@query("match_table", f"{_M}, {_E} SELECT {_KEY}, printf('%.4f', x0::DOUBLE) AS src_canvas_x, printf('%.4f', y0::DOUBLE) AS src_canvas_y, printf('%.4f', x1::DOUBLE) AS ref_x, printf('%.4f', y1::DOUBLE) AS ref_y, {_PRED}, printf('%.4f', floor(confidence::DOUBLE*10000+0.500001)/10000) AS confidence, (e<3)::INT::VARCHAR AS inlier FROM e")
def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return m.select(*_ROWS, *exports.match_table(m, points.project(F.col("x0"), F.col("y0"), H_TRUE), points.residual(H_TRUE) < 3))


@query("numbered_matches", f"{_M}, {_E} SELECT pair_id, {_KEY}, row_number() OVER (PARTITION BY pair_id ORDER BY {_KEY}, l_extendedprice)-1 AS idx, round(e,4) AS error FROM e")
def numbered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = exports.numbered(matches(spark, sf_dir), "pair_id", [F.col(c) for c in (*_ROWS, "l_extendedprice")])
    return rounded(m.select("pair_id", *_ROWS, "idx", points.residual(H_TRUE).alias("error")))


# --- catalog -------------------------------------------------------------------------------------
_FULL = "WITH mt AS (SELECT l_orderkey run_id, count(*) num_matches, max(l_extendedprice)/1050.0 quality_score FROM lineitem GROUP BY 1), im AS (SELECT c_custkey image_id, c_name path, n_name sensor FROM customer JOIN nation ON c_nationkey=n_nationkey), f AS (SELECT o_orderkey AS run_id, a.path AS source_path, a.sensor AS source_sensor, b.path AS reference_path, b.sensor AS reference_sensor, o_orderstatus AS status, num_matches, quality_score, CASE WHEN o_orderkey%3=0 THEN o_orderpriority END AS method FROM orders JOIN im a ON a.image_id=o_custkey JOIN im b ON b.image_id=o_custkey*7%100+1 LEFT JOIN mt ON run_id=o_orderkey)"


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    r = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("source_id"), (F.col("o_custkey") * 7 % 100 + 1).alias("reference_id"), F.col("o_orderstatus").alias("status"))
    images = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("path"), F.col("c_nationkey").alias("sensor_id"))
    sensors = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sensor_id"), F.col("n_name").alias("sensor"))
    metrics = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("num_matches"), (F.max("l_extendedprice") / 1050.0).alias("quality_score"))
    configs = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("method"))
    return catalog.full_report(r, images, sensors, metrics, configs).drop("source_id", "reference_id")


@query("full_report", _FULL + " SELECT run_id, source_path, source_sensor, reference_path, reference_sensor, status, num_matches, round(quality_score,4) AS quality_score, method FROM f")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_full(spark, sf_dir))


@query("runs_by_sensor_pair", _FULL + " SELECT source_sensor, reference_sensor, run_id, row_number() OVER (PARTITION BY source_sensor, reference_sensor ORDER BY quality_score DESC, run_id)::INTEGER AS place FROM f WHERE quality_score IS NOT NULL QUALIFY place <= 10")
def runs_by_sensor_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.best_by_pair(_full(spark, sf_dir), 10).select("source_sensor", "reference_sensor", "run_id", "place")


@query("first_completed", "SELECT o_custkey AS image_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS place FROM orders WHERE o_orderstatus='F' QUALIFY place <= 2")
def first_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_completed(catalog.runs(spark, sf_dir), "image_id").select("image_id", "run_id", "place")


_SETS = "WITH d AS (SELECT c_name AS name, c_nationkey AS sensor_id, c_acctbal AS size, NULL AS note, 'upload' AS origin, c_custkey%700 AS pair, c_custkey%3 AS kind FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_address, 'sample', s_suppkey%700, s_suppkey%3 FROM supplier)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    uploads = c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("sensor_id"), F.col("c_acctbal").alias("size"), (F.col("c_custkey") % 700).alias("pair"), (F.col("c_custkey") % 3).alias("kind"))
    samples = s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("sensor_id"), F.col("s_suppkey").alias("note"), (F.col("s_suppkey") % 700).alias("pair"), (F.col("s_suppkey") % 3).alias("kind"))
    return catalog.list_datasets(uploads, samples)


@query("list_datasets", _SETS.replace("s_address", "s_suppkey") + " SELECT name, n_name AS sensor, size, note, origin FROM d JOIN nation ON sensor_id=n_nationkey")
def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sensor_id"), F.col("n_name").alias("sensor"))
    return _sets(spark, sf_dir).join(sensors, "sensor_id").select("name", "sensor", "size", "note", "origin")


@query("fetch_image", _SETS.replace("s_address", "s_suppkey") + " SELECT pair, kind, origin FROM d QUALIFY row_number() OVER (PARTITION BY pair, kind ORDER BY origin DESC) = 1")
def fetch_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _sets(spark, sf_dir).withColumn("key", F.struct("pair", "kind"))
    return catalog.fetch(listing, "key").select("pair", "kind", "origin")


@query("config_fallbacks", "SELECT event_id, coalesce(props->>'$.method', props->>'$.k', 'sift') AS method FROM events")
def config_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.get_json_object("props", f"$.{name}")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(field("method"), field("k"), F.lit("sift")).alias("method"))


@query("client_progress", "SELECT event_id, least(round((coalesce(list_position(['view','click','cart','purchase','refund'], event_type),0))/6.0::DOUBLE*100,4),95.0::DOUBLE) AS percent FROM events")
def client_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.array_position(F.array(*[F.lit(s) for s in ("view", "click", "cart", "purchase", "refund")]), F.col("event_type"))
    return rounded(read(spark, sf_dir, "events").select("event_id", F.least(F.round(stage / 6.0 * 100, 4), F.lit(95.0)).alias("percent")))
