"""Pixel frames and ground frames: scale matrices, sizes, boxes, sampling distances, channel mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.functions.geo import DEGREE_M, width_m
from corrgrid.operators.estimate import compose, invert

#: Shares of red, green and blue in a grey level.
LUMA = (0.299, 0.587, 0.114)


def rescale(v: Column, factor: Column | float) -> Column:
    """A pixel-centre coordinate in a frame `factor` times as fine."""
    return (v + 0.5) * factor - 0.5


def unscale(v: Column, factor: Column | float) -> Column:
    return (v + 0.5) / factor - 0.5


def grey(red: Column, green: Column, blue: Column) -> Column:
    return LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue


def normalise_globally(px: DataFrame, v: str, out: str) -> DataFrame:
    """v to 0..1 by the extremes of all images together; two numbers come to the driver."""
    low, high = px.agg(F.min(v).cast("double"), F.max(v).cast("double")).first()
    return px.withColumn(out, (F.col(v) - F.lit(low)) / (F.lit(high) - F.lit(low) + 1e-8))


def scale_ratio(images: DataFrame, sensors: DataFrame, source: str, reference: str) -> DataFrame:
    """images with scale: sampling distance of the reference's sensor (sensor, gsd) over the source's; unknown sensors count 1."""
    dim = lambda key, gsd: sensors.select(F.col("sensor").alias(key), F.col("gsd").alias(gsd))
    both = images.join(dim(source, "source_gsd"), source, "left").join(dim(reference, "reference_gsd"), reference, "left")
    return both.withColumn("scale", F.coalesce("reference_gsd", F.lit(1.0)) / F.coalesce("source_gsd", F.lit(1.0)))


def resampling(scale: Column, width: Column, height: Column) -> Column:
    """How an image is brought to another sampling distance: method and size; within 1 % it stays."""
    method = F.when(F.abs(scale - 1) < 0.01, "keep").when(scale < 1, "area").otherwise("cubic")
    side = lambda x: F.when(F.abs(scale - 1) < 0.01, x).otherwise((x * scale).cast("long"))
    return F.struct(method.alias("method"), side(width).alias("width"), side(height).alias("height"))


def network_size(width: Column, height: Column, most: int, step: int = 8) -> Column:
    """Sides of at most `most`, whole multiples of `step`, and the factors that lead back."""
    shrink = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    fit = lambda x: F.greatest(F.floor(x * shrink / step) * step, F.lit(step))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"), (width / fit(width)).alias("fx"), (height / fit(height)).alias("fy"))


def corner_pixels(boxes: DataFrame) -> DataFrame:
    """Four rows per box: corner (upper left, upper right, lower right, lower left), its pixel and its position."""
    right, low = F.col("width_px") - 1, F.col("height_px") - 1
    zero = F.lit(0).cast("long")
    four = [("UL", zero, zero, "min_lon", "max_lat"), ("UR", right, zero, "max_lon", "max_lat"), ("LR", right, low, "max_lon", "min_lat"), ("LL", zero, low, "min_lon", "min_lat")]
    rows = [F.struct(F.lit(n).alias("corner"), x.alias("x"), y.alias("y"), F.col(lon).alias("lon"), F.col(lat).alias("lat")) for n, x, y, lon, lat in four]
    return boxes.select("image_id", F.inline(F.array(*rows)))


def padded(share: float) -> tuple[Column, Column, Column, Column]:
    """min_lon, min_lat, max_lon, max_lat of the box grown by a share of its size on every side, within the globe."""
    lon, lat = (F.col("max_lon") - F.col("min_lon")) * share, (F.col("max_lat") - F.col("min_lat")) * share
    return F.greatest(F.lit(-180.0), F.col("min_lon") - lon), F.greatest(F.lit(-90.0), F.col("min_lat") - lat), F.least(F.lit(180.0), F.col("max_lon") + lon), F.least(F.lit(90.0), F.col("max_lat") + lat)


def footprint_gsd(corners: DataFrame) -> DataFrame:
    """image_id, gsd_m: ground metres per pixel from the corners' positions (rows of corner_pixels)."""
    at = lambda name, c: F.max(F.when(F.col("corner") == name, F.col(c)))
    g = corners.groupBy("image_id").agg(F.avg("lat").alias("mid"), *[at(n, c).alias(f"{n}_{c}") for n in ("UL", "UR", "LL") for c in ("x", "y", "lon", "lat")])

    def length(other: str) -> Column:
        x = (F.col(f"{other}_lon") - F.col("UL_lon")) * F.cos(F.radians("mid"))
        y = F.col(f"{other}_lat") - F.col("UL_lat")
        return F.sqrt(x * x + y * y) * DEGREE_M

    across, along = length("UR") / F.greatest(F.col("UR_x"), F.lit(1)), length("LL") / F.greatest(F.col("LL_y"), F.lit(1))
    return g.select("image_id", F.sqrt(across * along).alias("gsd_m"))


def box_gsd() -> Column:
    """Ground metres per pixel from the box alone."""
    mid = (F.col("min_lat") + F.col("max_lat")) / 2
    return F.sqrt(width_m(F.col("min_lon"), F.col("max_lon"), mid) * (F.col("max_lat") - F.col("min_lat")) * DEGREE_M / (F.col("width_px") * F.col("height_px")))


def square_to_quad(x: list[Column], y: list[Column]) -> list[Column]:
    """The homography, row-major, from the unit square's corners (0,0) (1,0) (1,1) (0,1) to four points in
    that order, in closed form; NULL where three of them lie on a line through the solution's denominator."""
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    den = F.nullif(dx1 * dy2 - dx2 * dy1, F.lit(0.0))
    g, h = (sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den
    return [x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h, F.lit(1.0)]


def prior_homography(corners: DataFrame, reference: DataFrame) -> DataFrame:
    """image_id, prior (row-major), from source pixels to reference pixels through the positions of the corners.

    corners: rows of corner_pixels. reference: image_id, gsd_lon, gsd_lat, lon0, lat0 of a north-up map
    (degrees per pixel and the centre of its first pixel). The source's pixels and their places on the
    map are both quadrilaterals, so the map is the product of two closed forms. Images without all four
    corners, or with degenerate ones, have NULL.
    """
    at = lambda name, c: F.max(F.when(F.col("corner") == name, F.col(c))).cast("double")
    order = ("UL", "UR", "LR", "LL")
    g = corners.groupBy("image_id").agg(*[at(n, c).alias(f"{n}_{c}") for n in order for c in ("x", "y", "lon", "lat")]).join(reference, "image_id")
    to_col, to_row = (lambda n: (F.col(f"{n}_lon") - F.col("lon0")) / F.col("gsd_lon")), (lambda n: (F.col("lat0") - F.col(f"{n}_lat")) / F.col("gsd_lat"))
    source = square_to_quad([F.col(f"{n}_x") for n in order], [F.col(f"{n}_y") for n in order])
    target = square_to_quad([to_col(n) for n in order], [to_row(n) for n in order])
    # Named columns between the steps keep the expressions small.
    g = g.select("image_id", F.array(*source).alias("s"), F.array(*target).alias("t"))
    g = g.select("image_id", F.array(*invert([F.col("s")[i] for i in range(9)])).alias("s"), "t")
    h = compose([F.col("t")[i] for i in range(9)], [F.col("s")[i] for i in range(9)])
    return unit(g.select("image_id", F.array(*h).alias("h")), "h").select("image_id", F.col("h").alias("prior"))


def unit(df: DataFrame, h: str) -> DataFrame:
    """The matrix over its last entry; NULL where that is zero or an entry is NULL."""
    last = F.nullif(F.col(h)[8], F.lit(0.0))
    whole = ~F.exists(h, lambda x: x.isNull())
    return df.withColumn(h, F.when(whole & last.isNotNull(), F.transform(h, lambda x: x / last)))


def reduction(factor: Column) -> list[Column]:
    """Full pixels to the pixels of an image reduced by a factor, about pixel centres."""
    shift = (1 / factor - 1) / 2
    return [1 / factor, F.lit(0.0), shift, F.lit(0.0), 1 / factor, shift, F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def harmonise(pairs: DataFrame) -> DataFrame:
    """pairs (source_gsd, reference_gsd, prior from full source to full reference pixels) with the common frame:
    matching_gsd (the coarser), scale_ratio, source_factor, reference_factor, h0 from reduced source to reduced
    reference pixels, and prior_used. Without a prior, h0 is the identity; without a distance, all is NULL."""
    gsd = F.when(F.col("source_gsd").isNotNull() & F.col("reference_gsd").isNotNull(), F.greatest("source_gsd", "reference_gsd"))
    p = pairs.withColumn("matching_gsd", gsd).withColumn("scale_ratio", F.col("reference_gsd") / F.col("source_gsd"))
    p = p.withColumn("source_factor", F.col("matching_gsd") / F.col("source_gsd")).withColumn("reference_factor", F.col("matching_gsd") / F.col("reference_gsd"))
    back = invert(reduction(F.col("source_factor")))
    p = p.withColumn("_full", F.array(*compose([F.col("prior")[i] for i in range(9)], back)))
    p = p.withColumn("h0", F.array(*compose(reduction(F.col("reference_factor")), [F.col("_full")[i] for i in range(9)])))
    p = unit(p, "h0")
    identity = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    h0 = F.when(F.col("matching_gsd").isNotNull(), F.when(F.col("prior").isNull(), identity).otherwise(F.col("h0")))
    return p.withColumn("h0", h0).withColumn("prior_used", F.when(F.col("prior").isNull(), "scale").otherwise("corners")).drop("_full")
