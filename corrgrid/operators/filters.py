"""Separable filters, morphology, tiles, resampling and region operators on pixel tables.

Sliding windows run along a row of an image and then along a column: two exchanges, whatever the
size of the kernel. Positions are values, not offsets between rows, so absent pixels leave gaps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.operators.points import project
from corrgrid.operators.quantiles import percentiles
from corrgrid.operators.raster import AT

#: Fixed value: the five-tap smoothing kernel of an image pyramid, to be divided by 16.
PYRAMID_TAPS = (1, 4, 6, 4, 1)


def _along(keep: str, move: str, low: int, high: int):
    return Window.partitionBy("image_id", keep).orderBy(move).rangeBetween(low, high)


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def separable(px: DataFrame, v: Column, across: Sequence[float], down: Sequence[float]) -> DataFrame:
    """Row kernel, then column kernel; v is NULL where any tap is absent or NULL."""

    def line(x: str, keep: str, move: str, taps: Sequence[float]) -> Column:
        k = len(taps) // 2
        return sum((float(w) * F.sum(x).over(_along(keep, move, d, d)) for d, w in zip(range(-k, k + 1), taps, strict=True)), F.lit(0.0))

    rows = px.select(*AT, v.cast("double").alias("v")).select(*AT, line("v", "row", "col", across).alias("v"))
    return rows.select(*AT, line("v", "col", "row", down).alias("v"))


def _slide(px: DataFrame, v: str, k: int, pick) -> DataFrame:
    rows = px.select(*AT, pick(v).over(_along("row", "col", -k, k)).alias("v"))
    return rows.select(*AT, pick("v").over(_along("col", "row", -k, k)).alias("v"))


def erode(px: DataFrame, v: str, k: int = 1) -> DataFrame:
    """Minimum over a square of side 2 k + 1; absent and NULL pixels take no part."""
    return _slide(px, v, k, F.min)


def dilate(px: DataFrame, v: str, k: int = 1) -> DataFrame:
    return _slide(px, v, k, F.max)


def opening(px: DataFrame, v: str, k: int = 1) -> DataFrame:
    return dilate(erode(px, v, k), "v", k)


def closing(px: DataFrame, v: str, k: int = 1) -> DataFrame:
    return erode(dilate(px, v, k), "v", k)


def illumination_bias(px: DataFrame, v: str, k: int) -> DataFrame:
    """The image less its opening, about 128, clipped to 0..255; NULL stays NULL."""
    o = opening(px, v, k).withColumnRenamed("v", "o")
    flat = F.least(F.greatest(F.col(v) - F.col("o") + 128, F.lit(0)), F.lit(255))
    return px.join(o, list(AT)).select(*AT, F.when(F.col(v).isNotNull(), flat).alias("v"))


def difference_of_log(px: DataFrame, v: str, narrow: float, wide: float, radius: int) -> DataFrame:
    """Difference of two blurs of ln(v + 1) where both kernels have all their pixels."""
    log = F.ln(F.col(v) + 1.0)
    a, b = (separable(px, log, t, t) for t in (gaussian_taps(narrow, radius), gaussian_taps(wide, radius)))
    joined = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), list(AT))
    return joined.where("a is not null and b is not null").select(*AT, (F.col("a") - F.col("b")).alias("v"))


def pyramid_down(px: DataFrame, v: str) -> DataFrame:
    """Five-tap smoothing, then every second row and column."""
    taps = [w / 16 for w in PYRAMID_TAPS]
    s = separable(px, F.col(v), taps, taps).where("row % 2 = 0 and col % 2 = 0 and v is not null")
    return s.select("image_id", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col"), "v")


def pyramid(px: DataFrame, v: str, levels: int) -> DataFrame:
    """level, image_id, row, col, v: the image and its reductions."""
    now = px.where(F.col(v).isNotNull()).select(*AT, F.col(v).cast("double").alias("v"))
    out = now.select(F.lit(0).alias("level"), "*")
    for k in range(1, levels):
        now = pyramid_down(now, "v")
        out = out.unionByName(now.select(F.lit(k).alias("level"), "*"))
    return out


def clahe(px: DataFrame, v: str, tile: int = 8, clip: float = 2.0) -> DataFrame:
    """Contrast-limited adaptive equalisation: the look-up tables of the four nearest tiles, interpolated.

    A tile's histogram is clipped, the excess spread over all 256 levels, and its running share is the
    table, one row per level. Border pixels use the tiles that exist. NULL pixels have no row.
    """
    pixels = px.where(F.col(v).isNotNull()).select(*AT, F.col(v).cast("int").alias("level"))
    h = pixels.groupBy("image_id", F.floor(F.col("row") / tile).alias("ty"), F.floor(F.col("col") / tile).alias("tx"), "level").agg(F.count(F.lit(1)).alias("n"))
    tiles = h.groupBy("image_id", "ty", "tx").agg(F.sum("n").alias("area"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("hist"))  # 256 levels at most
    limit = F.greatest(F.floor(clip * F.col("area") / 256), F.lit(1))
    levels = tiles.withColumn("limit", limit).select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    levels = levels.withColumn("n", F.coalesce(F.try_element_at("hist", F.col("level")), F.lit(0))).drop("hist")
    every = Window.partitionBy("image_id", "ty", "tx")
    kept = F.sum(F.least("n", "limit")).over(every.orderBy("level"))
    excess = F.sum(F.col("n") - F.least("n", "limit")).over(every)
    lut = levels.select("image_id", "ty", "tx", "level", F.floor(255 * (kept + excess * (F.col("level") + 1) / 256.0) / F.col("area") + 0.5).alias("out"))
    at = lambda c: (F.col(c) + 0.5) / tile - 0.5
    low = lambda c: F.floor(at(c))
    part = lambda c, d: (at(c) - low(c)) if d else (1 - (at(c) - low(c)))
    taps = [F.struct((low("row") + y).alias("ty"), (low("col") + x).alias("tx"), (part("row", y) * part("col", x)).alias("w")) for y in (0, 1) for x in (0, 1)]
    sent = pixels.select(*AT, "level", F.inline(F.array(*taps))).where("w > 0")
    met = sent.join(lut, ["image_id", "ty", "tx", "level"])
    return met.groupBy(*AT).agg((F.sum(F.col("w") * F.col("out")) / F.sum("w")).alias("v"))


def shadow_mask(edges: DataFrame, v: str, gradient: str, low: float = 0.25, high: float = 0.75, grow: int = 1) -> DataFrame:
    """Pixels darker than the low percentile with a gradient above the high one, then grown by a square."""
    one = lambda value, share, name: percentiles(edges, ["image_id"], value, [share]).select("image_id", F.col("p")[0].alias(name))
    p = one(v, low, "dark").join(one(F.abs(gradient), high, "steep"), "image_id")
    seed = edges.join(p, "image_id").where((F.col(v) < F.col("dark")) & (F.abs(gradient) > F.col("steep")))
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-grow, grow + 1) for c in range(-grow, grow + 1)])
    grown = seed.select(*AT, F.inline(steps)).select("image_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).distinct()
    return edges.select(*AT).join(grown, list(AT), "left_semi")


def eroded_mask(px: DataFrame, v: str, radius: int) -> DataFrame:
    """Valid pixels without an invalid one (NULL) within a disc."""
    disc = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in disc])
    bad = px.where(F.col(v).isNull()).select(*AT, F.inline(steps)).select("image_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).distinct()
    return px.where(F.col(v).isNotNull()).select(*AT).join(bad, list(AT), "left_anti")


def ends_inside(matches: DataFrame, mask: DataFrame, ends: list[tuple[int, str, str]], scale: float = 1.0) -> DataFrame:
    """Matches all of whose ends (image, x, y), scaled and rounded half to even, are pixels of that image's mask.

    Ends that are NULL or beyond the image are not inside; further columns may have any name.
    """
    for image, x, y in ends:
        ok = mask.where(F.col("image_id") == image).select(F.col("row").alias("_row"), F.col("col").alias("_col"))
        at = [F.rint(matches[c] * scale).cast("long") for c in (y, x)]
        matches = matches.join(ok, (at[0] == ok["_row"]) & (at[1] == ok["_col"]), "left_semi")
    return matches


def tiles(px: DataFrame, v: str, side: int, tile: int, overlap: int, least: float = 0.1) -> DataFrame:
    """Overlapping tiles with their share of valid pixels; the last snaps to the edge, nearly empty ones go."""
    starts = sorted({min(s, max(side - tile, 0)) for s in range(0, max(side - overlap, 1), tile - overlap)})
    inside = lambda c: F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: (F.col(c) >= s) & (F.col(c) < s + tile))
    dealt = px.withColumn("y0", F.explode(inside("row"))).withColumn("x0", F.explode(inside("col")))
    out = dealt.groupBy("image_id", "y0", "x0").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(v).isNotNull().cast("int")).alias("valid"))
    return out.where(F.col("valid") >= least)


def warp(px: DataFrame, v: str, inverse: Sequence[float], cubic: bool = False) -> DataFrame:
    """Resample onto the same grid: each target pixel asks for its source pixels, equi-joins meet them.

    `inverse` maps target to source positions. Bilinear needs 4 taps, cubic (a = -0.75) 16. v is the
    sum over valid taps with the absent ones as 0, support the weight of the valid ones.
    """
    sx, sy = project(F.col("col"), F.col("row"), inverse)
    at = px.select(F.col("image_id"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.floor(sx).alias("x"), F.floor(sy).alias("y"), (sx - F.floor(sx)).alias("fx"), (sy - F.floor(sy)).alias("fy"))
    at = at.where("x is not null and y is not null")

    def weight(t: str, d: int) -> Column:
        if not cubic:
            return F.col(t) if d else 1 - F.col(t)
        u = F.abs(F.lit(float(d)) - F.col(t))
        a = -0.75
        near, far = ((a + 2) * u - (a + 3)) * u * u + 1, ((a * u - 5 * a) * u + 8 * a) * u - 4 * a
        return F.when(u <= 1, near).when(u < 2, far).otherwise(0.0)

    steps = (-1, 0, 1, 2) if cubic else (0, 1)
    taps = F.array(*[F.struct((F.col("y") + r).alias("row"), (F.col("x") + c).alias("col"), (weight("fy", r) * weight("fx", c)).alias("w")) for r in steps for c in steps])
    asked = at.select("image_id", "to_row", "to_col", F.inline(taps))
    source = px.where(F.col(v).isNotNull()).select(*AT, F.col(v).cast("double").alias("v"))
    met = asked.join(source, list(AT), "left")
    has = F.col("v").isNotNull()
    out = met.groupBy("image_id", "to_row", "to_col").agg(F.sum(F.when(has, F.col("w") * F.col("v")).otherwise(0.0)).alias("v"), F.sum(F.when(has, F.col("w")).otherwise(0.0)).alias("support"))
    return out.select("image_id", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "v", "support")


def circles(edges: DataFrame, gx: str, gy: str, radii: Sequence[int], least_edge: float, least_votes: int, cell: int) -> DataFrame:
    """Gradient Hough votes for circles: each edge pixel votes along its gradient, both ways, at every
    radius; of each cell of centres the circle with most votes stays (ties to smaller r, row, col)."""
    m = F.sqrt(F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy))
    strong = edges.withColumn("m", m).where(F.col("m") > least_edge)
    spots = F.array(*[F.struct(F.lit(r).alias("r"), F.floor(F.col("row") + s * r * F.col(gy) / F.col("m") + 0.5).alias("cy"), F.floor(F.col("col") + s * r * F.col(gx) / F.col("m") + 0.5).alias("cx")) for r in radii for s in (-1, 1)])
    votes = strong.select("image_id", F.inline(spots)).groupBy("image_id", "r", "cy", "cx").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least_votes)
    best = F.struct("votes", (-F.col("r")).alias("r"), (-F.col("cy")).alias("cy"), (-F.col("cx")).alias("cx"))
    top = votes.groupBy("image_id", F.floor(F.col("cy") / cell).alias("gy"), F.floor(F.col("cx") / cell).alias("gx")).agg(F.max(best).alias("b"))
    return top.select("image_id", (-F.col("b.cy")).alias("cy"), (-F.col("b.cx")).alias("cx"), (-F.col("b.r")).alias("r"), F.col("b.votes").alias("votes"))


def region_stats(found: DataFrame, px: DataFrame, v: str) -> DataFrame:
    """Statistics of the pixels inside each circle; circles ask for the pixels of their squares."""
    y, x = (F.explode(F.sequence(F.col(c) - F.col("r"), F.col(c) + F.col("r"))) for c in ("cy", "cx"))
    asked = found.withColumn("row", y).withColumn("col", x)
    asked = asked.where((F.col("row") - F.col("cy")) * (F.col("row") - F.col("cy")) + (F.col("col") - F.col("cx")) * (F.col("col") - F.col("cx")) <= F.col("r") * F.col("r"))
    met = asked.join(px.where(F.col(v).isNotNull()).select(*AT, F.col(v).alias("v")), list(AT))
    circle = ["image_id", "cy", "cx", "r"]
    g = met.groupBy(*circle).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("size"))
    g = g.join(percentiles(met, circle, "v", (0.25, 0.5, 0.75)).withColumnRenamed("p", "q"), circle)
    return g.select("image_id", "cy", "cx", "r", "mean", "std", "low", "high", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "size")


def orientation_descriptor(edges: DataFrame, gx: str, gy: str, points: DataFrame, patch: int = 48, cells: int = 4, bins: int = 6) -> DataFrame:
    """kp_id, cell, bin, v: magnitude-weighted orientation histograms around key points, of unit length.

    Every key point asks for the pixels of its patch; pixels and requests meet in an equi-join.
    """
    half, step = patch // 2, patch // cells
    side = F.sequence(F.lit(0), F.lit(patch - 1))
    asked = points.select("kp_id", "image_id", "y", "x", F.explode(side).alias("dy")).select("*", F.explode(side).alias("dx"))
    asked = asked.select("kp_id", "image_id", (F.col("y") - half + F.col("dy")).alias("row"), (F.col("x") - half + F.col("dx")).alias("col"), (F.floor(F.col("dy") / step) * cells + F.floor(F.col("dx") / step)).alias("cell"))
    share = (F.atan2(gy, gx) + F.pi()) / (2 * F.pi())
    e = edges.select(*AT, F.sqrt(F.col(gx) * F.col(gx) + F.col(gy) * F.col(gy)).alias("m"), F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin"))
    sums = asked.join(e, list(AT)).groupBy("kp_id", "cell", "bin").agg(F.sum("m").alias("s"))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("kp_id")))
    return sums.select("kp_id", "cell", "bin", length.alias("length"), "s").where("length > 0").select("kp_id", "cell", "bin", (F.col("s") / F.col("length")).alias("v"))


def image_stats(px: DataFrame, v: str) -> DataFrame:
    return px.groupBy("image_id").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def min_max(px: DataFrame, v: str, flat: float | None = 0.0) -> DataFrame:
    """Each image's own range stretched to 0..255; an image of one level gives `flat` (0 or NULL)."""
    p = px.groupBy("image_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    t = (F.col(v) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    return px.join(p, "image_id").select(*AT, F.when(F.col(v).isNotNull(), F.floor(F.coalesce(t, F.lit(flat).cast("double")) * 255 + 0.5)).alias("v"))
