"""Points, residuals and transforms as SQL expressions and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.operators.quantiles import percentiles

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def project(x: Column, y: Column, h: Sequence[float]) -> tuple[Column, Column]:
    """Homogeneous projection by a 3 x 3 matrix; NULL where the divisor vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) >= 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def residual(h: Sequence[float]) -> Column:
    px, py = project(F.col("x0"), F.col("y0"), h)
    return F.sqrt((px - F.col("x1")) * (px - F.col("x1")) + (py - F.col("y1")) * (py - F.col("y1")))


def point_rmse(m: DataFrame) -> DataFrame:
    dx, dy = F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")
    return m.groupBy("pair_id").agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def residual_stats(m: DataFrame, h: Sequence[float], inlier_px: float = 3.0, median: bool = True) -> DataFrame:
    """Per pair: moments of the reprojection errors, sub-pixel and inlier shares; one aggregate but for the median."""
    e = m.withColumn("e", residual(h))
    n = F.count("e")
    moments = e.groupBy("pair_id").agg(
        n.alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean"),
        F.max("e").alias("max"), F.min("e").alias("min"), F.stddev_pop("e").alias("std"),
        F.count_if(F.col("e") < 1).alias("subpixel"), (F.count_if(F.col("e") < inlier_px) / F.greatest(n, F.lit(1))).alias("inlier_ratio"),
    )
    if not median:
        return moments
    return moments.join(percentiles(e, ["pair_id"], "e", [0.5]).select("pair_id", F.col("p")[0].alias("median")), "pair_id", "left")


def residual_histogram(m: DataFrame, h: Sequence[float], bins: int = 20) -> DataFrame:
    """Counts of errors over [0, max(greatest error, 1)] per pair, the last bin closed on the right."""
    e = m.select("pair_id", residual(h).alias("e"))
    top = e.groupBy("pair_id").agg(F.greatest(F.max("e"), F.lit(1.0)).alias("top"))
    return e.join(top, "pair_id").groupBy("pair_id", F.least(F.floor(F.col("e") / F.col("top") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def decompose(h: Sequence[float]) -> tuple[Column, Column, Column, Column]:
    """Translation x and y, rotation in degrees and scale of a matrix given as literals or columns."""
    a, c = F.lit(h[0]), F.lit(h[3])
    return F.lit(h[2]), F.lit(h[5]), F.degrees(F.atan2(c, a)), F.sqrt(a * a + c * c)


def fit_similarity(m: DataFrame, rigid: bool = False) -> DataFrame:
    """Least-squares rotation, scale and shift per pair from sums alone (closed-form Kabsch in 2-D)."""
    s = m.groupBy("pair_id").agg(F.avg("x0").alias("mx"), F.avg("y0").alias("my"), F.avg("x1").alias("nx"), F.avg("y1").alias("ny"),
        F.covar_pop("x0", "x1").alias("sxx"), F.covar_pop("y0", "y1").alias("syy"), F.covar_pop("x0", "y1").alias("sxy"), F.covar_pop("y0", "x1").alias("syx"), (F.var_pop("x0") + F.var_pop("y0")).alias("var"))
    dot, cross = F.col("sxx") + F.col("syy"), F.col("sxy") - F.col("syx")
    theta = F.atan2(cross, dot)
    scale = F.lit(1.0) if rigid else F.sqrt(dot * dot + cross * cross) / F.nullif(F.col("var"), F.lit(0.0))
    s = s.withColumn("theta", theta).withColumn("scale", scale)
    c, d = F.col("scale") * F.cos("theta"), F.col("scale") * F.sin("theta")
    return s.select("pair_id", "scale", F.degrees("theta").alias("rotation"), (F.col("nx") - c * F.col("mx") + d * F.col("my")).alias("tx"), (F.col("ny") - d * F.col("mx") - c * F.col("my")).alias("ty"))


def fit_affine(m: DataFrame) -> DataFrame:
    """Six parameters per pair by least squares: covariances solve the 2 x 2 normal equations."""
    s = m.groupBy("pair_id").agg(F.avg("x0").alias("mx"), F.avg("y0").alias("my"), F.avg("x1").alias("nx"), F.avg("y1").alias("ny"), F.var_pop("x0").alias("vx"), F.var_pop("y0").alias("vy"), F.covar_pop("x0", "y0").alias("vxy"),
        F.covar_pop("x0", "x1").alias("xx"), F.covar_pop("y0", "x1").alias("yx"), F.covar_pop("x0", "y1").alias("xy"), F.covar_pop("y0", "y1").alias("yy"))
    det = F.nullif(F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy"), F.lit(0.0))
    solve = lambda p, q: ((F.col(p) * F.col("vy") - F.col(q) * F.col("vxy")) / det, (F.col(q) * F.col("vx") - F.col(p) * F.col("vxy")) / det)
    (a, b), (c, d) = solve("xx", "yx"), solve("xy", "yy")
    return s.select("pair_id", a.alias("a"), b.alias("b"), (F.col("nx") - a * F.col("mx") - b * F.col("my")).alias("c"), c.alias("d"), d.alias("e"), (F.col("ny") - c * F.col("mx") - d * F.col("my")).alias("f"))
