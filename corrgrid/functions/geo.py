"""Planetocentric geometry and composite scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: radius of the reference sphere in metres.
RADIUS_M = 1_737_400.0
DEGREE_M = math.pi * RADIUS_M / 180


def normalise_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def width_m(min_lon: Column, max_lon: Column, lat: Column) -> Column:
    return (max_lon - min_lon) * DEGREE_M * F.cos(F.radians(lat))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quality(corr: Column, ssim: Column, inlier: Column, uniformity: Column, subpixel: Column) -> Column:
    """Score of 0 to 100: 25 correlation, 25 SSIM, 20 inliers, 15 uniformity, 15 sub-pixel share."""
    return clip(25 * F.greatest(corr, F.lit(0.0)) + 25 * (ssim + 1) / 2 + 20 * inlier + 15 * uniformity / 100 + 15 * subpixel, 0, 100)
