"""From match ids to matches: key-point look-up, tiles that both images share, unions of scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def look_up(ids: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches (idx0, idx1, ...) with the points (idx, x, y) that they name on either side."""
    a = left.select(F.col("idx").alias("idx0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = right.select(F.col("idx").alias("idx1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return ids.join(a, "idx0").join(b, "idx1")


def _tiles(v: Column, size: int, step: int, count: int) -> tuple[Column, Column]:
    """First and last of the tiles [k step, k step + size), k below count, that hold a coordinate."""
    return F.greatest(F.floor((v - size) / step) + 1, F.lit(0)), F.least(F.floor(v / step), F.lit(count - 1))


def tile_union(m: DataFrame, side: int, size: int, overlap: int) -> DataFrame:
    """m once per tile that holds both ends, with ty and tx; overlaps are not removed.

    Tiles of both images share one frame, so the tiles of two ends meet by arithmetic, without a join.
    """
    step, count = size - overlap, max(1, -(-(side - overlap) // (size - overlap)))
    inside = (F.least("x0", "y0", "x1", "y1") >= 0) & (F.greatest("x0", "y0", "x1", "y1") < side)

    def shared(a: str, b: str) -> Column:
        (a0, a1), (b0, b1) = _tiles(F.col(a), size, step, count), _tiles(F.col(b), size, step, count)
        first, last = F.greatest(a0, b0), F.least(a1, b1)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    return m.where(inside).withColumn("ty", F.explode(shared("y0", "y1"))).withColumn("tx", F.explode(shared("x0", "x1")))


def scale_union(points: DataFrame, scales: Sequence[float], x: str, y: str) -> DataFrame:
    """points found at several scales of an image, in its full frame, with the scale."""
    at = points.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    return at.withColumns({x: F.col(x) / F.col("scale"), y: F.col(y) / F.col("scale")})


def align(reference: DataFrame, registered: DataFrame, v: str) -> DataFrame:
    """Pixels (row, col, v) of two images on one grid: row, col, ref, reg where both have a value."""
    a = reference.where(F.col(v).isNotNull()).select("row", "col", F.col(v).alias("ref"))
    b = registered.where(F.col(v).isNotNull()).select("row", "col", F.col(v).alias("reg"))
    return a.join(b, ["row", "col"])
