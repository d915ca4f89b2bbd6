"""Cells, thinning and uniformity of point sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.operators.points import KEY


def cell(v: Column, size: float, cells: int) -> Column:
    """Cell of a coordinate; points outside fall into the edge cells."""
    return F.least(F.greatest(F.floor(v * cells / size), F.lit(0)), F.lit(cells - 1))


def top_per_cell(m: DataFrame, size: float, cells: int, k: int) -> DataFrame:
    """The k most confident points of each cell of a grid, ties by the row key (grid NMS, quad-tree leaves)."""
    m = m.withColumn("cx", cell(F.col("x0"), size, cells)).withColumn("cy", cell(F.col("y0"), size, cells))
    w = Window.partitionBy("pair_id", "cx", "cy").orderBy(F.desc("confidence"), *KEY)
    return m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def quad_tree(m: DataFrame, size: float, depth: int = 6, capacity: int = 4, keep: int = 2000) -> DataFrame:
    """Quad-tree thinning: splitting until at most `capacity` points remain, at most `depth` times, keeps
    exactly the best `capacity` of each cell of the deepest grid; then the best `keep` per pair."""
    leaves = top_per_cell(m, size, 2**depth, capacity)
    w = Window.partitionBy("pair_id").orderBy(F.desc("confidence"), *KEY)
    return leaves.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def uniformity(m: DataFrame, footprint: DataFrame, size: float, cells: int = 8) -> DataFrame:
    """Coverage and normalised entropy over the cells whose footprint is at least half valid."""
    n = m.groupBy("pair_id", cell(F.col("x0"), size, cells).alias("cx"), cell(F.col("y0"), size, cells).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    n = n.join(footprint.where("valid >= 0.5").select("cx", "cy"), ["cx", "cy"])
    whole = n.withColumn("total", F.sum("n").over(Window.partitionBy("pair_id")))
    p = F.col("n") / F.col("total")
    usable = footprint.agg(F.count_if(F.col("valid") >= 0.5).alias("cells"))
    out = whole.groupBy("pair_id").agg(F.count(F.lit(1)).alias("used"), (-F.sum(p * F.ln(p))).alias("h")).join(F.broadcast(usable))
    return out.select("pair_id", (F.col("used") / F.col("cells")).alias("coverage"), F.when(F.col("cells") == 1, 1.0).otherwise(F.col("h") / F.ln("cells")).alias("entropy"))


def occupancy(m: DataFrame, size: float, cells: int = 8) -> DataFrame:
    """Share of cells used, entropy over log2(cells), variation over all cells, and a score of 0 to 100; points outside drop out."""
    inside = m.where((F.col("x0") >= 0) & (F.col("x0") < size) & (F.col("y0") >= 0) & (F.col("y0") < size))
    n = inside.groupBy("pair_id", cell(F.col("x0"), size, cells).alias("cx"), cell(F.col("y0"), size, cells).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("pair_id").agg(F.count(F.lit(1)).alias("used"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.log2("n")).alias("nlog"))
    every = float(cells * cells)
    entropy = (F.log2("total") - F.col("nlog") / F.col("total")) / F.log2(F.lit(every))
    mean = F.col("total") / every
    cv = F.sqrt(F.greatest(F.col("sq") / every - mean * mean, F.lit(0.0))) / mean
    occ = F.col("used") / every
    return s.select("pair_id", occ.alias("occupancy"), entropy.alias("entropy"), cv.alias("cv"), F.least(F.greatest(60 * entropy + 40 * occ, F.lit(0.0)), F.lit(100.0)).alias("score"))
