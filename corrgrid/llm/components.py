"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: of each node that an edge (u, v) touches and is not its component's smallest
    node, that smallest node. Edges are never gathered by node: each round takes minima per node,
    which the partial aggregate reduces first, and joins them back.
    """
    now = staged(edges.where("u <> v").select("u", "v").distinct())
    sign = None
    for _ in range(max_rounds):
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last, now, sign = now, staged(_small_star(_large_star(now))), new
        discard(last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
