"""Exact nearest neighbours of descriptors in blocks, ratio and mutual tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows per block of either side; a pair of blocks is one task's matrix product.
BLOCK = 4_096


def two_nearest(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each left vector its two nearest right ones by L2: id, nn, d1, d2 (ties to the smaller id).

    A matrix product finds the candidates, with a slack above its rounding; they are ranked by the
    lengths of the differences, so results do not depend on the blocks. Both sides are dealt into
    blocks; each pair of blocks keeps two per query, the merge keeps two in all. Vectors of one side
    must have one length.
    """
    one = lambda df: df.select(F.lit(0).cast("long").alias("pair_id"), F.col("id").cast("long").alias("id"), "v")
    return two_nearest_by_pair(one(left), one(right), block).drop("pair_id")


def _nearest_of_blocks(x: pa.Table, y: pa.Table) -> pa.Table:
    """The two best of a block of queries among a block of candidates."""
    ids, near, dist, pair = [], [], [], []
    if x.num_rows and y.num_rows:
        p, q = np.array(x["v"].to_pylist(), float), np.array(y["v"].to_pylist(), float)
        pp, qq = (p**2).sum(1), (q**2).sum(1)
        rough = pp[:, None] + qq[None] - 2 * p @ q.T
        second = np.partition(rough, min(1, len(q) - 1), axis=1)[:, min(1, len(q) - 1)]
        row, col = np.nonzero(rough <= (second + 1e-9 * (pp + qq.max() + 1e-300))[:, None])
        d, other = np.sqrt(((p[row] - q[col]) ** 2).sum(axis=1)), np.array(y["id"])[col]
        order = np.lexsort((other, d, row))
        row, d, other = row[order], d[order], other[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < 2
        pair, ids, near, dist = np.array(x["pair_id"])[row[best]], np.array(x["id"])[row[best]], other[best], d[best]
    return pa.table([pa.array(pair, pa.int64()), pa.array(ids, pa.int64()), pa.array(near, pa.int64()), pa.array(dist, pa.float64())], ["pair_id", "id", "nn", "d"])


def two_nearest_by_pair(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """two_nearest within each pair_id: pair_id, id, nn, d1, d2 of left vectors (pair_id, id, v). Each pair's sides
    are dealt into as many blocks as their sizes ask for; a pair without one side has no rows."""
    sized = lambda df, name: df.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = sized(left, "n_left").join(sized(right, "n_right"), "pair_id")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [F.col(c).alias(c) for c in ("pair_id", "id", "v")]  # columns of their own: both sides may come from one table
    a = left.join(sizes, "pair_id").select(*own, deal("n_left").alias("i"), copies("n_right").alias("j"))
    b = right.join(sizes, "pair_id").select(*own, deal("n_right").alias("j"), copies("n_left").alias("i"))
    best = a.groupBy("pair_id", "i", "j").cogroup(b.groupBy("pair_id", "i", "j")).applyInArrow(_nearest_of_blocks, "pair_id long, id long, nn long, d double")
    ranked = best.withColumn("rn", F.row_number().over(Window.partitionBy("pair_id", "id").orderBy("d", "nn"))).where("rn <= 2")
    one = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    return ranked.groupBy("pair_id", "id").agg(one(1, "nn").alias("nn"), one(1, "d").alias("d1"), one(2, "d").alias("d2"))


def ratio_test(nearest: DataFrame, ratio: float = 0.8) -> DataFrame:
    return nearest.where(F.col("d1") < ratio * F.col("d2"))


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Forward pairs whose target's nearest neighbour is the query again."""
    back = backward.select(F.col("id").alias("b_id"), F.col("nn").alias("b_nn"))
    return forward.join(back, (F.col("nn") == F.col("b_id")) & (F.col("id") == F.col("b_nn")), "left_semi")
