"""Exact top-k inner products over norm-sorted blocks.

Vectors are cut into bands of descending length, bands into blocks of bounded size. The queries
first meet the band of the longest vectors, which gives each a lower bound of its k-th score; then
only those bands whose longest vector can still reach that bound by Cauchy-Schwarz. Every pair of a
candidate block and a query block is one task's work, so neither side is gathered or broadcast whole.
In a task candidates come in order of descending length. Both sides are rotated by the right singular
vectors of the corpus (from its dim x dim Gram matrix, summed over all rows), so that the first
coordinates carry most of a product; a partial sum plus the Cauchy-Schwarz bound of the two residuals,
or of the lengths alone, discards candidates that cannot reach the query's k-th score. What remains is
scored in exact integers. The last merge ranks what the blocks kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, broadcast_if_small, staged

#: Rows of a candidate block at least and at most, and of a query block; a pair of the largest takes about 300 MB.
#: Candidates are shuffled once per query block, and each candidate block sends k rows per query: large
#: blocks keep both small, while a small table is still spread over all cores.
LEAST_CANDIDATES, MOST_CANDIDATES, QUERIES = 2_048, 32_768, 4_096
#: Candidates scored between two updates of the k-th scores, and the share of rotated coordinates in the partial sum.
STEP, HEAD = 512, 4
#: Bands of length, and the shortest share of the rows that is the first of them.
BANDS = 16
#: Products below this are exact in doubles; longer vectors are multiplied as 64-bit integers.
EXACT = 2.0**52
LEAST = np.iinfo(np.int64).min + 1


def scaled(vector: Column, factor: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of v v^T over all rows: one dim x dim matrix per task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "x"])

    sums = vectors.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(dim * dim)
    for r in sums.collect():  # dim * dim numbers
        out[r["at"]] = r.x
    return out.reshape(dim, dim)


def _matrix(rows: list[list[int]], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _search(own: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k best (score, then smaller id) of one candidate block, as far as they reach the query's floor.
    own and rows tell the rows of queries and candidates apart: a query does not meet its own row."""
    order = np.lexsort((ids, -(c.astype(float) ** 2).sum(axis=1)))
    rows, ids, c = rows[order], ids[order], c[order]
    head = max(1, rotation.shape[1] // HEAD) if rotation.shape[1] else 0
    rq, rc = q @ rotation, c @ rotation
    q_norm, c_norm = np.sqrt((rq**2).sum(axis=1)), np.sqrt((rc**2).sum(axis=1))
    q_rest, c_rest = np.sqrt((rq[:, head:] ** 2).sum(axis=1)), np.sqrt((rc[:, head:] ** 2).sum(axis=1))
    slack = 1e-9 * (q_norm.max(initial=0) * c_norm.max(initial=0) + 1)
    exact = q_norm.max(initial=0) * c_norm.max(initial=0) < EXACT
    best_s = np.full((len(q), 0), 0, np.int64)
    best_i = np.full((len(q), 0), 0, np.int64)
    kth = floor.astype(float)
    for a in range(0, len(c), STEP):
        live = np.flatnonzero(q_norm * c_norm[a] + slack >= kth)  # lengths only fall from here on
        if not len(live):
            break
        b = min(a + STEP, len(c))
        bound = rq[live, :head] @ rc[a:b, :head].T + q_rest[live, None] * c_rest[None, a:b] + slack
        may = bound >= kth[live, None]
        keep = np.flatnonzero(may.any(axis=0))
        s = np.full((len(live), len(keep)), LEAST)
        if len(keep):
            full = np.rint(q[live].astype(float) @ c[a + keep].astype(float).T).astype(np.int64) if exact else q[live] @ c[a + keep].T
            ok = may[:, keep] & (rows[a + keep][None, :] != own[live, None])
            s[ok] = full[ok]
        new_s, new_i = np.full((len(q), len(keep)), LEAST), np.zeros((len(q), len(keep)), np.int64)
        new_s[live], new_i[:] = s, ids[a + keep][None, :]
        best_s, best_i = np.hstack([best_s, new_s]), np.hstack([best_i, new_i])
        top = np.lexsort((best_i, -best_s), axis=1)[:, :k]
        best_s, best_i = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_i, top, 1)
        if best_s.shape[1] == k:
            kth = np.maximum(kth, np.where(best_s[:, -1] > LEAST, best_s[:, -1].astype(float), -np.inf))
    for i in range(len(q)):
        real = best_s[i] >= max(floor[i], LEAST + 1)
        yield i, best_i[i][real], best_s[i][real]


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, factor: int = 1024, candidates: int | None = None, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id divisible by `every`) its k greatest inner products.

    Components x become floor(factor * x) in integers. Vectors that are null or hold null, NaN or
    infinite components, and rows with a null id, take no part. Equal scores go to the smaller id.
    A shorter vector counts as padded with zeros. Rows with equal ids are vectors of their own: each is
    a candidate of every other row, and each with a query's id is a query with ranks of its own. Empty
    tables give no rows; further columns are ignored. Scores must fit 64-bit integers; wider vectors
    are not told apart from overflow. `candidates` bounds a block's rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), factor).alias("v"), F.monotonically_increasing_id().alias("rid"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = staged(rows.withColumn("norm", norm))
    n, dim, n_queries = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.sum(F.when(F.col("id") % every == 0, 1))).first()
    dim, n_queries = dim or 0, n_queries or 0
    values, axes = np.linalg.eigh(gram(rows, dim)) if dim else (np.zeros(0), np.zeros((0, 0)))
    rotation = np.ascontiguousarray(axes[:, np.argsort(-values)])
    size = candidates or min(max(n // (4 * vectors.sparkSession.sparkContext.defaultParallelism), LEAST_CANDIDATES), MOST_CANDIDATES)
    query_blocks = max(1, -(-n_queries // queries))
    # Bands by approximate quantiles of the length; any cuts give the same result.
    cuts = sorted(set(rows.approxQuantile("norm", [1 - k / BANDS for k in range(1, BANDS)], 0.01)), reverse=True) if n else []
    band = sum((F.when(F.col("norm") < cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    banded = rows.withColumn("band", band)
    found = {r.band: r for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.max("norm").alias("longest")).collect()}  # at most BANDS rows
    bands = range(len(cuts) + 1)
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-found[b].members // size)) if b in found else 1) for b in bands]), F.col("band") + 1)
    c = banded.select(F.col("rid").alias("c_rid"), F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.col("band").alias("c_band"), F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("c_block"))
    q = rows.where(F.col("id") % every == 0).select("rid", "id", "v", "norm", F.pmod(F.xxhash64("rid"), F.lit(query_blocks)).cast("int").alias("q_block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            own, names = np.array(left["rid"]), np.array(left["id"])
            got = _search(own, _matrix(left["v"].to_pylist(), dim), np.array(right["c_rid"]), np.array(right["c_id"]), _matrix(right["c_v"].to_pylist(), dim), rotation, k, np.array(left["floor"], np.int64))
            kept = [(int(own[q]), int(names[q]), int(i), int(s)) for q, ids, scores in got for i, s in zip(ids, scores, strict=True)]
        columns = zip(*kept, strict=True) if kept else ((), (), (), ())
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["rid", "query_id", "vec_id", "score"])

    def search(asked: DataFrame) -> DataFrame:
        """The k best of each (query, floor, band) asked for. A block travels only to the query blocks that ask for its band."""
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        wanted = asked.select(F.col("band").alias("c_band"), F.col("q_block").alias("for_block")).distinct()
        sent = c.join(broadcast_if_small(wanted, query_blocks * BANDS, BROADCAST_IDS), "c_band")
        return asked.groupBy("band", "block", "q_block").cogroup(sent.groupBy("c_band", "c_block", "for_block")).applyInArrow(run, "rid long, query_id long, vec_id long, score long")

    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    first = staged(top(search(q.select("rid", "id", "v", F.lit(LEAST).alias("floor"), F.lit(0).alias("band"), "q_block"))).drop("rank"))
    kth = first.groupBy("rid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    slack = 1 - 1e-9
    floor = F.col("kth") * F.when(F.col("kth") > 0, slack).otherwise(1 / slack) - 1
    reached = F.filter(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(found[b].longest).alias("longest")) for b in bands if b in found and b]), lambda x: F.col("kth").isNull() | (F.col("norm") * x["longest"] >= floor))
    if not any(b in found and b for b in bands):
        return top(first).select("query_id", "rank", "vec_id", "score")
    rest = q.join(kth, "rid", "left").select("rid", "id", "v", F.coalesce("kth", F.lit(LEAST)).alias("floor"), "q_block", F.explode(F.transform(reached, lambda x: x["band"])).alias("band"))
    others = search(rest)
    return top(first.unionByName(others)).select("query_id", "rank", "vec_id", "score")
