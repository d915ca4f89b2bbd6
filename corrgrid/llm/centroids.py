"""Exact integer k-means with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its centroid, lower bounds for its next nearest
centroids, and one remainder bound for all others. When centroids move, the bounds move with them by
the triangle inequality. A vector whose upper bound stays below all lower bounds is not touched; else
its own distance is made exact, then only stored centroids whose bound does not exceed it are
rescanned, and all centroids only if the remainder bound does not clear it either. Fewer bounds are
stored once no vector needs the last of them. Distances are compared as integers, so the result is
that of plain k-means.

A round is one pass over the staged table of vectors and bounds; the new centroids follow from the
sums of the vectors that changed their centroid, added up per task. Only k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import discard, staged
from corrgrid.llm.topk import usable

#: Integer components up to this keep squared distances within 64 bits; up to SMALL doubles hold them exactly.
MOST, SMALL = 2**27, 2**20
#: Relative and absolute slack of every bound, far above the rounding of a few additions.
SLACK = 1e-9
STATE = "vec_id long, v array<int>, cluster int, was int, upper double, near array<int>, low array<double>, rest double, scans int, deep int"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, as exact integers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= SMALL:
        v, c = v.astype(float), c.astype(float)
    d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    return d.astype(np.int64)


def paired(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return (d * d).sum(axis=1)


class Bounds:
    """Clusters and bounds of a batch of vectors (int64 rows)."""

    def __init__(self, v: np.ndarray, n_bounds: int) -> None:
        n = len(v)
        self.v, self.cluster, self.upper, self.rest = v, np.full(n, -1), np.full(n, np.inf), np.zeros(n)
        self.near, self.low = np.zeros((n, n_bounds), np.int64), np.zeros((n, n_bounds))
        self.scans, self.deep = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def keep(self, n_bounds: int) -> None:
        """Store the n_bounds nearest bounds only; the others join the remainder bound."""
        if self.low.shape[1] > n_bounds:
            order = np.argsort(self.low, axis=1, kind="stable")
            self.low, self.near = np.take_along_axis(self.low, order, 1), np.take_along_axis(self.near, order, 1)
            self.rest = np.minimum(self.rest, self.low[:, n_bounds])
            self.low, self.near = self.low[:, :n_bounds].copy(), self.near[:, :n_bounds].copy()

    def scan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """All centroids: the nearest, the next ones and the remainder."""
        b = self.low.shape[1]
        d = distances(self.v[rows], c)
        order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
        root = np.sqrt(np.take_along_axis(d, order, 1))
        self.cluster[rows], self.upper[rows] = order[:, 0], root[:, 0]
        self.near[rows], self.low[rows] = order[:, 1 : b + 1], root[:, 1 : b + 1]
        self.rest[rows] = root[:, b + 1] if root.shape[1] > b + 1 else np.inf
        self.scans[rows] += len(c)

    def unclear(self, rows: np.ndarray) -> np.ndarray:
        """Rows whose upper bound does not stay below every lower bound."""
        least = np.minimum(self.low[rows].min(axis=1, initial=np.inf), self.rest[rows])
        return rows[self.upper[rows] * (1 + SLACK) + SLACK >= least]

    def move(self, c: np.ndarray, shift: np.ndarray) -> None:
        """Follow centroids that moved by `shift`, and restore every vector's nearest centroid."""
        shift = shift * (1 + SLACK)
        self.upper += shift[self.cluster]
        self.low -= shift[self.near]
        self.rest -= shift.max(initial=0)
        rows = self.unclear(np.arange(len(self.v)))
        self.upper[rows] = np.sqrt(paired(self.v[rows], c[self.cluster[rows]]))
        self.scans[rows] += 1
        rows = self.unclear(rows)
        reach = self.upper * (1 + SLACK) + SLACK
        far = reach[rows] >= self.rest[rows]
        self.scan(rows[far], c)
        rows = rows[~far]
        asked = self.low[rows] <= reach[rows, None]
        at, slot = np.nonzero(asked)
        found = paired(self.v[rows[at]], c[self.near[rows[at], slot]])
        self.low[rows[at], slot] = np.sqrt(found)
        self.scans[rows] += asked.sum(axis=1)
        self.deep[rows] = asked.sum(axis=1)
        d = np.full(asked.shape, np.iinfo(np.int64).max)
        d[at, slot] = found
        own = paired(self.v[rows], c[self.cluster[rows]])
        tied = np.where(d == d.min(axis=1, initial=np.iinfo(np.int64).max)[:, None], self.near[rows], len(c))
        best = tied.argmin(axis=1) if tied.shape[1] else np.zeros(len(rows), int)
        if not tied.shape[1]:
            return
        one = np.arange(len(rows))
        better = (d[one, best] < own) | ((d[one, best] == own) & (self.near[rows, best] < self.cluster[rows]))
        r, s = rows[better], best[better]
        new = self.near[r, s]
        self.near[r, s], self.low[r, s] = self.cluster[r], np.sqrt(own[better])
        self.cluster[r], self.upper[r] = new, np.sqrt(d[one, best][better])


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, b = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * b, pa.int32()), pa.array(values.ravel(), kind))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim).astype(np.int64)


def _round(rows: DataFrame, c: np.ndarray, shift: np.ndarray | None, n_bounds: int) -> DataFrame:
    """The staged table after one assignment to centroids c, which moved by shift (None: the first)."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch, dim)
            s = Bounds(v, n_bounds)
            if shift is None:
                s.scan(np.arange(len(v)), c)
                was = np.full(len(v), -1)
            else:
                s.cluster, s.upper, s.rest = (batch.column(x).to_numpy().copy() for x in ("cluster", "upper", "rest"))
                s.cluster = s.cluster.astype(np.int64)
                s.near, s.low = (batch.column(x).flatten().to_numpy().reshape(len(v), -1).copy() for x in ("near", "low"))
                was = s.cluster.copy()
                s.keep(n_bounds)
                s.move(c, shift)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(s.cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(s.upper), _lists(s.near, pa.int32()), _lists(s.low, pa.float64()), pa.array(s.rest), pa.array(s.scans, pa.int32()), pa.array(s.deep, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in STATE.split(", ")])

    return staged(rows.mapInArrow(run, STATE))


def _sums(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """What the vectors that changed their cluster add to each cluster's component sums and (last) count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = np.hstack([_vectors(batch, dim), np.ones((batch.num_rows, 1), np.int64)])
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy()
                for j in np.unique(at[at >= 0]):
                    total[j] += sign * v[at == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(k * (dim + 1), np.int64)
    for r in state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).collect():  # k * (dim + 1) numbers
        out[r["at"]] = r.x
    return out.reshape(k, dim + 1)


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, factor: int = 256, k: int = 40, rounds: int = 5, salt: str = "2", history: list[dict[str, int]] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector.

    Vectors that are null, have other than `dim` components or hold null, NaN or infinite ones take no
    part; components x become floor(factor * x). The start is the k vectors with the smallest SHA-256
    of "salt:id"; vectors with a null id come last there (equal hashes by id, then by components), and
    repeated rows count each. Fewer than k vectors make as many clusters; empty tables give no rows;
    further columns are ignored. Components beyond 2^27 in units of 1/factor raise an error, as
    distances no longer fit 64 bits. `history` receives each assignment's distance computations.
    """
    spark = vectors.sparkSession
    rows = vectors.where((F.size(vector_col) == dim) & usable(F.col(vector_col)))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * factor))
    too_long = F.exists(vector_col, lambda x: F.abs(x.cast("double")) * factor > MOST)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(too_long, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(scaled).cast("array<int>").alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.orderBy(digest.asc_nulls_last(), "vec_id", "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], OUT)
    k = len(seeds)
    c = np.array([r.v for r in seeds], np.int64).reshape(k, dim)
    n_bounds, least = min(k // 4, k - 1), min(k // 8, k - 1)
    totals, shift, state = np.zeros((k, dim + 1), np.int64), None, rows
    for turn in range(rounds + 1):
        new = _round(state, c, shift, n_bounds)
        if turn:
            discard(state)
        state = new
        deep, scans = state.agg(F.max("deep"), F.sum("scans")).first()
        if history is not None:
            history.append({"scans": scans, "bounds": n_bounds})
        if turn > 0:
            n_bounds = max(least, min(n_bounds, deep))
        if turn < rounds:
            totals += _sums(state, k, dim)
            count = totals[:, -1:]
            moved = np.where(count > 0, totals[:, :-1] // np.maximum(count, 1), c)
            shift, c = np.sqrt(paired(moved, c).astype(float)), moved

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = paired(_vectors(batch, dim), c[batch.column("cluster").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    out = staged(state.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"))
    discard(state)
    inertia = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    shown = [(j, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for j, d in inertia.items()]
    return out.join(F.broadcast(spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*[x.split(" ")[0] for x in OUT.split(", ")])


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """DuckDB SQL of the same clusters: one common table expression per assignment and per mean."""
    d = "list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c)"
    parts = [
        """v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, e) - 1 AS nr
            FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT nr::INTEGER AS cluster, e AS c FROM v WHERE nr < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT nr, arg_min(cluster, ({d}) * 64 + cluster) AS cluster FROM v, c{r} GROUP BY nr)")
        if r < rounds:
            parts += [
                f"m{r} AS MATERIALIZED (SELECT cluster, pos, floor(sum(x) / count(*)) AS m FROM (SELECT a.cluster, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS pos FROM a{r} a JOIN v USING (nr)) GROUP BY cluster, pos)",
                f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT cluster, list(m ORDER BY pos) AS c FROM m{r} GROUP BY cluster) n USING (cluster))",
            ]
    parts.append(f"d AS (SELECT v.vec_id, a.cluster, ({d})::BIGINT AS distance, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (nr) JOIN c{rounds} USING (cluster))")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d"
