"""Transforms per image pair from sums of products, and their checks; robust.py has the robust fits.

A pair's points are never gathered: aggregates reduce them to a few dozen sums, and one small matrix
per pair is then solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.operators.points import fit_affine

#: Second-smallest over greatest eigenvalue below which points do not fix a transform.
DEGENERATE = 1e-13


def compose(h: Sequence[Column], g: Sequence[Column]) -> list[Column]:
    """The 3 x 3 product h g, row-major."""
    return [h[3 * i] * g[j] + h[3 * i + 1] * g[3 + j] + h[3 * i + 2] * g[6 + j] for i in range(3) for j in range(3)]


def determinant(h: Sequence[Column]) -> Column:
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def invert(h: Sequence[Column]) -> list[Column]:
    """The adjugate over the determinant; NULL where that is zero."""
    det = F.nullif(determinant(h), F.lit(0.0))
    minor = lambda a, b, c, d: (h[a] * h[d] - h[b] * h[c]) / det
    return [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Greater and smaller singular value of a 2 x 2 matrix."""
    q, det = a * a + b * b + c * c + d * d, a * d - b * c
    root = F.sqrt(F.greatest(q * q - 4 * det * det, F.lit(0.0)))
    return F.sqrt((q + root) / 2), F.sqrt(F.greatest((q - root) / 2, F.lit(0.0)))


def valid_transform(h: Sequence[Column], width: float, height: float, max_scale: float = 4.0) -> Column:
    """Orientation kept, both scales within [1 / max_scale, max_scale], corners before the horizon; NULL or NaN is invalid."""
    big, small = singular_values(h[0], h[1], h[3], h[4])
    corners = [h[6] * x + h[7] * y + h[8] > 0 for x in (0.0, width) for y in (0.0, height)]
    ok = (h[0] * h[4] - h[1] * h[3] > 0) & (big <= max_scale) & (small >= 1 / max_scale)
    for c in corners:
        ok = ok & c
    nan = F.lit(False)
    for x in h:
        nan = nan | F.isnan(x.cast("double"))
    return F.coalesce(ok & ~nan, F.lit(False))


def _normalised(m: DataFrame) -> DataFrame:
    """Points about their pair's centres, in units of their spread (p, q from x0, y0; u, v from x1, y1)."""
    frame = m.groupBy("pair_id").agg(*[F.avg(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")], F.sqrt(F.var_pop("x0") + F.var_pop("y0")).alias("s0"), F.sqrt(F.var_pop("x1") + F.var_pop("y1")).alias("s1"), F.count(F.lit(1)).alias("n_points"))
    j = m.join(frame, "pair_id")
    unit = lambda c, s: (F.col(c) - F.col(f"c_{c}")) / F.nullif(F.col(s), F.lit(0.0))
    return j.withColumn("p", unit("x0", "s0")).withColumn("q", unit("y0", "s0")).withColumn("u", unit("x1", "s1")).withColumn("v", unit("y1", "s1"))


_FRAME = ("c_x0", "c_y0", "c_x1", "c_y1", "s0", "s1")


def _denormalise(g: np.ndarray, f: Sequence[float]) -> np.ndarray:
    cx, cy, dx, dy, s0, s1 = f
    t0 = np.array([[1 / s0, 0, -cx / s0], [0, 1 / s0, -cy / s0], [0, 0, 1]])
    return np.array([[s1, 0, dx], [0, s1, dy], [0, 0, 1]]) @ g @ t0


def _solve_dlt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, sums, f in zip(*(batch.column(c).to_pylist() for c in ("n", "sums", "frame")), strict=True):
            h = None
            if n >= 4 and None not in sums and None not in f:
                s, su, sv, sq = (np.array(sums[6 * k : 6 * k + 6])[[0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(3, 3) for k in range(4))
                z = np.zeros((3, 3))
                values, axes = np.linalg.eigh(np.block([[s, z, -su], [z, s, -sv], [-su, -sv, sq]]))
                if values[1] > DEGENERATE * values[-1]:
                    g = _denormalise(axes[:, 0].reshape(3, 3), f)
                    h = (g / g[2, 2]).ravel().tolist() if abs(g[2, 2]) > 1e-12 else None
            out.append(h)
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), batch.column("n"), pa.array(out, pa.list_(pa.float64()))], ["pair_id", "n", "h"])


def fit_homography(m: DataFrame) -> DataFrame:
    """pair_id, n, h (3 x 3, row-major): the normalised direct linear transform.

    A^T A is built from 24 sums per pair. Fewer than four points, or points that leave more than one
    solution, give NULL.
    """
    basis = [F.lit(1.0), F.col("p"), F.col("q")]
    mono = [basis[i] * basis[j] for i, j in ((1, 1), (1, 2), (1, 0), (2, 2), (2, 0), (0, 0))]
    weights = [F.lit(1.0), F.col("u"), F.col("v"), F.col("u") * F.col("u") + F.col("v") * F.col("v")]
    sums = [F.sum(w * b) for w in weights for b in mono]
    g = _normalised(m).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"), F.array(*[F.first(c) for c in _FRAME]).alias("frame"))
    return g.mapInArrow(_solve_dlt, "pair_id long, n long, h array<double>")


def project_by(h: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Projection by a matrix held in an array column."""
    at = [F.col(h)[i] for i in range(9)]
    w = at[6] * x + at[7] * y + at[8]
    w = F.when(F.abs(w) >= 1e-12, w)
    return (at[0] * x + at[1] * y + at[2]) / w, (at[3] * x + at[4] * y + at[5]) / w


def _solve_polynomial(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(size)
        for batch in batches:
            out = []
            for n, gram, right in zip(*(batch.column(c).to_pylist() for c in ("n", "gram", "right")), strict=True):
                fit = None
                if n >= size and None not in gram:
                    a = np.zeros((size, size))
                    a[upper] = gram
                    a = a + np.triu(a, 1).T
                    values = np.linalg.eigvalsh(a)
                    if values[0] > DEGENERATE * values[-1]:
                        fit = np.linalg.solve(a, np.array(right).reshape(2, size).T).T.ravel().tolist()
                out.append(fit)
            cols = [batch.column(c) for c in ("pair_id", "n", "frame")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.float64()))], ["pair_id", "n", "frame", "coef"])

    return run


def _basis(x: Column, y: Column, order: int) -> list[Column]:
    power = lambda c, k: F.lit(1.0) if k == 0 else c * power(c, k - 1)
    return [power(x, i) * power(y, d - i) for d in range(order + 1) for i in range(d, -1, -1)]


def fit_polynomial(m: DataFrame, order: int = 2) -> DataFrame:
    """pair_id, n, frame, coef: polynomials from target to source points, by normal equations from sums.

    The fit runs backwards (u, v to p, q) because a warp asks for source positions. Too few or
    degenerate points give NULL. predict_polynomial applies it.
    """
    basis = _basis(F.col("u"), F.col("v"), order)
    size = len(basis)
    gram = [F.sum(basis[i] * basis[j]) for i, j in zip(*np.triu_indices(size), strict=True)]
    right = [F.sum(b * F.col(t)) for t in ("p", "q") for b in basis]
    g = _normalised(m).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.array(*gram).alias("gram"), F.array(*right).alias("right"), F.array(*[F.first(c) for c in _FRAME]).alias("frame"))
    return g.mapInArrow(_solve_polynomial(size), "pair_id long, n long, frame array<double>, coef array<double>")


def predict_polynomial(m: DataFrame, fit: DataFrame, order: int = 2) -> DataFrame:
    """m with px, py: source positions that the pair's polynomials give for x1, y1."""
    f = lambda i: F.col("frame")[i]
    j = m.join(fit.select("pair_id", "frame", "coef"), "pair_id")
    basis = _basis((F.col("x1") - f(2)) / f(5), (F.col("y1") - f(3)) / f(5), order)
    value = lambda k: sum((F.col("coef")[k * len(basis) + i] * b for i, b in enumerate(basis)), F.lit(0.0))
    return j.withColumn("px", value(0) * f(4) + f(0)).withColumn("py", value(1) * f(4) + f(1)).drop("frame", "coef")


def held_out(key: Sequence[str], parts: int = 5) -> Column:
    """One in `parts` points, by a digest of its key: the same in every run and on every engine."""
    digest = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 1, 8)
    return F.conv(digest, 16, 10).cast("long") % parts == 0


def checkpoint_rmse(m: DataFrame, key: Sequence[str], least_test: int = 3, least_train: int = 8) -> DataFrame:
    """pair_id, n_test, rmse: affine fit on the rest, error on the held-out points; NULL with too few of either."""
    split = m.withColumn("test", held_out(key))
    train = split.where("not test")
    enough = train.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_train"))
    fit = fit_affine(train).join(enough, "pair_id")
    test = split.where("test").join(fit, "pair_id")
    dx, dy = F.col("a") * F.col("x0") + F.col("b") * F.col("y0") + F.col("c") - F.col("x1"), F.col("d") * F.col("x0") + F.col("e") * F.col("y0") + F.col("f") - F.col("y1")
    g = test.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"), F.first("n_train").alias("n_train"))
    ok = (F.col("n_test") >= least_test) & (F.col("n_train") >= least_train)
    return g.select("pair_id", "n_test", F.when(ok, F.col("rmse")).alias("rmse"))


def covariance_sums(vectors: DataFrame, v: str, bands: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance of a vector column, from one aggregate of bands squared numbers."""
    x = [F.col(v)[i].cast("double") for i in range(bands)]
    whole = vectors.where(F.forall(F.coalesce(v, F.array().cast("array<double>")), lambda b: b.isNotNull() & ~F.isnan(b.cast("double"))) & (F.size(v) >= bands))
    upper = list(zip(*np.triu_indices(bands), strict=True))
    row = whole.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in upper]).alias("cov")).first()
    cov = np.zeros((bands, bands))
    if row["n"]:
        for (i, j), c in zip(upper, row["cov"], strict=True):
            cov[i, j] = cov[j, i] = c
    return row["n"], np.array(row["mean"] if row["n"] else [0.0] * bands, float), cov


def first_component(vectors: DataFrame, v: str, bands: int, standardise: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights (sum not negative), share of the variance, and means; needs more than `bands` rows."""
    n, mean, cov = covariance_sums(vectors, v, bands)
    if n < bands + 1:
        raise ValueError(f"{n} whole vectors do not fix {bands} bands")
    scale = np.sqrt(np.diag(cov)) if standardise else np.ones(bands)
    scale[scale == 0] = 1
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    top = axes[:, -1] if axes[:, -1].sum() >= 0 else -axes[:, -1]
    return top / scale, float(values[-1] / max(values.sum(), 1e-300)), mean


def project_component(vectors: DataFrame, v: str, weights: np.ndarray, mean: np.ndarray) -> DataFrame:
    """vectors with pc1; NULL where a band is missing."""
    total = sum((float(w) * F.col(v)[i].cast("double") for i, w in enumerate(weights)), F.lit(-float(weights @ mean)))
    return vectors.withColumn("pc1", total)
