"""Robust transforms per image pair: adaptive hypotheses, refinement on inliers, regrowth.

Points are dealt once into blocks of bounded size, in coordinates about their pair's centres. After
that a pair is one row: its hypotheses are one array, which each of its blocks scores in one
projection, and a refinement step is one sum of small normal equations over its blocks. The number
of hypotheses follows from the confidence that one of them was free of outliers, at the share of
inliers seen so far; pairs that have not reached it get more. A pair of any size is spread over as
many tasks as it has blocks, and only votes and sums are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.operators.estimate import valid_transform
from corrgrid.operators.points import KEY, fit_affine, fit_similarity
from corrgrid.staging import discard, staged

#: Points of a block, and hypotheses of each further round for pairs that need more.
BLOCK, ROUNDS = 4_096, (64, 192, 768)
#: Points that fix a model, and the model's free parameters.
SAMPLE = {"homography": 4, "affine": 3, "similarity": 2}
#: Refinement steps before and after the inliers are chosen anew.
STEPS = (4, 3)
FRAME = ("cx0", "cy0", "cx1", "cy1", "s0", "s1")


def blocks(m: DataFrame, key: Sequence[str], size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Staged pairs (pair_id, n, frame) and blocks (pair_id, pts): points about their pair's centres, in units of their spread.

    Points with a NULL or non-finite coordinate are left out.
    """
    xy = ("x0", "y0", "x1", "y1")

    def finite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isfinite([batch.column(c).to_numpy(zero_copy_only=False) for c in xy]).all(axis=0)))

    # Tested in the tasks: as a filter it would be pushed down and repeat the coordinates' expressions.
    good = m.select(F.col("pair_id").cast("long").alias("pair_id"), F.xxhash64(*key).alias("k"), *[F.col(c).cast("double").alias(c) for c in xy]).mapInArrow(finite, "pair_id long, k long, x0 double, y0 double, x1 double, y1 double")
    spread = lambda a, b: F.sqrt(F.var_pop(a) + F.var_pop(b))
    frame = F.array(*[F.avg(c) for c in xy], spread("x0", "y0"), spread("x1", "y1"))
    pairs = staged(good.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), frame.alias("frame")))
    unit = lambda c, i, s: (F.col(c) - F.col("frame")[i]) / F.when(F.col("frame")[s] > 0, F.col("frame")[s]).otherwise(1.0)
    point = F.struct("k", *[unit(c, i, 4 + i // 2).alias(c) for i, c in enumerate(xy)])
    block = F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.ceil(F.col("n") / size))
    dealt = good.join(pairs, "pair_id").select("pair_id", block.alias("block"), point.alias("p"))
    return pairs, staged(dealt.groupBy("pair_id", "block").agg(F.collect_list("p").alias("pts")))  # about `size` points


def _points(column: pa.ListArray, i: int) -> np.ndarray:
    found = column[i].values
    return np.array([found.field(c).to_numpy() for c in ("x0", "y0", "x1", "y1")])


def _apply(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections by matrices h (k x 9) of n points: two k x n arrays."""
    p = np.vstack([x, y, np.ones_like(x)])
    a, b, w = h[:, 0:3] @ p, h[:, 3:6] @ p, h[:, 6:9] @ p
    with np.errstate(all="ignore"):
        return a / w, b / w


def _errors(h: np.ndarray, pts: np.ndarray) -> np.ndarray:
    u, v = _apply(h, pts[0], pts[1])
    return np.nan_to_num(np.hypot(u - pts[2], v - pts[3]), nan=np.inf, posinf=np.inf)


def matrix(model: str, p: np.ndarray) -> np.ndarray:
    if model == "similarity":
        return np.array([p[0], -p[1], p[2], p[1], p[0], p[3], 0, 0, 1])
    return np.concatenate([p, [1.0]] if model == "homography" else [p, [0.0, 0.0, 1.0]])


def parameters(model: str, h: np.ndarray) -> np.ndarray:
    h = h / h[8]
    return {"homography": h[:8], "affine": h[:6], "similarity": h[[0, 3, 2, 5]]}[model]


def jacobian(model: str, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives of the projected coordinates by the parameters (n x p each), and the coordinates."""
    w = h[6] * x + h[7] * y + h[8]
    u, v, o, i = (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w, np.zeros_like(x), np.ones_like(x)
    if model == "similarity":
        return np.column_stack([x, -y, i, o]), np.column_stack([y, x, o, i]), u, v
    ju, jv = [x / w, y / w, i / w, o, o, o], [o, o, o, x / w, y / w, i / w]
    if model == "homography":
        ju, jv = [*ju, -x * u / w, -y * u / w], [*jv, -x * v / w, -y * v / w]
    return np.column_stack(ju), np.column_stack(jv), u, v


def solve_sample(model: str, pts: np.ndarray) -> np.ndarray | None:
    """The transform through as many points as the model needs; None where they do not fix it."""
    x, y, u, v = pts
    o, i = np.zeros_like(x), np.ones_like(x)
    if model == "similarity":
        a, b = np.vstack([np.column_stack([x, -y, i, o]), np.column_stack([y, x, o, i])]), np.concatenate([u, v])
    elif model == "affine":
        a, b = np.vstack([np.column_stack([x, y, i, o, o, o]), np.column_stack([o, o, o, x, y, i])]), np.concatenate([u, v])
    else:
        a, b = np.vstack([np.column_stack([x, y, i, o, o, o, -u * x, -u * y]), np.column_stack([o, o, o, x, y, i, -v * x, -v * y])]), np.concatenate([u, v])
    if a.shape[0] != a.shape[1] or not np.isfinite(a).all() or np.linalg.cond(a) > 1e10:
        return None
    return matrix(model, np.linalg.solve(a, b))


def hypotheses(held: DataFrame, model: str, n: int, seed: int) -> DataFrame:
    """pair_id, hs: up to n matrices of each pair through samples of its points, chosen by hashes of their keys.

    A pair's points are dealt into samples in the order of their hashes, in another order again until
    there are n; each block sends only those points that may be dealt.
    """
    size = SAMPLE[model]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                k = batch.column("pts")[i].values.field("k").to_numpy()
                order = np.lexsort((k, _mixed(k, seed)))[: size * n]
                out.append([{"k": int(k[j]), "x": [float(c) for c in p]} for j, p in zip(order, _points(batch.column("pts"), i)[:, order].T, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(out, pa.list_(pa.struct([("k", pa.int64()), ("x", pa.list_(pa.float64()))])))], ["pair_id", "chosen"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("chosen").to_pylist():
                k, x = np.array([r["k"] for r in rows], np.int64), np.array([r["x"] for r in rows]).reshape(-1, 4)
                hs, turn = [], 0
                while len(rows) >= size and len(hs) < n and turn <= n:
                    order = np.lexsort((k, _mixed(k, seed + turn)))
                    for a in range(0, len(order) - size + 1, size):
                        h = solve_sample(model, x[order[a : a + size]].T)
                        if h is not None and len(hs) < n:
                            hs.append(h.tolist())
                    turn += 1
                out.append(hs)
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["pair_id", "hs"])

    sent = held.select("pair_id", "pts").mapInArrow(choose, "pair_id long, chosen array<struct<k:long,x:array<double>>>").select("pair_id", F.inline("chosen"))
    first = Window.partitionBy("pair_id").orderBy(F.xxhash64(F.lit(seed), "k"), "k", "x")
    few = sent.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= size * n)
    return few.groupBy("pair_id").agg(F.collect_list(F.struct("k", "x")).alias("chosen")).mapInArrow(deal, "pair_id long, hs array<array<double>>")  # size * n points


def _mixed(k: np.ndarray, seed: int) -> np.ndarray:
    """Keys in another order for each seed: a mixing of their 64 bits."""
    x = k.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _summed(rows: DataFrame, run: Callable[[np.ndarray, dict], np.ndarray], size: int, *columns: str) -> DataFrame:
    """pair_id, s: per pair the sums over its blocks of the `size` numbers that run makes of a block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = {c: batch.column(c).to_pylist() for c in columns}
            out = [run(_points(batch.column("pts"), i), {c: fields[c][i] for c in columns}).tolist() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(out, pa.list_(pa.float64()))], ["pair_id", "s"])

    parts = rows.select("pair_id", "pts", *columns).mapInArrow(task, "pair_id long, s array<double>")
    return parts.groupBy("pair_id").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s"))


def trials(share: float, size: int, confidence: float) -> float:
    """Hypotheses after which one was free of outliers with this confidence."""
    clean = min(max(share, 0.0), 1.0) ** size
    return math.inf if clean <= 0 else 1 if clean >= 1 else math.ceil(math.log(1 - confidence) / math.log1p(-clean))


def robust_fit(m: DataFrame, model: str = "homography", *, key: Sequence[str] = KEY, threshold: float = 3.0, least: int = 12, confidence: float = 0.999, rounds: Sequence[int] = ROUNDS, seed: int = 0, canvas: tuple[float, float] | None = None, max_scale: float = 4.0) -> DataFrame:
    """pair_id, n, inliers, h, rmse, trials, status of each pair; model is homography, affine or similarity.

    The best hypothesis is refined on its inliers (points nearer than `threshold` pixels) by damped
    Gauss-Newton steps; if the result has no fewer inliers they replace the old and it is refined on
    them. status: success; insufficient_matches (fewer points or inliers than `least`); error (no
    usable sample, or a homography that valid_transform refuses on the canvas). Pairs never fail the
    job. h maps x0, y0 to x1, y1, row-major, and is NULL unless a transform was found. Tables without
    points give no rows.
    """
    size = SAMPLE[model]
    pairs, held = blocks(m, key)
    state = staged(pairs.select("pair_id", "n", "frame", F.lit(None).cast("array<double>").alias("h"), F.lit(0.0).alias("votes"), F.lit(0).alias("trials"), (F.col("n") >= max(size, least)).alias("open")))

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep the better of the best so far and the best of this round; decide who needs more."""
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                hs = r.pop("hs") or []
                s = (r.pop("s") or [])[: len(hs)]
                if s and max(s) > r["votes"]:
                    r["votes"] = max(s)
                    r["h"] = hs[s.index(max(s))]
                if r["open"]:
                    r["trials"] += len(hs)
                    r["open"] = bool(hs) and r["trials"] < trials(r["votes"] / r["n"], size, confidence)
            yield pa.RecordBatch.from_pylist(rows, batch.schema.remove(batch.schema.get_field_index("s")).remove(batch.schema.get_field_index("hs")))

    shape = "pair_id long, n long, frame array<double>, h array<double>, votes double, trials int, open boolean"
    unit = lambda frame: threshold / (frame[5] or 1.0)
    for turn, n in enumerate(rounds):
        asked = state.where("open").select("pair_id", "frame")
        if asked.isEmpty():
            break
        hyps = staged(hypotheses(held.join(asked, "pair_id", "left_semi"), model, n, seed + 1000 * turn))

        def score(pts: np.ndarray, r: dict, n: int = n) -> np.ndarray:
            votes = np.zeros(n)
            if r["hs"]:
                found = (_errors(np.array(r["hs"]), pts) < unit(r["frame"])).sum(axis=1)
                votes[: len(found)] = found
            return votes

        votes = _summed(held.join(hyps.join(asked, "pair_id"), "pair_id"), score, n, "hs", "frame")
        moved = state.join(hyps, "pair_id", "left").join(votes, "pair_id", "left").select(*[c.split(" ")[0] for c in shape.split(", ")], "hs", "s")
        last, state = state, staged(moved.mapInArrow(update, shape))
        discard(last)
        discard(hyps)

    p = {"homography": 8, "affine": 6, "similarity": 4}[model]
    upper = np.triu_indices(p)

    def equations(pts: np.ndarray, r: dict) -> np.ndarray:
        """J^T J, J^T r and the squared error of h on the inliers of `base`, and the inliers of both."""
        h, limit = np.array(r["h"]), unit(r["frame"])
        near = _errors(np.array([r["base"]]), pts)[0] < limit
        x, y, u, v = pts[:, near]
        ju, jv, pu, pv = jacobian(model, h, x, y)
        du, dv = u - pu, v - pv
        jtj = ju.T @ ju + jv.T @ jv
        return np.concatenate([jtj[upper], ju.T @ du + jv.T @ dv, [(du * du + dv * dv).sum(), near.sum(), (_errors(h[None], pts)[0] < limit).sum()]])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                s = np.array(r.pop("s"))
                jtj = np.zeros((p, p))
                jtj[upper] = s[: len(upper[0])]
                jtj = jtj + np.triu(jtj, 1).T
                cost = s[-3]
                if np.isfinite(cost) and cost <= r["cost"]:
                    r["good"], r["cost"] = r["h"], float(cost)
                    damped = jtj + np.diag(1e-9 * np.diag(jtj) + 1e-300)
                    with np.errstate(all="ignore"):
                        try:
                            delta = np.linalg.solve(damped, s[len(upper[0]) : len(upper[0]) + p])
                        except np.linalg.LinAlgError:
                            delta = np.zeros(p)
                else:  # half the way back to the last good one
                    delta = (parameters(model, np.array(r["good"])) - parameters(model, np.array(r["h"]))) / 2
                new = matrix(model, parameters(model, np.array(r["h"])) + delta)
                r["h"] = new.tolist() if np.isfinite(new).all() else r["good"]
            yield pa.RecordBatch.from_pylist(rows, batch.schema.remove(batch.schema.get_field_index("s")))

    shape = "pair_id long, frame array<double>, base array<double>, h array<double>, good array<double>, cost double"
    names = [c.split(" ")[0] for c in shape.split(", ")]
    size_s = len(upper[0]) + p + 3
    measured = lambda now: _summed(held.join(now, "pair_id"), equations, size_s, "h", "base", "frame")
    now = staged(state.where("h is not null").select("pair_id", "frame", F.col("h").alias("base"), "h", F.col("h").alias("good"), F.lit(float("inf")).alias("cost")))
    for phase, steps in enumerate(STEPS):
        for _ in range(steps):
            last, now = now, staged(now.join(measured(now), "pair_id").select(*names, "s").mapInArrow(step, shape))
            discard(last)
        if phase == 0:  # inliers of the refined transform replace the first ones if they are no fewer
            grown = measured(now.withColumn("h", F.col("good"))).select("pair_id", (F.element_at("s", -1) >= F.element_at("s", -2)).alias("more"))
            chosen = F.when(F.col("more"), F.col("good")).otherwise(F.col("base"))
            again = now.join(grown, "pair_id").select("pair_id", "frame", chosen.alias("base"), F.col("good").alias("h"), "good", F.when(F.col("more"), float("inf")).otherwise(F.col("cost")).alias("cost"))
            last, now = now, staged(again)
            discard(last)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cx, cy, dx, dy, s0, s1 = r["frame"]
                s0, s1 = s0 or 1.0, s1 or 1.0
                h = np.array([[s1, 0, dx], [0, s1, dy], [0, 0, 1]]) @ np.array(r["good"]).reshape(3, 3) @ np.array([[1 / s0, 0, -cx / s0], [0, 1 / s0, -cy / s0], [0, 0, 1]])
                out.append((h / h[2, 2]).ravel().tolist() if abs(h[2, 2]) > 1e-15 and np.isfinite(h).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(out, pa.list_(pa.float64()))], ["pair_id", "h"])

    # The reported inliers are those that the transform was refined on.
    last = measured(now.withColumn("h", F.col("good"))).select("pair_id", F.element_at("s", -2).cast("long").alias("inliers"), F.element_at("s", -3).alias("squares"))
    found = now.select("pair_id", "frame", "good").mapInArrow(finish, "pair_id long, h array<double>").join(last, "pair_id")
    out = state.select("pair_id", "n", "frame", "trials").join(found, "pair_id", "left")
    ok = valid_transform([F.col("h")[i] for i in range(9)], *canvas, max_scale) if canvas and model == "homography" else F.lit(True)
    few = (F.col("n") < least) | (F.col("h").isNotNull() & (F.col("inliers") < least))
    status = F.when(few, "insufficient_matches").when(F.col("h").isNull() | ~ok, "error").otherwise("success")
    rmse = F.sqrt(F.col("squares") / F.col("inliers")) * F.col("frame")[5]
    return out.select("pair_id", "n", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"), "h", F.when(F.col("inliers") > 0, rmse).alias("rmse"), "trials", status.alias("status"))


def estimate_transform(m: DataFrame, method: str = "homography", *, key: Sequence[str] = KEY, threshold: float = 5.0) -> DataFrame:
    """pair_id, n, inliers, h, status by any of the methods: homography, affine (robust); rigid, similarity
    (all points, from sums); affine_all. Fewer than four points are insufficient_points; another name means homography."""
    n = m.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    if method in ("rigid", "similarity"):
        s = fit_similarity(m, rigid=method == "rigid")
        c, d = F.col("scale") * F.cos(F.radians("rotation")), F.col("scale") * F.sin(F.radians("rotation"))
        fit = s.select("pair_id", F.array(c, -d, F.col("tx"), d, c, F.col("ty"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"))
    elif method == "affine_all":
        s = fit_affine(m)
        a = [c for c in s.columns if c != "pair_id"]
        fit = s.select("pair_id", F.array(*[F.col(c) for c in a[:6]], F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"))
    else:
        fit = robust_fit(m, method if method == "affine" else "homography", key=key, threshold=threshold, least=4).select("pair_id", "h", "inliers")
    fit = fit if "inliers" in fit.columns else fit.withColumn("inliers", F.lit(None).cast("long"))
    out = n.join(fit, "pair_id", "left")
    whole = F.col("h").isNotNull() & ~F.exists(F.coalesce("h", F.array(F.lit(None).cast("double"))), lambda x: x.isNull() | F.isnan(x))
    status = F.when(F.col("n") < 4, "insufficient_points").when(~whole, "estimation_failed").otherwise("success")
    return out.select("pair_id", "n", "inliers", F.when(status == "success", F.col("h")).alias("h"), status.alias("status"))
