"""Sub-pixel refinement of matches by template correlation on tiled rasters.

Matches whose source points share a cell, and whose displacement is about the same, share one region of
the source and one of the reference, so that what is shuffled grows with the images and not with the
patches of all matches. Where a cell has few matches each has regions of its own, no larger than its
patches. Regions meet the tiles that they touch in an equi-join on the tile's key; a tile cuts out only
what is asked. Crowded tiles and regions are dealt over several tasks. Matches then meet the parts of
their regions, and one correlation surface per match gives the peak and, by a parabola through it and
its neighbours on each axis, its fraction.

Matches that share a region share their sums, too: for one displacement, one product of the two regions
and its sums over every patch serve all of them. A few matches sum their own products. Both add in the
same order, so a match's result depends neither on the others nor on the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corrgrid.operators.tiles import KEY, TILE, packed
from corrgrid.staging import staged

#: Regions that one task cuts out of one copy of a tile, and matches that meet one copy of a region.
CROWD = 20_000
#: Side of the cells whose matches share regions, and matches below which each has its own.
CELL, FEW = 256, 128
#: Places of a region whose product for one displacement takes as long as all products of one match.
SHARE = 10_000
#: Share of a patch's squares that its variance must reach for moments to give it.
CONTRAST = 1e-6
CELLS = ["image_id", "sy", "sx", "dy", "dx"]
#: A region is that of a cell, or of one match (own) of a cell with few.
REGION = ["cell", "own"]
_PART = [*((n, pa.int64()) for n in REGION), *((n, pa.int32()) for n in ("deals", "side", "row0", "col0", "rows", "cols")), ("data", pa.binary())]


def _ddl(fields: Sequence[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields)


def _parts(asked: DataFrame, tiles: DataFrame, side: int, half: int, tile: int) -> DataFrame:
    """What the tiles hold of each region: the rectangle of its points on one side and `half` more pixels around it."""
    ends = [(F.col(f"{end}_c{v}{side}") + by).alias(f"{'r' if v == 'y' else 'c'}{int(by > 0)}") for v in "yx" for end, by in (("low", -half), ("high", half + 1))]
    asked = asked.select("image_id", *REGION, "deals", *ends)
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile).cast("int"), F.floor((F.col(high) - 1) / tile).cast("int")))
    keyed = asked.select("*", reach("r0", "r1").alias("ty")).select("*", reach("c0", "c1").alias("tx"))
    crowd = keyed.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("copies"))
    keyed = keyed.join(crowd, KEY).withColumn("copy", F.pmod(F.xxhash64(*REGION), F.col("copies")).cast("int"))
    held = tiles.join(crowd, KEY).select(*KEY, "rows", "cols", "data", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))

    def cut(regions: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if regions.num_rows and found.num_rows:
            t = found.slice(0, 1).to_pylist()[0]
            a, top, left = np.frombuffer(t["data"], "<f4").reshape(t["rows"], t["cols"]), t["ty"] * tile, t["tx"] * tile
            for p in regions.to_pylist():
                r0, r1, c0, c1 = max(p["r0"], top), min(p["r1"], top + t["rows"]), max(p["c0"], left), min(p["c1"], left + t["cols"])
                if r0 < r1 and c0 < c1:
                    out.append({**{n: p[n] for n in (*REGION, "deals")}, "side": side, "row0": r0, "col0": c0, "rows": r1 - r0, "cols": c1 - c0, "data": packed(a[r0 - top : r1 - top, c0 - left : c1 - left])})
        return pa.Table.from_pylist(out, pa.schema(_PART))

    return keyed.groupBy(*KEY, "copy").cogroup(held.groupBy(*KEY, "copy")).applyInArrow(cut, _ddl(_PART))


def _joined(points: np.ndarray, parts: Sequence[dict], half: int) -> tuple[np.ndarray, np.ndarray]:
    """A region with room for all patches of its points (row, column), no data where no tile is, and its first row and column."""
    first = np.min([points.min(axis=0) - half, *((q["row0"], q["col0"]) for q in parts)], axis=0)
    last = np.max([points.max(axis=0) + half + 1, *((q["row0"] + q["rows"], q["col0"] + q["cols"]) for q in parts)], axis=0)
    a = np.full(last - first, np.nan)
    for q in parts:
        r, c = q["row0"] - first[0], q["col0"] - first[1]
        a[r : r + q["rows"], c : c + q["cols"]] = np.frombuffer(q["data"], "<f4").reshape(q["rows"], q["cols"])
    return a, first


def surface(template: np.ndarray, window: np.ndarray, centred: bool) -> np.ndarray:
    """Normalised correlation of the template at every offset in the window."""
    views = np.lib.stride_tricks.sliding_window_view(window, template.shape)
    t = template - template.mean() if centred else template
    w = views - views.mean(axis=(2, 3), keepdims=True) if centred else views
    scale = np.sqrt((t * t).sum() * (w * w).sum(axis=(2, 3)))
    with np.errstate(all="ignore"):
        return np.where(scale > 1e-12, (w * t).sum(axis=(2, 3)) / scale, -1.0)


def _box(flat: np.ndarray, t: int, step: int, op: np.ufunc = np.add, spare: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """op over t values `step` apart from every place of a flat array, as far as there are t. Runs of 1, 2, 4, ...
    values give it, shorter ones first; spare is room for three arrays of that length."""
    n, spare = len(flat) - (t - 1) * step, spare or [np.empty_like(flat) for _ in range(3)]
    level, whole, done, width = flat, None, 0, 1
    while True:
        if t & width:
            part = level[done * step : done * step + n]
            whole = part if whole is None else op(whole, part, out=spare[2][:n])
            done += width
        if 2 * width > t:
            return whole
        level = op(level[: len(level) - width * step], level[width * step :], out=spare[width.bit_length() % 2][: len(level) - width * step])
        width *= 2


def _total(p: np.ndarray) -> np.ndarray:
    """The sum over the first axis, added in the order of _box."""
    whole = None
    while len(p):
        if len(p) % 2:
            whole, p = p[0] if whole is None else whole + p[0], p[1:]
        p = p[0::2] + p[1::2]
    return whole


def _boxes(a: np.ndarray, t: int, op: np.ufunc = np.add) -> np.ndarray:
    """op over the t x t patch whose first value is at each place of the flattened array."""
    return _box(_box(a.ravel(), t, a.shape[1], op), t, 1, op)


def _shared(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, t: int, n: int) -> np.ndarray | None:
    """Sums of products of each t x t patch at p in a and the n x n patches from q on in b, by displacement, a column
    for each match; None where the matches' displacements are too many for their number."""
    far = q - p
    low = far.min(axis=0)
    far -= low
    order = np.lexsort(far.T)
    sizes = np.array(a.shape) + far.max(axis=0) + n - 1
    span = sizes - a.shape + 1
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(far[order], axis=0) != 0).any(axis=1)]))
    alike = dict(zip(map(tuple, far[order[starts]].tolist()), zip(starts.tolist(), [*starts[1:].tolist(), len(p)], strict=True), strict=True))
    wanted = np.zeros(span, bool)
    for y, x in alike:
        wanted[y : y + n, x : x + n] = True
    if wanted.sum() * a.size > SHARE * len(p):
        return None
    reach = np.full(sizes, np.nan)  # b from where the first place of a goes, no data beyond b
    (r0, c0), (r1, c1) = np.maximum(low, 0), np.minimum(low + sizes, b.shape)
    reach[r0 - low[0] : r1 - low[0], c0 - low[1] : c1 - low[1]] = b[r0:r1, c0:c1]
    product, down, *spare = (np.empty(a.size) for _ in range(5))
    found, place = np.empty((n * n, len(p))), (p[:, 0] * a.shape[1] + p[:, 1])[order]
    for y, x in np.argwhere(wanted).tolist():
        np.multiply(a, reach[y : y + a.shape[0], x : x + a.shape[1]], out=product.reshape(a.shape))
        summed = _box(_box(product, t, a.shape[1], spare=[*spare[:2], down]), t, 1, spare=spare)
        for k in range(n * n):
            if (run := alike.get((y - k // n, x - k % n))) is not None:
                found[k, run[0] : run[1]] = summed[place[run[0] : run[1]]]
    out = np.empty_like(found)
    out[:, order] = found
    return out


def _alone(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, t: int, n: int) -> np.ndarray:
    """The sums of _shared, match by match."""
    out = np.empty((n * n, len(p)))
    for i, ((y, x), (v, u)) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        views = np.lib.stride_tricks.sliding_window_view(b[v : v + t + n - 1, u : u + t + n - 1], (n, n))
        out[:, i] = _total(_total(a[y : y + t, x : x + t, None, None] * views)).ravel()
    return out


def _moments(x: np.ndarray, t: int, centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each t x t patch: sum (0 unless centred), sum of squares about its mean (or 0), all values equal, and whether
    the variance is too small a share of the squares for moments to give it."""
    squares, even = _boxes(x * x, t), _boxes(x, t, np.minimum) == _boxes(x, t, np.maximum)
    if not centred:
        return np.zeros_like(squares), squares, even, np.zeros_like(even)
    s = _boxes(x, t)
    about = np.where(even, 0.0, squares - s * s / t**2)
    return s, about, even, ~even & (about < CONTRAST * squares)


def _surfaces(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, t: int, n: int, centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """surface of each match (rows of n * n), and which have no data in a patch and which a template without variance.

    Moments give it; matches that have a patch without the contrast for that are taken apart.
    """
    at, to = p[:, 0] * a.shape[1] + p[:, 1], q[:, 0] * b.shape[1] + q[:, 1]
    window = to + np.add.outer(np.arange(n) * b.shape[1], np.arange(n)).reshape(-1, 1)
    hole = _boxes(np.isnan(a), t, np.logical_or)[at] | _boxes(np.isnan(b), t + n - 1, np.logical_or)[to]
    with np.errstate(all="ignore"):
        c = _shared(a, b, p, q, t, n)
        c = _alone(a, b, p, q, t, n) if c is None else c
        (s, tt, flat, poor), (w, ww, _, poor_b) = _moments(a, t, centred), _moments(b, t, centred)
        poor = poor[at] | _box(_box(poor_b, n, b.shape[1], np.logical_or), n, 1, np.logical_or)[to]
        if centred:
            c -= (s[at] / t**2) * w[window]
        scale = ww[window]
        scale *= tt[at]
        np.sqrt(scale, out=scale)
        c /= scale
        c[~(scale > 1e-12)] = -1.0
    c, flat = np.ascontiguousarray(c.T), flat[at]
    for i in np.flatnonzero(poor & ~hole & ~flat):
        (y, x), (v, u) = p[i], q[i]
        c[i] = surface(a[y : y + t, x : x + t], b[v : v + t + n - 1, u : u + t + n - 1], centred).ravel()
    return c, hole, flat


def _peaks(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The summits of the quadratics through 3 x 3 neighbourhoods (last two axes), at most one pixel from their centres."""
    gx, gy = (q[:, 1, 2] - q[:, 1, 0]) / 2, (q[:, 2, 1] - q[:, 0, 1]) / 2
    xx, yy, xy = q[:, 1, 2] - 2 * q[:, 1, 1] + q[:, 1, 0], q[:, 2, 1] - 2 * q[:, 1, 1] + q[:, 0, 1], (q[:, 2, 2] - q[:, 2, 0] - q[:, 0, 2] + q[:, 0, 0]) / 4
    det = xx * yy - xy * xy
    none = (det <= 0) | (xx >= 0)
    return tuple(np.where(none, 0.0, np.clip(up / det, -1, 1)) for up in (xy * gy - yy * gx, xy * gx - xx * gy))


def _fractions(c: np.ndarray, joint: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a pixel by which the peaks lie beside the centres of 3 x 3 neighbourhoods."""
    if joint:
        return _peaks(c)

    def bend(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
        curve = low - 2 * mid + high
        return np.where(curve < 0, np.clip(0.5 * (low - high) / curve, -0.5, 0.5), 0.0)

    return bend(c[:, 1, 0], c[:, 1, 1], c[:, 1, 2]), bend(c[:, 0, 1], c[:, 1, 1], c[:, 2, 1])


def refine(matches: DataFrame, source: DataFrame, reference: DataFrame, *, key: str = "m", radius: int = 8, search: int = 4, centred: bool = True, joint: bool = False, keep_fraction: bool = False, keep: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """key, rx, ry, shift, score, status and the columns `keep` of matches (key, image_id, x0, y0, x1, y1) on tables of tiles.

    The template of side 2 radius + 1 about the rounded source point is correlated at every offset of
    up to `search` pixels about the rounded reference point; rx, ry is the best offset with its
    fraction (at most half a pixel), plus with keep_fraction what rounding took from the source point.
    joint fits one quadratic with its mixed term instead of a parabola per axis, which is nearer the
    truth where a patch's texture runs aslant. centred takes the patches' means off first.
    status: refined; clipped (a patch reaches beyond its image or holds no data); flat (no variance);
    edge (the peak lies on the border of the search). All but refined keep x1, y1. Repeated or NULL
    keys are an error of the caller: a key names one match. Matches with a NULL or NaN coordinate are clipped.
    """
    at = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    xy, kept = ("x0", "y0", "x1", "y1"), [f"kept{i}" for i in range(len(keep))]
    m = matches.select(F.col(key).cast("long").alias("m"), F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("double").alias(c) for c in xy], *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    known = F.col("image_id").isNotNull()
    for c in xy:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    placed = m.where(known).select("*", *[at(f"{v}{i}").alias(f"c{v}{i}") for v in "yx" for i in (0, 1)])
    cell = [*[F.floor(F.col(f"c{v}0") / CELL).alias(f"s{v}") for v in "yx"], *[F.floor((F.col(f"c{v}1") - F.col(f"c{v}0")) / CELL + 0.5).alias(f"d{v}") for v in "yx"]]
    placed = placed.select("*", *cell)
    ends = [(end, f"c{v}{i}") for v in "yx" for i in (0, 1) for end in ("low", "high")]
    cells = staged(placed.groupBy(*CELLS).agg(F.count(F.lit(1)).alias("n"), *[(F.min if end == "low" else F.max)(c).alias(f"{end}_{c}") for end, c in ends]).withColumn("cell", F.monotonically_increasing_id()))
    few, deals = F.col("n") < FEW, F.ceil(F.col("n") / CROWD).cast("int").alias("deals")
    common = cells.where(~few).select("image_id", "cell", F.lit(0).cast("long").alias("own"), deals, *[f"{end}_{c}" for end, c in ends])
    single = placed.join(cells.where(few).select(*CELLS, "cell"), CELLS).select("image_id", "cell", F.col("m").alias("own"), F.lit(1).alias("deals"), *[F.col(c).alias(f"{end}_{c}") for end, c in ends])
    asked = common.unionByName(single)
    parts = _parts(asked, source, 0, radius, tile).unionByName(_parts(asked, reference, 1, radius + search, tile))
    parts = parts.select(*REGION, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "side", "row0", "col0", "rows", "cols", "data")
    whole = placed.join(cells.select(*CELLS, "cell", few.alias("few"), deals), CELLS).select("cell", F.when(F.col("few"), F.col("m")).otherwise(0).alias("own"), F.when(F.col("few"), 0).otherwise(F.pmod(F.xxhash64("m"), F.col("deals"))).cast("int").alias("deal"), "m", *xy, *kept)
    shape = StructType([*m.select("m", "x1", "y1", *kept).schema, *StructType.fromDDL("x double, y double, score double, status string")])

    def meet(points: pa.Table, found: pa.Table) -> pa.Table:
        held, t, n = found.to_pylist(), 2 * radius + 1, 2 * search + 1
        x0, y0, x1, y1 = (points.column(c).to_numpy() for c in xy)
        source_at, reference_at = (np.column_stack([np.floor(y + 0.5), np.floor(x + 0.5)]).astype(int) for x, y in ((x0, y0), (x1, y1)))
        x, y, score = (np.full(len(x0), np.nan) for _ in range(3))
        status = np.full(len(x0), "clipped", object)
        if len(x0):
            a, first_a = _joined(source_at, [q for q in held if q["side"] == 0], radius)
            b, first_b = _joined(reference_at, [q for q in held if q["side"] == 1], radius + search)
            c, hole, flat = _surfaces(a, b, source_at - radius - first_a, reference_at - radius - search - first_b, t, n, centred)
            best = c.argmax(axis=1)
            peak, py, px = c[np.arange(len(c)), best], best // n, best % n
            flat = (peak <= -1.0) | flat & centred
            edge = ~((0 < py) & (py < n - 1) & (0 < px) & (px < n - 1))
            status[~hole] = np.where(flat, "flat", np.where(edge, "edge", "refined"))[~hole]
            score[~hole & ~flat] = peak[~hole & ~flat]
            i = np.flatnonzero(~hole & ~flat & ~edge)
            around = (py[i, None] + np.repeat([-1, 0, 1], 3)) * n + px[i, None] + np.tile([-1, 0, 1], 3)
            with np.errstate(all="ignore"):
                fx, fy = _fractions(np.take_along_axis(c[i], around, axis=1).reshape(-1, 3, 3), joint)
            more = (x0 - source_at[:, 1], y0 - source_at[:, 0]) if keep_fraction else np.zeros((2, len(x0)))
            x[i], y[i] = reference_at[i, 1] + px[i] - search + fx + more[0][i], reference_at[i, 0] + py[i] - search + fy + more[1][i]
        there = status == "refined"
        return pa.table([*(points.column(c).combine_chunks() for c in ("m", "x1", "y1", *kept)), pa.array(x, mask=~there), pa.array(y, mask=~there), pa.array(score, mask=~there & (status != "edge")), pa.array(status, pa.string())], ["m", "x1", "y1", *kept, "x", "y", "score", "status"])

    found = whole.groupBy(*REGION, "deal").cogroup(parts.groupBy(*REGION, "deal")).applyInArrow(meet, shape)
    none = F.lit(None).cast("double")
    rest = m.where(~known).select("m", "x1", "y1", *kept, none.alias("x"), none.alias("y"), none.alias("score"), F.lit("clipped").alias("status"))
    found = found.unionByName(rest)
    shift = F.sqrt((F.col("x") - F.col("x1")) * (F.col("x") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y") - F.col("y1")))
    return found.select(F.col("m").alias(key), F.coalesce("x", "x1").alias("rx"), F.coalesce("y", "y1").alias("ry"), shift.alias("shift"), "score", "status", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])


def shift_stats(refined: DataFrame, *by: str) -> DataFrame:
    """Matches, how many were refined, and the mean and greatest shift (0 without any)."""
    value = lambda c: F.coalesce(c, F.lit(0.0))
    return refined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("shift").alias("refined"), value(F.avg("shift")).alias("mean_shift"), value(F.max("shift")).alias("max_shift"))
