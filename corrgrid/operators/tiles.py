"""Rasters as tables of binary tiles, and neighbourhood operators that exchange only tile borders.

A row is one tile of up to TILE x TILE values (32-bit little-endian floats, NaN for no data) with the
size of its image. A neighbourhood operator sends each tile to its own key and its borders to the
neighbours' keys: one exchange of the image plus 4 halo / TILE of it, whatever the kernel. Tasks take
one tile at a time from batches of bounded bytes and put one padded tile together at a time, so their
memory grows with neither the image nor the tiles of a task, and a large image is spread over as many
tasks as it has tiles. Kernels are NumPy functions of a padded tile.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256
#: Bytes of a batch of tiles that goes to a Python worker.
BATCH_BYTES = 4 << 20
KEY = ["image_id", "ty", "tx"]
HEAD = "image_id long, ty int, tx int, height int, width int, rows int, cols int"
_HEAD = [("image_id", pa.int64()), *((n, pa.int32()) for n in ("ty", "tx", "height", "width", "rows", "cols"))]
#: A kernel's view of one tile: the padded values and the halo's width.
Kernel = Callable[[np.ndarray, int], Sequence[np.ndarray]]


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<f4").tobytes()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at BATCH_BYTES: a row may be a whole tile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches as Python values, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def from_pixels(px: DataFrame, v: str, height: int, width: int, *, tile: int = TILE) -> DataFrame:
    """Tiles of a pixel table (image_id, row, col, v). Pixels without a row are no data, as NULL; of repeated
    positions one counts; rows beyond the image are left out. Tiles without any row do not exist."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image, ty, tx = (k.as_py() for k in key)
        a = np.full((min(tile, height - ty * tile), min(tile, width - tx * tile)), np.nan)
        a[table["row"].to_numpy() - ty * tile, table["col"].to_numpy() - tx * tile] = table["v"].to_numpy()
        return pa.Table.from_pylist([{"image_id": image, "ty": ty, "tx": tx, "height": height, "width": width, "rows": a.shape[0], "cols": a.shape[1], "data": packed(a)}], pa.schema([*_HEAD, ("data", pa.binary())]))

    inside = px.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    rows = inside.select(F.col("image_id").cast("long").alias("image_id"), F.floor(F.col("row") / tile).cast("int").alias("ty"), F.floor(F.col("col") / tile).cast("int").alias("tx"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(v).cast("double").alias("v"))
    return rows.groupBy(*KEY).applyInArrow(build, f"{HEAD}, data binary")


def to_pixels(tiles: DataFrame, *planes: str, tile: int = TILE) -> DataFrame:
    """image_id, row, col and one double per plane; no data is NULL."""
    planes = planes or ("data",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each(batches):
            row, col = (x.ravel() for x in np.mgrid[: r["rows"], : r["cols"]].astype(np.int32))
            values = [np.frombuffer(r[p], "<f4").astype(float) for p in planes]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), r["image_id"], np.int64)), pa.array(row + np.int32(r["ty"] * tile)), pa.array(col + np.int32(r["tx"] * tile)), *(pa.array(x, mask=np.isnan(x)) for x in values)], ["image_id", "row", "col", *planes])

    small_batches(tiles.sparkSession)
    return tiles.select(*KEY, "rows", "cols", *planes).mapInArrow(run, "image_id long, row int, col int, " + ", ".join(f"{p} double" for p in planes))


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Positions outside 0..n-1 reflected about the border pixels, which do not repeat."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * (n - 1))
    return np.where(at < n, at, 2 * (n - 1) - at)


def neighbourhood(tiles: DataFrame, halo: int, kernel: Kernel, planes: Sequence[str] = ("data",), *, reflect: bool = False, tile: int = TILE) -> DataFrame:
    """Tiles with the kernel's outputs as planes. The kernel sees each tile with `halo` more pixels on
    every side: those of its neighbours, and beyond the image its reflection or (reflect False) no data.
    Absent tiles are no data and stay absent. A halo may be wider than a tile."""
    reach = -(-halo // tile)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each(batches):
            out = []
            a = np.frombuffer(r["data"], "<f4").reshape(r["rows"], r["cols"])
            top, left = r["ty"] * tile, r["tx"] * tile
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    ty, tx = r["ty"] + dy, r["tx"] + dx
                    if ty < 0 or tx < 0 or ty * tile >= r["height"] or tx * tile >= r["width"]:
                        continue
                    # The part of this tile within the other's padded extent.
                    r0, r1 = max(top, ty * tile - halo), min(top + r["rows"], min((ty + 1) * tile, r["height"]) + halo)
                    c0, c1 = max(left, tx * tile - halo), min(left + r["cols"], min((tx + 1) * tile, r["width"]) + halo)
                    if r0 < r1 and c0 < c1:
                        out.append({"image_id": r["image_id"], "ty": ty, "tx": tx, "height": r["height"], "width": r["width"], "rows": r1 - r0, "cols": c1 - c0, "row0": r0, "col0": c0, "own": dy == dx == 0, "data": packed(a[r0 - top : r1 - top, c0 - left : c1 - left])})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([*_HEAD, ("row0", pa.int32()), ("col0", pa.int32()), ("own", pa.bool_()), ("data", pa.binary())]))

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        own = next((p for p in parts if p["own"]), None)
        schema = pa.schema([*_HEAD, *((p, pa.binary()) for p in planes)])
        if own is None:
            return pa.Table.from_pylist([], schema)
        top, left = own["row0"] - halo, own["col0"] - halo
        a = np.full((own["rows"] + 2 * halo, own["cols"] + 2 * halo), np.nan)
        for p in parts:
            r, c = p["row0"] - top, p["col0"] - left
            a[r : r + p["rows"], c : c + p["cols"]] = np.frombuffer(p["data"], "<f4").reshape(p["rows"], p["cols"])
        if reflect:
            rows, cols = (mirrored(start + np.arange(n), size) - start for start, n, size in ((top, a.shape[0], own["height"]), (left, a.shape[1], own["width"])))
            a = a[np.ix_(rows, cols)]
        values = dict(zip(planes, map(packed, kernel(a, halo)), strict=True))
        return pa.Table.from_pylist([{n: own[n] for n, _ in _HEAD} | values], schema)

    small_batches(tiles.sparkSession)
    parts = tiles.select(*HEAD.replace(" long", "").replace(" int", "").split(", "), "data").mapInArrow(send, f"{HEAD}, row0 int, col0 int, own boolean, data binary")
    return parts.groupBy(*KEY).applyInArrow(meet, HEAD + "".join(f", {p} binary" for p in planes))


def _taps(a: np.ndarray, halo: int, across: Sequence[float], down: Sequence[float]) -> np.ndarray:
    """A separable kernel at the tile's pixels."""
    k, j = len(across) // 2, len(down) // 2
    n, m = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
    rows = sum(w * a[:, halo - k + i : halo - k + i + m] for i, w in enumerate(across))
    return sum(w * rows[halo - j + i : halo - j + i + n] for i, w in enumerate(down))


#: Smoothing and derivative taps of the gradient kernels by side.
GRADIENT = {3: ((1, 2, 1), (-1, 0, 1)), 5: ((1, 4, 6, 4, 1), (-1, -2, 0, 2, 1))}


def _sobel(a: np.ndarray, halo: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    smooth, slope = GRADIENT[k]
    return _taps(a, halo, slope, smooth), _taps(a, halo, smooth, slope)


def sobel(tiles: DataFrame, k: int = 3, *, tile: int = TILE) -> DataFrame:
    """gx and gy with reflected borders, k = 3 or 5; NaN where a pixel of the neighbourhood is no data."""
    return neighbourhood(tiles, k // 2, partial(_sobel, k=k), ("gx", "gy"), reflect=True, tile=tile)


def _blur(a: np.ndarray, halo: int, taps: Sequence[float]) -> tuple[np.ndarray]:
    return (_taps(a, halo, taps, taps),)


def smooth(tiles: DataFrame, taps: Sequence[float], *, tile: int = TILE) -> DataFrame:
    """The same odd number of taps along rows and columns, with reflected borders."""
    return neighbourhood(tiles, len(taps) // 2, partial(_blur, taps=tuple(taps)), reflect=True, tile=tile)


@lru_cache(maxsize=16)
def chords(k: int) -> tuple[int, ...]:
    """Half widths, row by row, of the ellipse inscribed in a k x k square (k odd); -1 is an empty row."""
    r = k // 2
    return tuple(int(np.rint(r * math.sqrt(max(0.0, (r * r - d * d) / (r * r))))) if r else 0 for d in range(-r, r + 1))


def extreme(a: np.ndarray, half: Sequence[int], pick: np.ufunc) -> np.ndarray:
    """pick (np.fmin or np.fmax) over a shape given by the half widths of its rows, NaN taking no part.

    Extremes over 1, 2, 4, ... pixels of a row give those of every chord from two look-ups, and the rows
    of the shape are combined by shifts: the cost per pixel grows with the shape's height, not its area.
    """
    most, r = max(half), len(half) // 2
    level = np.pad(a, ((r, r), (most, most)), constant_values=np.nan)
    powers = [level]
    while (1 << len(powers)) <= 2 * most + 1:
        step = 1 << (len(powers) - 1)
        powers.append(pick(powers[-1][:, :-step], powers[-1][:, step:]))
    along = {}
    for w in set(half):
        length = 2 * w + 1
        j = length.bit_length() - 1
        p = powers[j]
        first, second = most - w, most + w - (1 << j) + 1
        along[w] = pick(p[:, first : first + a.shape[1]], p[:, second : second + a.shape[1]])
    out = None
    for i, w in enumerate(half):
        rows = along[w][i : i + a.shape[0]]
        out = rows if out is None else pick(out, rows)
    return out


def _morph(a: np.ndarray, halo: int, half: tuple[int, ...], steps: str, bias: bool) -> tuple[np.ndarray]:
    now, hole = a, np.isnan(a)
    for step in steps:
        now = extreme(now, half, np.fmin if step == "e" else np.fmax)
        now[hole] = np.nan
    if bias:
        now = np.clip(a - now + 128, 0, 255)
    inner = slice(halo, -halo or None)
    return (now[inner, inner],)


def _shaped(tiles: DataFrame, k: int, steps: str, shape: str, bias: bool, tile: int) -> DataFrame:
    if k < 1 or k % 2 == 0 or shape not in ("ellipse", "square"):
        raise ValueError("morphology takes an odd side and an ellipse or a square")
    half = chords(k) if shape == "ellipse" else (k // 2,) * k
    return neighbourhood(tiles, len(steps) * (k // 2), partial(_morph, half=half, steps=steps, bias=bias), tile=tile)


def erode(tiles: DataFrame, k: int, *, shape: str = "ellipse", times: int = 1, tile: int = TILE) -> DataFrame:
    """Least value over the shape, `times` in a row; no data and what lies beyond the image take no part."""
    return _shaped(tiles, k, "e" * times, shape, False, tile)


def dilate(tiles: DataFrame, k: int, *, shape: str = "ellipse", times: int = 1, tile: int = TILE) -> DataFrame:
    return _shaped(tiles, k, "d" * times, shape, False, tile)


def opening(tiles: DataFrame, k: int, *, shape: str = "ellipse", tile: int = TILE) -> DataFrame:
    return _shaped(tiles, k, "ed", shape, False, tile)


def closing(tiles: DataFrame, k: int, *, shape: str = "ellipse", tile: int = TILE) -> DataFrame:
    return _shaped(tiles, k, "de", shape, False, tile)


def illumination_bias(tiles: DataFrame, k: int = 51, *, tile: int = TILE) -> DataFrame:
    """The image less its opening by an ellipse, about 128, clipped to 0..255; no data stays no data."""
    return _shaped(tiles, k, "ed", "ellipse", True, tile)


