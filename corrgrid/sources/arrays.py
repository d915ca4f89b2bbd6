"""Arrays of labelled products as a Spark data source, `labelled_array`.

Reading plans strips of rows as partitions; a task reads only the byte ranges of its strip, so no task
holds an image and arrays may start at any byte. Filters on label, band and row are pushed: strips and
bands that they exclude are never read. Files are opened through pyarrow's file systems by URI.

Writing makes one product per row (name, rows, cols, values): tasks write the data files, the commit
writes the labels, so a job that fails leaves no product to be seen.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from corrgrid.operators.tiles import each, small_batches
from corrgrid.sources.products import ProductError, parse_label

#: Bytes of a strip at most (one row at least), and values of an emitted batch.
STRIP_BYTES, BATCH_VALUES = 32 << 20, 1 << 18
PIXELS = "label_path string, band int, row int, col int, v double"
_NAMES = [c.split(" ")[0] for c in PIXELS.split(", ")]
#: Fixed value: what stands for NULL in written arrays.
MISSING = -32768.0


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it; file: with any number of slashes is local."""
    if (m := re.match(r"file:/+", uri)) or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri[m.end() :] if m else uri
    return fs.FileSystem.from_uri(uri)


@dataclass
class Strip(InputPartition):
    """Rows [first, stop) of one product's array. bands: those to read, None for all."""

    label_path: str
    data: str
    dtype: str
    offset: int
    shape: list[int]
    axes: list[str]
    scale: float
    shift: float
    nodata: list[float]
    first: int
    stop: int
    bands: list[int] | None = None

    def ranges(self) -> Iterator[tuple[int, int, dict[str, int]]]:
        """(byte, values, place of the axes before the rows) of the ranges that hold the strip."""
        at, size = self.axes.index("row"), np.dtype(self.dtype).itemsize
        inner = math.prod(self.shape[at + 1 :])
        for outer in np.ndindex(*self.shape[:at]):
            place = dict(zip(self.axes, map(int, outer), strict=False))
            if "band" in place and self.bands is not None and place["band"] not in self.bands:
                continue
            block = int(np.ravel_multi_index(outer, self.shape[:at])) if outer else 0
            yield self.offset + (block * self.shape[at] + self.first) * inner * size, (self.stop - self.first) * inner, place

    @property
    def bytes(self) -> int:
        return sum(n for _, n, _ in self.ranges()) * np.dtype(self.dtype).itemsize

    def read(self) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.data)
        at, rows = self.axes.index("row"), self.stop - self.first
        inner = self.axes[at + 1 :]
        with system.open_input_file(path) as f:
            for start, n, place in self.ranges():
                raw = np.frombuffer(f.read_at(n * np.dtype(self.dtype).itemsize, start), self.dtype)
                if len(raw) < n:
                    raise ProductError(f"{self.data} ends before byte {start + n * raw.itemsize}")
                grid = raw.reshape([rows, *self.shape[at + 1 :]])
                if "band" in inner and self.bands is not None:
                    grid = np.take(grid, self.bands, axis=1 + inner.index("band"))
                step = max(1, BATCH_VALUES // max(1, grid[0].size))
                for a in range(0, rows, step):
                    yield self.batch(grid[a : a + step].astype(float), self.first + a, inner, place)

    def batch(self, v: np.ndarray, first: int, inner: list[str], place: dict[str, int]) -> pa.RecordBatch:
        index = dict(zip(["row", *inner], np.indices(v.shape, np.int32).reshape(v.ndim, -1), strict=True))
        index["row"] = index["row"] + np.int32(first)
        if "band" in index and self.bands is not None:
            index["band"] = np.array(self.bands, np.int32)[index["band"]]
        v = v.ravel()
        bad = ~np.isfinite(v) | np.isin(v, self.nodata)
        with np.errstate(all="ignore"):
            v = v * self.scale + self.shift
        columns = [index.get(c, np.full(len(v), place.get(c, 0), np.int32)) for c in ("band", "row", "col")]
        return pa.RecordBatch.from_arrays([pa.array([self.label_path]).take(pa.array(np.zeros(len(v), np.int32))), *map(pa.array, columns), pa.array(v, mask=bad | ~np.isfinite(v))], _NAMES)


def strips(label_path: str, product: dict[str, Any], data: str, rows: tuple[int, int] | None = None, bands: list[int] | None = None) -> list[Strip]:
    """The strips of one product; a data file shorter than its label says is a ProductError.

    Axes named Line, Sample and Band may come in any order; other names count as band (of three), line
    and sample in the order given.
    """
    shape = [int(n) for n in product["shape"]]
    names = [{"line": "row", "sample": "col", "band": "band"}.get(n.lower(), n) for n in product["axis_names"]]
    if sorted(names) not in (["col", "row"], ["band", "col", "row"]):
        names = ["row", "col"] if len(shape) == 2 else ["band", "row", "col"]
    size, offset = np.dtype(product["dtype"]).itemsize, int(product["byte_offset"])
    system, path = opened(data)
    total, need = system.get_file_info(path).size or 0, offset + math.prod(shape) * size
    if total < need:
        raise ProductError(f"{data} holds {total} bytes, its label says {need}")
    n_rows, n_bands = shape[names.index("row")], shape[names.index("band")] if "band" in names else 1
    if bands is not None:
        bands = sorted(b for b in set(bands) if 0 <= b < n_bands)
        if not bands:
            return []
    first, stop = max(0, rows[0]) if rows else 0, min(n_rows, rows[1]) if rows else n_rows
    step = max(1, STRIP_BYTES // (math.prod(shape) // max(1, n_rows) * size or 1))
    make = lambda a: Strip(label_path, data, product["dtype"], offset, shape, names, product["scaling_factor"], product["value_offset"], list(product["nodata"] or []), a, min(a + step, stop), bands)
    return [make(a) for a in range(first, stop, step)]


def beside(label: str, name: str) -> str:
    """The data file that a label names, in the label's folder; its name may differ in case."""
    system, path = opened(label)
    folder = path.rsplit("/", 1)[0]
    head = label[: len(label) - len(path)] if "://" in label and not label.startswith("file:") else ""
    if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
        return f"{head}{folder}/{name}"
    for found in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        if found.base_name.lower() == name.lower():
            return head + found.path
    raise ProductError(f"no data file {name} beside {label}")


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.rows, self.bands, self.labels = [0, 2**31], None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of row, and equality and lists of band and label; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            low, high = self.rows
            if isinstance(f, IsNotNull) and column in ("label_path", "band", "row", "col"):
                continue
            if column == "row" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                over = f.value + isinstance(f, GreaterThan)
                under = f.value + (not isinstance(f, LessThan))
                self.rows = [low if isinstance(f, LessThan | LessThanOrEqual) else max(low, over), high if isinstance(f, GreaterThan | GreaterThanOrEqual) else min(high, under)]
            elif column in ("band", "label_path") and isinstance(f, EqualTo | In):
                new = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = self.bands if column == "band" else self.labels
                new = new if held is None else new & held
                self.bands, self.labels = (new, self.labels) if column == "band" else (self.bands, new)
            else:
                if column == "row" and isinstance(f, In) and f.value:  # narrows, does not decide
                    self.rows = [max(low, min(f.value)), min(high, max(f.value) + 1)]
                yield f

    def found(self) -> Iterator[tuple[str, dict[str, Any], str]]:
        if "product" in self.options:
            product = json.loads(self.options["product"])
            yield product["label_path"], product, self.options["path"]
            return
        uri = self.options["path"]
        system, path = opened(uri)
        head = uri[: len(uri) - len(path)] if "://" in uri and not uri.startswith("file:") else ""
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise ProductError(f"no label or folder at {uri}")
        paths = [path] if info.type == fs.FileType.File else sorted(i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(".xml"))
        for p in paths:
            if self.labels is None or head + p in self.labels:
                with system.open_input_file(p) as f:
                    product = parse_label(f.read())
                yield head + p, product, beside(head + p, product["data_file"])

    def partitions(self) -> list[Strip]:
        if self.rows[0] >= self.rows[1]:
            return []
        bands = None if self.bands is None else list(self.bands)
        return [s for label, product, data in self.found() if self.labels is None or label in self.labels for s in strips(label, product, data, tuple(self.rows), bands)]

    def read(self, partition: Strip | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from partition.read()


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, int, int]]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex[:12], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        done = []
        for r in each(iterator):
            v = np.frombuffer(r["values"], "<f4").copy()
            if len(v) != r["rows"] * r["cols"]:
                raise ProductError(f"{r['name']}: {len(v)} values for {r['rows']} x {r['cols']}")
            v[~np.isfinite(v)] = MISSING
            # Named by the attempt: what a failed or repeated task leaves is never labelled.
            data = f"{r['name']}-{self.job}-{uuid.uuid4().hex[:8]}.img"
            with system.open_output_stream(f"{folder}/{data}") as f:
                f.write(v.tobytes())
            done.append((r["name"], data, r["rows"], r["cols"]))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(folder)):
                if i.base_name.endswith(".xml"):
                    system.delete_file(i.path)
        for m in messages:
            for name, data, rows, cols in m.names if m else []:
                with system.open_output_stream(f"{folder}/{name}.xml") as f:
                    f.write(label_text(data, rows, cols).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        for m in messages:
            for _, data, _, _ in m.names if m else []:
                system.delete_file(f"{folder}/{data}")


def label_text(data: str, rows: int, cols: int) -> str:
    axes = "".join(f"<Axis_Array><axis_name>{n}</axis_name><elements>{k}</elements><sequence_number>{i}</sequence_number></Axis_Array>" for i, (n, k) in enumerate((("Line", rows), ("Sample", cols)), 1))
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<Product_Observational><File_Area_Observational><File><file_name>{data}</file_name></File>
<Array_2D_Image><offset unit="byte">0</offset><axis_index_order>Last Index Fastest</axis_index_order>
<Element_Array><data_type>IEEE754LSBSingle</data_type></Element_Array>{axes}
<Special_Constants><missing_constant>{MISSING}</missing_constant></Special_Constants></Array_2D_Image>
</File_Area_Observational></Product_Observational>
"""


class LabelledArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelled_array"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make `labelled_array` known to the session, with pushed filters."""
    spark.dataSource.register(LabelledArrays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """label_path, band, row, col, v of a label or of all labels (*.xml) below a folder.

    Special constants and non-finite values are NULL, others scaled. A label that cannot be read, or a
    data file that is missing or too short, is an error.
    """
    register(spark)
    return spark.read.format("labelled_array").option("path", path).load()


def read_parsed(spark: SparkSession, product: dict[str, Any], data: str) -> DataFrame:
    """band, row, col, v of one product whose label is parsed already."""
    register(spark)
    strips(product["label_path"], product, data)  # errors before the job
    keep = {k: product[k] for k in ("label_path", "shape", "axis_names", "dtype", "byte_offset", "scaling_factor", "value_offset", "nodata")}
    return spark.read.format("labelled_array").option("path", data).option("product", json.dumps(keep)).load().drop("label_path")


def read_labelled(labels: DataFrame) -> DataFrame:
    """The pixels of a table of parsed labels (products.read_labels); strips are planned and read in tasks,
    for folders with more labels than one driver should open. Labels with an error give no rows."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(asdict(s)) for r in batch.to_pylist() for s in strips(r["label_path"], r, beside(r["label_path"], r["data_file"]))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["strip"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("strip").to_pylist():
                yield from Strip(**json.loads(s)).read()

    keep = labels.where("error is null").select("label_path", "data_file", "shape", "axis_names", "dtype", "byte_offset", "scaling_factor", "value_offset", "nodata")
    planned = keep.mapInArrow(plan, "strip string")
    return planned.repartition(F.xxhash64("strip")).mapInArrow(read, PIXELS)


def write_arrays(products: DataFrame, path: str, mode: str = "append") -> None:
    """One product per row (name, rows, cols, values: 32-bit little-endian floats, NaN for NULL) in a folder."""
    register(products.sparkSession)
    small_batches(products.sparkSession)
    products.select("name", "rows", "cols", "values").write.format("labelled_array").option("path", path).mode(mode).save()
