"""Labelled raster products: XML labels beside raw arrays, read through Spark's own file systems.

Labels are parsed one per row wherever they lie; sources.arrays reads their arrays.
"""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgrid.functions.geo import normalise_longitude

#: Element types of arrays, the arrays that are read, tags of ground sampling distances by
#: priority, metres per unit, and the special constants.
DTYPES = {
    "UnsignedByte": "u1", "SignedByte": "i1",
    "UnsignedMSB2": ">u2", "UnsignedMSB4": ">u4", "UnsignedMSB8": ">u8", "SignedMSB2": ">i2", "SignedMSB4": ">i4", "SignedMSB8": ">i8",
    "UnsignedLSB2": "<u2", "UnsignedLSB4": "<u4", "UnsignedLSB8": "<u8", "SignedLSB2": "<i2", "SignedLSB4": "<i4", "SignedLSB8": "<i8",
    "IEEE754MSBSingle": ">f4", "IEEE754MSBDouble": ">f8", "IEEE754LSBSingle": "<f4", "IEEE754LSBDouble": "<f8",
}
ARRAYS = ("Array_2D", "Array_2D_Image", "Array_3D", "Array_3D_Image", "Array_3D_Spectrum")
GSD_TAGS = ("pixel_resolution_x", "pixel_resolution_y", "ground_sample_distance", "pixel_resolution", "spatial_resolution", "sample_resolution", "line_resolution", "pixel_scale")
UNITS_M = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001}
SPECIAL = ("missing_constant", "invalid_constant", "saturated_constant", "high_instrument_saturation", "high_representation_saturation", "low_instrument_saturation", "low_representation_saturation", "unknown_constant")
CORNERS = ("upper_left", "upper_right", "lower_left", "lower_right")

_CORNER = "struct<lon:double,lat:double>"
_BOX = "struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"
LABEL = f"label_path string, data_file string, byte_offset long, shape array<long>, axis_names array<string>, dtype string, scaling_factor double, value_offset double, nodata array<double>, gsd_m double, corners map<string,{_CORNER}>, bbox {_BOX}, instrument string, metadata map<string,double>, error string"
_ARROW = pa.schema([
    ("label_path", pa.string()), ("data_file", pa.string()), ("byte_offset", pa.int64()), ("shape", pa.list_(pa.int64())), ("axis_names", pa.list_(pa.string())), ("dtype", pa.string()),
    ("scaling_factor", pa.float64()), ("value_offset", pa.float64()), ("nodata", pa.list_(pa.float64())), ("gsd_m", pa.float64()),
    ("corners", pa.map_(pa.string(), pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))), ("bbox", pa.struct([(c, pa.float64()) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])),
    ("instrument", pa.string()), ("metadata", pa.map_(pa.string(), pa.float64())), ("error", pa.string()),
])


class ProductError(ValueError):
    """A label or an array that cannot be read."""


def number(text: str | None) -> float | None:
    """A finite number, plain or hexadecimal."""
    try:
        t = (text or "").strip()
        x = float(int(t, 16)) if t.lower().startswith("0x") else float(t)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def _wrapped(lon: float) -> float:
    """As functions.geo.normalise_longitude, for one number."""
    return (lon + 180.0) % 360.0 - 180.0


def parse_label(xml: bytes) -> dict[str, Any]:
    """The fields of one label; a ProductError says what is missing."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ProductError(f"malformed label: {e}") from None
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: (e.text or "").strip()
    every = lambda top, tag: [e for e in top.iter() if name(e) == tag]
    inside = lambda top: {name(c): text(c) for c in reversed(list(top))}  # noqa: E731  the first child of a name counts
    area = next(iter(every(root, "File_Area_Observational")), None)
    if area is None:
        raise ProductError("no observational file area")
    files = [f for c in area if name(c) == "File" and (f := inside(c).get("file_name"))]
    array = next((c for c in area if name(c) in ARRAYS), None)
    if array is None or not files:
        raise ProductError("no array or no file name")
    fields = inside(array)
    if fields.get("axis_index_order", "") not in ("", "Last Index Fastest"):
        raise ProductError(f"axis order {fields['axis_index_order']}")
    axes = []
    for f in (inside(c) for c in array if name(c) == "Axis_Array"):
        if not f.get("elements") or not f.get("sequence_number"):
            raise ProductError("an axis without elements or sequence number")
        axes.append((int(f["sequence_number"]), f.get("axis_name", ""), int(f["elements"])))
    axes.sort()
    if len(axes) not in (2, 3):
        raise ProductError(f"{len(axes)} axes")
    element = next((inside(c) for c in array if name(c) == "Element_Array"), {})
    if element.get("data_type") not in DTYPES:
        raise ProductError(f"element type {element.get('data_type')}")
    nodata = [x for s in every(array, "Special_Constants") for tag, t in inside(s).items() if tag in SPECIAL and (x := number(t)) is not None]
    gsd = None
    for tag in GSD_TAGS:
        sizes = [x * UNITS_M.get((e.get("unit") or "m").strip().lower().split("/")[0].strip(), 1.0) for e in every(root, tag) if (x := number(e.text)) is not None and x > 0]
        if sizes:
            gsd = math.exp(sum(map(math.log, sizes)) / len(sizes))
            break
    value = {name(e): x for e in root.iter() if (x := number(e.text)) is not None}
    corners = {c: {"lon": _wrapped(value[f"{c}_longitude"]), "lat": value[f"{c}_latitude"]} for c in CORNERS if f"{c}_longitude" in value and f"{c}_latitude" in value}
    corners = corners if len(corners) == len(CORNERS) else {}
    sides = [value.get(f"{side}_bounding_coordinate") for side in ("west", "east", "south", "north")]
    if None not in sides:
        lons, lats = [_wrapped(x) for x in sides[:2]], sides[2:]
    else:
        lons, lats = [c["lon"] for c in corners.values()], [c["lat"] for c in corners.values()]
    box = {"min_lon": min(lons), "min_lat": min(lats), "max_lon": max(lons), "max_lat": max(lats)} if lons else None
    parts = (inside(c) for c in every(root, "Observing_System_Component"))
    sun = {name(e): x for e in root.iter() if ("sun" in name(e).lower() or "solar" in name(e).lower()) and not len(e) and (x := number(e.text)) is not None}
    return {
        "data_file": files[-1], "byte_offset": int(number(fields.get("offset")) or 0), "shape": [n for _, _, n in axes], "axis_names": [a for _, a, _ in axes], "dtype": DTYPES[element["data_type"]],
        "scaling_factor": number(element.get("scaling_factor")) or 1.0, "value_offset": number(element.get("value_offset")) or 0.0,
        "nodata": nodata, "gsd_m": gsd, "corners": list(corners.items()) or None, "bbox": box,
        "instrument": next((c.get("name") for c in parts if c.get("type", "").lower() == "instrument"), None), "metadata": list(sun.items()),
    }


def _labels_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows.append({"label_path": path, "error": None} | parse_label(content))
            except (ProductError, KeyError, ValueError) as e:
                rows.append({"label_path": path, "error": str(e)})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_labels(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """One row per label below a folder; a label that cannot be read has its reason in `error`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_labels_task, LABEL)


def read_array(spark: SparkSession, product: dict[str, Any], data_path: str) -> DataFrame:
    """band, row, col, v of one product whose label is parsed, wherever its data file lies; see sources.arrays."""
    from corrgrid.sources.arrays import read_parsed

    return read_parsed(spark, product, data_path)


def physical(raw: Column, nodata: list[float], scale: float, offset: float) -> Column:
    """Scaled values; special constants and non-finite values are NULL."""
    bad = F.isnan(raw) | (F.abs(raw) == float("inf"))
    return F.when(~(bad | (raw.isin(nodata) if nodata else F.lit(False))), raw * scale + offset)


def footprint(products: DataFrame) -> DataFrame:
    """label_path, bounds of the corners (longitudes normalised) and, where the label has none, the sampling distance they imply."""
    c = F.map_values("corners")
    lon, lat = F.transform(c, lambda p: normalise_longitude(p["lon"])), F.transform(c, lambda p: p["lat"])
    return products.where("corners is not null").select("label_path", F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), "gsd_m", F.element_at("shape", -2).alias("rows"), F.element_at("shape", -1).alias("cols"))
