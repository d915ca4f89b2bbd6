"""Imagery-like inputs derived from the star-schema tables, deterministically.

matches: point correspondences of 16 image pairs; pixels: two 64 x 64 grey images per image id, with
no-data cells as NULL; descriptors: vectors of a source and a reference image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgrid.operators.tiles import HEAD, packed, small_batches

#: The true 3 x 3 of the synthetic pairs, row-major.
H_TRUE = (0.98, -0.12, 14.0, 0.11, 1.01, -7.5, 2e-5, -1e-5, 1.0)

#: The same inputs as SQL, for the queries' oracles.
_W = "(2e-5 * x0 + -1e-5 * y0 + 1.0)"
MATCHES_SQL = f"""
raw AS (SELECT l_suppkey % 16 AS pair_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    (l_partkey * 37 + l_linenumber * 11) % 1000 + l_discount AS x0, (l_orderkey * 53 + l_suppkey * 17) % 1000 + l_tax AS y0,
    l_extendedprice / 105000.0 AS confidence, l_tax, l_discount FROM lineitem),
m AS (SELECT *, (0.98 * x0 + -0.12 * y0 + 14.0) / {_W} + (l_tax - 0.04) * 40 AS x1,
    (0.11 * x0 + 1.01 * y0 + -7.5) / {_W} + (l_discount - 0.05) * 20 AS y1 FROM raw)"""
PIXELS_SQL = """
cells AS (SELECT l_suppkey % 2 AS image_id, l_orderkey % 64 AS row, l_partkey % 64 AS col, l_extendedprice, l_quantity FROM lineitem),
px AS (SELECT image_id, row, col, CASE WHEN (row * 7 + col * 13) % 17 <> 0 THEN floor(max(l_extendedprice) / 105000.0 * 255)::INT END AS a,
    (max(l_quantity) * 5)::INT AS b FROM cells GROUP BY image_id, row, col)"""

#: An image whose side doubles with every tenfold table, from 512: the greatest price of a cell of 8 x 8
#: pixels sets its level, a texture of the place is added, cells without a row are no data.
LARGE_SQL = """
side AS (SELECT (512 * pow(2, round(log10(count(*) / 6000.0))))::INT AS side FROM lineitem),
cells AS (SELECT (l_orderkey * 7 + l_partkey * 13 + l_linenumber) % (side // 8 * (side // 8)) AS cell, max(floor(l_extendedprice))::INT % 256 AS base FROM lineitem, side GROUP BY ALL),
large AS (SELECT r.i AS row, c.i AS col, (base + ((r.i % 8) * (r.i % 8) * 3 + (c.i % 8) * 5 + (r.i % 8) * (c.i % 8)) % 97) % 256 AS v
    FROM side, range(0, side) r(i), range(0, side) c(i) LEFT JOIN cells ON cell = (r.i // 8) * (side // 8) + c.i // 8)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corrgrid.operators.points import project

    li = read(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 1000 + F.col("l_discount")
    y0 = (F.col("l_orderkey") * 53 + F.col("l_suppkey") * 17) % 1000 + F.col("l_tax")
    m = li.select((F.col("l_suppkey") % 16).alias("pair_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", x0.alias("x0"), y0.alias("y0"), (F.col("l_extendedprice") / 105000.0).alias("confidence"), "l_tax", "l_discount")
    px, py = project(F.col("x0"), F.col("y0"), H_TRUE)
    return m.withColumn("x1", px + (F.col("l_tax") - 0.04) * 40).withColumn("y1", py + (F.col("l_discount") - 0.05) * 20)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    row, col = F.col("l_orderkey") % 64, F.col("l_partkey") % 64
    cells = li.groupBy((F.col("l_suppkey") % 2).alias("image_id"), row.alias("row"), col.alias("col")).agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"))
    valid = (F.col("row") * 7 + F.col("col") * 13) % 17 != 0
    return cells.select("image_id", "row", "col", F.when(valid, F.floor(F.col("p") / 105000.0 * 255).cast("int")).alias("a"), (F.col("q") * 5).cast("int").alias("b"))


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


def large_tiles(spark: SparkSession, sf_dir: str, tile: int = 256) -> DataFrame:
    """The large image (LARGE_SQL) as a table of tiles: a tile's cells meet, its pixels are made in the task."""
    li = read(spark, sf_dir, "lineitem")
    side = 512 * 2 ** round(math.log10(max(1, li.count()) / 6000))
    across, cells = side // 8, tile // 8
    cell = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber")) % (across * across)
    base = li.groupBy(cell.alias("cell")).agg((F.max(F.floor("l_extendedprice")).cast("int") % 256).alias("base"))
    cy, cx = F.floor(F.col("cell") / across), F.col("cell") % across
    held = base.groupBy(F.floor(cy / cells).cast("int").alias("ty"), F.floor(cx / cells).cast("int").alias("tx")).agg(F.collect_list(F.struct((cy % cells).cast("int").alias("cy"), (cx % cells).cast("int").alias("cx"), "base")).alias("cells"))  # a tile's cells
    n = side // tile
    keys = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("ty"), (F.col("id") % n).cast("int").alias("tx"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:8, :8]
        texture = np.tile((y * y * 3 + x * 5 + y * x) % 97, (cells, cells))
        for batch in batches:
            for ty, tx, held in zip(*(batch.column(c) for c in ("ty", "tx", "cells")), strict=True):
                level = np.full((cells, cells), np.nan)
                if held.is_valid:
                    at_y, at_x, base = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("cy", "cx", "base"))
                    level[at_y, at_x] = base
                data = packed((level.repeat(8, axis=0).repeat(8, axis=1) + texture) % 256)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.array([v], pa.int32()) for v in (ty.as_py(), tx.as_py(), side, side, tile, tile)), pa.array([data], pa.binary())], ["image_id", "ty", "tx", "height", "width", "rows", "cols", "data"])

    small_batches(spark)
    return keys.join(held, ["ty", "tx"], "left").mapInArrow(paint, f"{HEAD}, data binary")
