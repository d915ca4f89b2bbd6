"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgrid.staging import discard, shared_dir, staged  # noqa: F401  (shared by the operators)

#: Fixed values of the corpus contracts: separators and words, by ASCII white space only.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that goes to a Python worker: texts are long rows, and both sides hold whole batches.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session hold more than BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: How each operator that keeps something in Python workers forgets it; True if there was something.
_KEPT: dict[str, Callable[[], bool]] = {}


def kept_in_workers(name: str, forget: Callable[[], bool]) -> None:
    _KEPT[name] = forget


def own_worker(name: str) -> None:
    """At the start of a task: Python workers are used again by later jobs, so drop what other operators kept in
    this one, and give back what the last task freed."""
    if any([forget() for other, forget in _KEPT.items() if other != name]):
        gc.collect()
    trim()


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if (give_back := _malloc_trim()) is not None:
        give_back(0)


def forget_lru(cached) -> bool:  # noqa: ANN001  a function under lru_cache
    used = cached.cache_info().currsize > 0
    cached.cache_clear()
    return used


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; no word gives 0."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only for a side whose counted rows stay within the limit."""
    return F.broadcast(df) if rows <= limit else df


#: Ids up to this many rows (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id stands in drops (one column, named like id_col)."""
    drops = staged(drops)
    return docs.join(broadcast_if_small(drops, drops.count(), BROADCAST_IDS), id_col, "left_anti")
