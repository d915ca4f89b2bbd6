"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """The tables staged while the scope was the innermost one."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def discard(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Delete the scope's tables, but for one, which stays in the scope; results that read them must be written."""
        kept = getattr(keep, "_staged_path", None)
        for path in [p for p in self.paths if p != kept]:
            _delete(spark, path)
            self.paths.remove(path)


_SCOPE: ContextVar[Scope | None] = ContextVar("corrgrid_scope", default=None)


@contextmanager
def scope() -> Iterator[Scope]:
    """Own what is staged inside. Tables staged outside, or in a scope of their own, are not touched by it."""
    mine = Scope()
    token = _SCOPE.set(mine)
    try:
        yield mine
    finally:
        _SCOPE.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a temporary one; a cluster must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corrgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, *, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, its lineage is cut,
    and what a lost executor had is read again instead of computed again."""
    path = f"{shared_dir(df.sparkSession)}/corrgrid-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if (mine := _SCOPE.get()) is not None:
        mine.paths.append(path)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
