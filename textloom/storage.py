"""Intermediate tables: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local folder serves a local master; a cluster has to name one, since what
    its executors write to their own disks is seen by none of the others."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all of {master} shares")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    if _scopes:
        _scopes[-1].append(path)
    return path


FILES = 4  #: files that a thin table has at most for each core


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, what it numbers stays numbered, and a lost
    executor costs no recomputation. A thin table (ids, numbers, counts) is written by FILES tasks for each core at most,
    which go through their partitions one after the other, so that its files are not as many and as small as its source's;
    wide=True keeps a task for each partition: for texts and vectors, and for what takes much work to make."""
    path = scratch(df.sparkSession, name)
    if not wide:
        df = df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs within go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch path before the application ends."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """What is written within is removed at the end, but for what the function that this gives has written."""
    _scopes.append([])

    def outlives(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        mine = _scopes.pop()
        try:
            return written(df, name, wide)
        finally:
            _scopes.append(mine)

    try:
        yield outlives
    finally:
        for path in _scopes.pop():
            drop(spark, path)
