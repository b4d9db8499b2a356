"""Cutting lineage of iterative plans in storage that outlives an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

TABLES = "quirework-tables"
_scopes: list[list[str]] = []  # the tables written in each scratch() that is open, the innermost last


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder in spark.checkpoint.dir; only where the session names none (local runs) one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            if not context.master.startswith("local"):
                raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
            own = tempfile.mkdtemp(prefix="quirework-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return f"{context.getCheckpointDir()}/{TABLES}"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read from there.

    A checkpoint would hand on the size that the optimiser estimated for it, which a self-join squares: after thirty
    rounds that number alone fills the driver. A table brings its true size, by which joins are then planned.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_told(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over its rows that are worked out as they are written, which spares another look at them."""
    seen = Observation()
    return cut(df.observe(seen, *measures)), seen.get


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside are deleted at the end, but for results that go through the function it gives, which cuts them for the scope around."""
    own: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        at = _scopes.index(own)
        inner, _scopes[at:] = _scopes[at:], []
        try:
            return cut(df)
        finally:
            _scopes.extend(inner)

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this application has written so far; what was made from them can't be read any more."""
    _delete(spark, shared_folder(spark))
