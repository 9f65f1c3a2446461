"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import ensure_checkpoint_dir, read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

__all__ = ["UPPER", "ascii_lower", "read_table", "batches", "scratch", "setting", "stored", "filesystem", "small_batches"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also fold e.g. U+00C9);
    texts of one byte per character take the cheaper built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/staylens-{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str | None):
    """While jobs run inside, ``key`` has this value (None: its own); the session's own comes back afterwards."""
    before = spark.conf.get(key)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches(spark: SparkSession, rows: int | None):
    """While jobs run inside, Arrow batches hold at most ``rows`` rows (and Spark's limit in bytes)."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows) if rows else None)


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and scan it again: cuts the lineage,
    survives lost executors, and is computed once for all its readers. ``batch_rows``
    bounds the Arrow batches of this job alone."""
    path = scratch(df.sparkSession, name)
    with batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder, for tasks that read or
    write files which no Spark data source covers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows per Arrow batch for tasks that hand whole texts to Python: bounds a
    worker's memory by the texts of one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
