"""Patches and deletes that end in the stored table.

A keyed table is stored in partitions that its keys name (S7), so a change touches the
partitions of its keys and nothing else is read or written. Only partitions that
hold one of the keys are rewritten: their new rows are staged in the shared folder
first, then put in place by a dynamic partition overwrite; partitions left without a
row are removed. All changes set or drop rows by key, so a change that was interrupted
is simply applied again.
"""

from __future__ import annotations

import uuid
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .changes import apply_patch_map, apply_patch_nonnull, delete_keys
from .keyed import _partition_filter


def _rewrite(path: str, asked: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
             change: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Applies ``change`` to the partitions that hold a key of ``asked``; returns what it rejects."""
    spark = asked.sparkSession
    missing = [c for c in partition_by if c not in asked.columns]
    if missing:
        raise ValueError(f"changes must name their partitions: {missing}")
    table = spark.read.parquet(path)
    near = table.where(_partition_filter(asked, table, partition_by))
    same = F.lit(True)
    wanted = asked.select(*[F.col(k).alias(f"_q_{k}") for k in keys]).distinct()
    for k in keys:
        same = same & near[k].eqNullSafe(F.col(f"_q_{k}"))
    hit = near.join(wanted, same, "left_semi").select(*partition_by).distinct()
    base = near.where(_partition_filter(hit, near, partition_by))
    stage = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staylens-rewrite-{uuid.uuid4().hex}"
    after, rejected = change(base)
    rejected.write.parquet(f"{stage}/rejected")
    after.write.parquet(f"{stage}/rows")
    rows = spark.read.schema(after.schema).parquet(f"{stage}/rows")
    # folders of partitions that lose their last row, found before anything is replaced
    parts = F.struct(*partition_by)
    folders = base.select(parts.alias("part"), F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")).distinct()
    left = rows.select(parts.alias("part")).distinct()
    empty = [r["folder"] for r in folders.join(left, "part", "left_anti").select("folder").distinct().collect()]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    for folder in empty:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(rejected.schema).parquet(f"{stage}/rejected")


def patch_stored(path: str, patch: DataFrame, keys: Sequence[str], partition_by: Sequence[str], protected: Sequence[str] = (),
                 order_cols: Sequence[str] = ()) -> DataFrame:
    """D2 on a stored table: as :func:`changes.apply_patch_map`; returns the rejected patches."""
    locked = [*protected, *partition_by]
    plain = patch.drop(*[c for c in partition_by if c not in keys])
    return _rewrite(path, patch, keys, partition_by, lambda base: apply_patch_map(base, plain, keys, protected=locked, order_cols=order_cols))


def patch_stored_nonnull(path: str, patch: DataFrame, keys: Sequence[str], partition_by: Sequence[str], **kw) -> DataFrame:
    """D5 on a stored table: as :func:`changes.apply_patch_nonnull`."""
    plain = patch.drop(*[c for c in partition_by if c not in keys])
    return _rewrite(path, patch, keys, partition_by, lambda base: apply_patch_nonnull(base, plain, keys, **kw))


def delete_stored(path: str, deletes: DataFrame, keys: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """D3 / D6 on a stored table; returns the keys that weren't found."""
    return _rewrite(path, deletes, keys, partition_by, lambda base: delete_keys(base, deletes, keys))
