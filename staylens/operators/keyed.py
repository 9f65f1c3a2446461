"""Unique-key maintenance: one row per key inside a batch (W2), insert only
keys that are absent from the stored table (J4), ingest counts (A4) and the
keyed append itself (S7).

The source system relied on a unique index and an unordered bulk insert; here
the uniqueness rule is part of the job. Key comparisons are NULL-safe (two
NULL keys collide, as they do under a unique index).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence,
                  payload: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of every key in ``order_cols`` order.

    ``min`` over one ordered struct is an aggregate with map-side partial
    aggregation (sort-based, as the buffer is a struct): a hot key is reduced inside every map task before the
    shuffle. NULL keys form one group, as a unique index would have it.
    """
    from .summaries import ordered_struct
    keys = list(keys)
    payload = list(payload) if payload is not None else [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
              .agg(F.min(ordered_struct(order_cols, payload)).alias("_row"))
              .select(*keys, *[F.col("_row")[p].alias(p) for p in payload]))


def null_safe_match(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "_r_"):
    """Rename ``right``'s keys and build a NULL-safe equality condition."""
    r = right.select(*[F.col(k).alias(prefix + k) for k in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[prefix + k]) for k in keys])
    return r, cond


def exclude_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``existing`` (anti join).

    Only the key columns of the stored table are read (column pruning reaches
    the scan); the join strategy is left to the optimizer and AQE.
    """
    r, cond = null_safe_match(new, existing, keys)
    return new.join(r, cond, "left_anti")


def existing_flag(new: DataFrame, existing: DataFrame, keys: Sequence[str],
                  flag: str = "_exists") -> DataFrame:
    """Left join to the distinct keys of ``existing`` with a hit flag."""
    distinct_keys = existing.select(*keys).distinct().withColumn(flag, F.lit(True))
    r = distinct_keys.select(*[F.col(k).alias("_r_" + k) for k in keys], flag)
    cond = reduce(lambda a, b: a & b, [new[k].eqNullSafe(r["_r_" + k]) for k in keys])
    return (new.join(r, cond, "left")
               .drop(*["_r_" + k for k in keys])
               .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def insert_if_absent(batch: DataFrame, stored: DataFrame, keys: Sequence[str],
                     order_cols: Sequence) -> DataFrame:
    """W2 then J4: the rows a keyed, unordered bulk insert would have added."""
    return exclude_existing(first_per_key(batch, keys, order_cols), stored, keys)


def ingest_counts(batch: DataFrame, inserted: DataFrame, key_used: Sequence[str] | None = None) -> DataFrame:
    """A4: one row (inserted, duplicates, total[, unique_key_used])."""
    total = batch.agg(F.count(F.lit(1)).alias("total"))
    ins = inserted.agg(F.count(F.lit(1)).alias("inserted"))
    from .joins import with_scalars
    out = with_scalars(ins, total)  # two one-row aggregates
    out = out.select("inserted", (F.col("total") - F.col("inserted")).alias("duplicates"), "total")
    if key_used is not None:
        out = out.withColumn("unique_key_used", F.array(*[F.lit(k) for k in key_used]))
    return out


def read_if_exists(spark, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A stored table, or None if nothing is stored at ``path`` yet; any other
    failure of the read rises."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(batch: DataFrame, table_path: str, keys: Sequence[str], order_cols: Sequence,
               fmt: str = "parquet", partition_by: Sequence[str] | None = None,
               drop_cols: Sequence[str] = ()) -> dict:
    """Insert-if-absent into a stored table and report the counts.

    The stored table is read once for its keys; new rows are appended (no
    rewrite of existing files). Returns the A4 report as a dict.
    """
    spark = batch.sparkSession
    stored = read_if_exists(spark, table_path, fmt)
    new = first_per_key(batch, keys, order_cols)
    if stored is not None:
        if partition_by:
            # Partition columns derive from the key, so equal keys share a
            # partition: read only the partitions this batch touches.
            stored = stored.where(_partition_filter(new, stored, partition_by))
        new = exclude_existing(new, stored, keys)
    new = new.drop(*drop_cols).cache()
    # counts first: they must describe this batch against the table as it was
    report = ingest_counts(batch, new, keys).first().asDict()
    writer = new.write.mode("append").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(table_path)
    new.unpersist()
    return report


def _partition_filter(new: DataFrame, stored: DataFrame, partition_by: Sequence[str]):
    """Pruning predicate on the stored table's partition columns: the
    distinct partition values of the batch (bounded by the batch's calendar
    span), NULL partitions included when present."""
    cond = F.lit(True)
    for c in partition_by:
        vals = [r[0] for r in new.select(c).distinct().collect()]
        present = [v for v in vals if v is not None]
        part = F.col(c).isin(present) if present else F.lit(False)
        if len(present) < len(vals):
            part = part | F.col(c).isNull()
        cond = cond & part
    return cond
