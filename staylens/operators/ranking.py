"""Order-dependent quantities computed without routing a whole key (or the
whole table) through one task.

A global order is materialised once by range partitioning (Spark samples the
full sort key, so a key holding a third of all rows is still split across
many partitions), the partitioned result is checkpointed to the cluster's
checkpoint folder (fixing partition contents so the two passes below agree,
and cutting lineage), and per-partition totals — one small row per partition
— give each partition its starting offset.
"""

from __future__ import annotations

from typing import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, numeric_values_table


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order_cols: Sequence, n: int | None) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    out = (df.repartitionByRange(_partitions(df, n), *order_cols)
             .sortWithinPartitions(*order_cols)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    return out.checkpoint(eager=True)


def _offsets(totals: Iterable, cols: Sequence[str]) -> dict[int, list[float]]:
    """Exclusive prefix sums of per-partition totals (one entry per partition)."""
    rows = sorted(totals, key=lambda r: r["_pid"])
    run = [0] * len(cols)
    out = {}
    for r in rows:
        out[r["_pid"]] = list(run)
        run = [a + (r[c] or 0) for a, c in zip(run, cols)]
    return out


def _with_positions(ranked: DataFrame, counts, name: str) -> DataFrame:
    """Global position = partition offset + position inside the partition.

    The offsets table has one row per partition (a proven bound), so it is
    broadcast; the ranked side is not moved.
    """
    offs = _offsets(counts, ["n"])
    table = numeric_values_table(ranked.sparkSession, [(pid, v[0]) for pid, v in sorted(offs.items())],
                                 [("_pid", "INT"), ("_off", "BIGINT")])
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranked.join(F.broadcast(table), "_pid")
                  .withColumn(name, F.col("_off") + local)
                  .drop("_off"))


def global_position(df: DataFrame, order_cols: Sequence, name: str = "gpos",
                    partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of every row in the total order ``order_cols``.

    The order must be total (append a unique tie-break column) for the result
    to be deterministic.
    """
    ranked = _ranged(df, order_cols, partitions)
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()
    return _with_positions(ranked, counts, name).drop("_pid", "_mid")


def _slices(df: DataFrame, first) -> "Column | None":
    """A coarse, order-preserving slice of the first ordering column, if its type has one."""
    if not isinstance(first, str):
        return None
    kind = df.schema[first].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.to_date(first)
    return F.substring(first, 1, 2) if kind == "string" else None


def position_in_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence,
                    name: str = "pos", partitions: int | None = None, slice_col=None) -> DataFrame:
    """0-based position of each row inside its key, in ``order_cols`` order.

    Equivalent to ``row_number() - 1`` over ``partitionBy(keys)`` (NULL keys are
    one group), but a key is ranked slice by slice: ``slice_col`` (default: the
    day, or the first two characters, of the first ordering column) must grow
    with the order. Rows move once, by (key, slice); the rows of a key before
    each slice come from the counts per (key, slice), which are combined
    map-side. Without a slice the global order is used.
    """
    part = slice_col if slice_col is not None else _slices(df, order_cols[0])
    if part is None:
        ordered = global_position(df, [*keys, *order_cols], "_gpos", partitions).withColumn("_key", F.struct(*keys))
        starts = ordered.groupBy("_key").agg(F.min("_gpos").alias("_start"))
        return ordered.join(starts, "_key").withColumn(name, F.col("_gpos") - F.col("_start")).drop("_gpos", "_start", "_key")
    # a struct is never NULL and its NULL fields are equal, so NULL keys join too
    rows = df.withColumn("_cell", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], part.alias("s")))
    counts = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[F.col("_cell")[f"k{i}"] for i in range(len(keys))]).orderBy(F.col("_cell.s")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(*order_cols)) - 1
    return (rows.withColumn("_inside", inside).join(starts, "_cell")
            .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_cell", "_inside", "_start"))


def running_totals(df: DataFrame, order_cols: Sequence, sum_cols: Sequence[str],
                   prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in the global ``order_cols`` order.

    Partition starting offsets come from one small aggregate; inside a
    partition the running sum is a vectorised cumulative sum over Arrow
    batches (``mapInPandas``), so no row moves after the range shuffle.
    """
    ranked = _ranged(df, order_cols, partitions).drop("_mid")
    totals = ranked.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()
    offs = _offsets(totals, list(sum_cols))
    out_fields = [f for f in ranked.schema.fields if f.name != "_pid"]
    out_fields += [T.StructField(prefix + c, T.DoubleType()) for c in sum_cols]
    schema = T.StructType(out_fields)
    keep = [f.name for f in ranked.schema.fields if f.name != "_pid"]
    cols = list(sum_cols)

    def _cumulate(batches):
        carry = None
        for pdf in batches:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            if carry is None:
                carry = np.array(offs.get(pid, [0] * len(cols)), dtype="float64")
            vals = pdf[cols].fillna(0).to_numpy(dtype="float64")
            cums = np.cumsum(vals, axis=0) + carry
            carry = cums[-1].copy()
            res = pdf[keep].copy()
            for j, c in enumerate(cols):
                res[prefix + c] = cums[:, j]
            yield res

    return ranked.mapInPandas(_cumulate, schema)
