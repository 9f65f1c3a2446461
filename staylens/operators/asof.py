"""As-of join at arbitrary times (J5, general form): for every left row the last
right row of its key at or before its time.

Both sides are put in one order of key and time, dealt out in ranges of it, so a key
that holds a third of all rows lies in many tasks and no pair of rows is ever
formed. Inside a range the last right row is carried along in Arrow batches; what a
range needs from the ones before it is one row, found from one row per range.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import numeric_values_table
from .ranking import _ranged


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str],
              tiebreak: Sequence[str] = (), exact: bool = True, partitions: int | None = None) -> DataFrame:
    """``left`` (every row once) with ``values`` of the last row of ``right`` of the same
    ``keys`` whose ``right_ts`` isn't after ``left_ts`` (with ``exact=False``: is before it).

    Of right rows with equal times the last by ``tiebreak`` counts. To look for the last
    row *with* a value, pass only those. NULL keys and NULL times match nothing."""
    clash = set(left.columns) & set(values)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    names = [f"_k{i}" for i in range(len(keys))]
    order = [*names, "_t", "_side", *[f"_o{i}" for i in range(len(tiebreak))]]

    def usable(df, ts):
        ok = F.col(ts).isNotNull()
        for k in keys:
            ok = ok & F.col(k).isNotNull()
        return ok

    right = right.where(usable(right, right_ts))
    left_type, right_type = left.schema, right.select(*values).schema
    l = left.where(usable(left, left_ts)).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(left_ts).alias("_t"), F.lit(int(exact)).alias("_side"),
        *[F.lit(None).cast(right.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(tiebreak)],
        F.struct(*left.columns).alias("_left"), F.lit(None).cast(right_type).alias("_right"), F.lit(False).alias("_r"))
    r = right.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(right_ts).alias("_t"), F.lit(int(not exact)).alias("_side"),
        *[F.col(o).alias(f"_o{i}") for i, o in enumerate(tiebreak)],
        F.lit(None).cast(left_type).alias("_left"), F.struct(*values).alias("_right"), F.lit(True).alias("_r"))
    ranged = _ranged(l.unionByName(r), order, partitions).drop("_mid")
    out_type = T.StructType([*left_type.fields, *[T.StructField(f.name, f.dataType, True) for f in right_type.fields]])
    carried = ranged.join(F.broadcast(_carried(ranged, names, order)), "_pid", "left")
    found = carried.select(*names, "_r", "_left", "_right", "_carry").mapInArrow(_carry_along(len(names)), out_type)
    rest = left.where(~usable(left, left_ts)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right_type.fields])
    return found.unionByName(rest)


def _carried(ranged: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(_pid, _carry): the right row that a range's first key has from the ranges before. One row per range."""
    key = F.struct(*names)
    ends = ranged.groupBy("_pid").agg(F.min(key).alias("first"), F.max(key).alias("last"),
                                      F.max_by(F.struct(key.alias("key"), "_right"), F.when(F.col("_r"), F.struct(*order))).alias("found")).checkpoint()
    source, of, pairs = None, None, []
    for row in sorted(ends.select("_pid", "first", "last", F.col("found.key").alias("found")).collect(), key=lambda x: x["_pid"]):
        if source is not None and of == row["first"]:
            pairs.append((row["_pid"], source))
        if row["found"] is not None and row["found"] == row["last"]:
            source, of = row["_pid"], row["last"]
        elif of != row["last"]:
            source, of = None, None
    table = numeric_values_table(ranged.sparkSession, pairs, [("_pid", "INT"), ("_from", "INT")])
    rows = ends.select(F.col("_pid").alias("_from"), F.struct(F.col("found._right").alias("right")).alias("_carry"))
    return rows.join(F.broadcast(table), "_from").select("_pid", "_carry")


def _carry_along(n_keys: int):
    def run(batches):
        import pyarrow as pa

        last, held, has = None, None, False                             # key and right row of the row before
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
            is_right = b.column(n_keys).to_numpy(zero_copy_only=False).astype(bool)
            left, right, carry = (b.column(n_keys + i) for i in (1, 2, 3))
            first = [k[0] for k in keys]
            if last is None:
                has = carry[0].is_valid
                held = carry.field(0).slice(0, 1) if has else right.slice(0, 1)
                goes_on = has
            else:
                goes_on = all(a == c for a, c in zip(first, last))
            at = np.arange(b.num_rows)
            new = np.concatenate([[not goes_on], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if b.num_rows > 1 else np.array([not goes_on])
            start = np.maximum.accumulate(np.where(new, at, -1))        # -1: the key of the batch before
            seen = np.maximum.accumulate(np.where(is_right, at, -1))
            # places in [held, rows of the batch]
            place = np.where(seen >= np.maximum(start, 0), seen + 1, np.where((start < 0) & has, 0, -1))
            own = np.flatnonzero(~is_right)
            rows = pa.concat_arrays([held, right])
            if len(own):
                got = rows.take(pa.array(place[own], mask=place[own] < 0))
                columns = left.take(pa.array(own)).flatten() + got.flatten()
                names = [f.name for f in left.type] + [f.name for f in right.type]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            last, has = [k[-1] for k in keys], bool(place[-1] >= 0)
            held = rows.slice(int(place[-1]), 1) if has else rows.slice(0, 1)

    return run
