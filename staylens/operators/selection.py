"""Exact order statistics of many columns at once by radix selection.

A double is turned into a 64-bit integer that grows with it. One aggregate
counts, for all columns, the values per leading digit; the cells that hold the
wanted ranks are counted again by the next digit, until a cell holds one value.
Digits are 16 bits wide, so four aggregates suffice whatever the data, two where
the cells left hold few rows or few values. Counts are combined map-side: a value that
most rows share weighs no more than another, nothing is sorted or stored, and a
column sends the driver at most 2^16 counts at a time.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 16
#: Cells that hold so few rows together are counted by value.
FEW_ROWS = 100_000
_INFINITY = 0x7FF << 52


def order_key(v: Column) -> Column:
    """The bits of ``abs(v)`` as a number, with the sign of ``v`` (both zeros are 0)."""
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)                    # exact for whole exponents
    exponent = F.greatest(guess - (power > size).cast("int") + (power * 2 <= size).cast("int"), F.lit(-1022))
    fraction = size / F.pow(F.lit(2.0), exponent) * F.lit(2.0 ** 52)
    bits = (F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(_INFINITY))
            .otherwise((exponent + 1022).cast("long") * (1 << 52) + fraction.cast("long")))
    return F.when(v < 0, -bits).otherwise(bits)


def value_of(key: int) -> float:
    return math.copysign(struct.unpack(">d", struct.pack(">q", abs(key)))[0], key)


def _counts(keys: DataFrame, shift: int, cells: dict | None, wider: int):
    """{column: [(cell, rows, least key, greatest key)]} of the keys in ``cells`` ({column: cells of ``wider`` bits})."""
    if cells is not None:
        hit = F.lit(False)
        for c, own in cells.items():
            hit = hit | ((F.col("c") == c) & F.shiftright("k", wider).isin(sorted(own)))
        keys = keys.where(hit)
    out = defaultdict(list)
    for r in (keys.groupBy("c", F.shiftright("k", shift).alias("cell"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()):
        out[r["c"]].append((r["cell"], r["n"], r["lo"], r["hi"]))
    return {c: sorted(rows) for c, rows in out.items()}


def exact_quantiles(df: DataFrame, wanted: Sequence[tuple]) -> list[list[float | None]]:
    """Linear-interpolation quantiles (as pandas and DuckDB ``quantile_cont``).

    ``wanted``: (column, probabilities) pairs. Returns the values of each pair in
    order; None without any value. NULL and NaN are no values."""
    cols = [F.col(c) if isinstance(c, str) else c for c, _ in wanted]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), c.cast("double").alias("v")) for i, c in enumerate(cols)])).alias("x"))
    keys = rows.select("x.c", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v")).select("c", order_key(F.col("v")).alias("k"))
    shift = 64 - DIGIT
    found = _counts(keys, shift, None, 0)
    spots, values, open_ranks = {}, {}, {}
    for i, (_, probs) in enumerate(wanted):
        n = sum(r[1] for r in found.get(i, ()))
        spots[i] = [(n - 1) * p for p in probs] if n else None
        # ranks still to find, counted from the start of the cells that are looked at
        open_ranks[i] = {r: r for h in spots[i] or () for r in (math.floor(h), math.ceil(h))}
    while True:
        cells, rows_left = {}, 0
        for i, ranks in open_ranks.items():
            before, left = 0, {}
            for cell, n, lo, hi in found.get(i, ()):
                here = {r: at - before for r, at in ranks.items() if before <= at < before + n}
                before += n
                if here and lo == hi:
                    values.update({(i, r): value_of(lo) for r in here})
                elif here:
                    # ranks go on from the cells kept so far
                    skipped = sum(size for _, size in cells.get(i, ()))
                    cells.setdefault(i, []).append((cell, n))
                    left.update({r: at + skipped for r, at in here.items()})
                    rows_left += n
            open_ranks[i] = left
        if not cells:
            break
        wider, shift = shift, 0 if rows_left <= FEW_ROWS else shift - DIGIT
        found = _counts(keys, shift, {i: {c for c, _ in own} for i, own in cells.items()}, wider)
    out = []
    for i, at in spots.items():
        out.append([None] * len(wanted[i][1]) if at is None else
                   [_between(values[i, math.floor(h)], values[i, math.ceil(h)], h - math.floor(h)) for h in at])
    return out


def _between(a: float, b: float, share: float) -> float:
    return a if a == b or not share else a + (b - a) * share
