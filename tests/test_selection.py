"""Exact quantiles of several columns by radix selection, against numpy."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import selection as S

PROBS = [0.0, 0.01, 0.33, 0.5, 0.8, 0.999, 1.0]


def awkward(rng, n):
    edge = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 2.0 ** 52 + 1]
    bits = [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(n)]
    powers = [s * math.nextafter(2.0 ** k, d) for k in range(-60, 60) for d in (0, 2.0 ** k, math.inf) for s in (1, -1)]
    return [x for x in edge + bits + powers if math.isfinite(x)]


def test_order_key_orders_and_inverts(spark):
    values = awkward(random.Random(3), 400) + [math.inf, -math.inf]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.order_key(F.col("v")).alias("k")).collect()
    assert all(S.value_of(r["k"]) == r["v"] for r in rows)
    by_key = [r["v"] for r in sorted(rows, key=lambda r: r["k"])]
    assert by_key == sorted(values)


@pytest.mark.parametrize("few", [S.FEW_ROWS, 0])
def test_many_columns_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_ROWS", few)                     # 0: every digit is counted
    rng = np.random.default_rng(4)
    n = 3000
    wide = np.array(awkward(random.Random(5), n)[:n])
    columns = {"normal": rng.standard_normal(n), "skewed": np.where(rng.random(n) < 0.9, 7.0, rng.lognormal(0, 30, n)),
               "ages": rng.integers(0, 100, n).astype(float), "wide": np.resize(wide, n), "one": np.full(n, -3.25)}
    gaps = rng.random(n) < 0.1
    rows = [tuple(None if gaps[i] else math.nan if i % 97 == 0 else float(columns[c][i]) for c in columns) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = S.exact_quantiles(df, [(c, PROBS) for c in columns] + [("ages", [0.25])])
    for c, own in zip(columns, got):
        held = sorted(r[list(columns).index(c)] for r in rows if r[list(columns).index(c)] is not None and not math.isnan(r[list(columns).index(c)]))
        for p, value in zip(PROBS, own):
            h = (len(held) - 1) * p
            a, b = held[math.floor(h)], held[math.ceil(h)]
            assert value == (a if a == b or h == math.floor(h) else a + (b - a) * (h - math.floor(h)))
    assert len(got[-1]) == 1


def test_no_values(spark):
    df = spark.createDataFrame([(None, math.nan, 1.0)], "a double, b double, c double")
    assert S.exact_quantiles(df, [("a", [0.5]), ("b", [0.5, 0.9]), ("c", [0.5])]) == [[None], [None, None], [1.0]]
    assert S.exact_quantiles(df.limit(0), [("c", [0.1])]) == [[None]]


def test_few_jobs_whatever_the_number_of_columns(spark):
    df = spark.range(5000).select(*[(F.rand(i) * 100).alias(f"c{i}") for i in range(6)]).cache()
    counts = []
    real = S._counts
    try:
        S._counts = lambda *a: counts.append(1) or real(*a)
        S.exact_quantiles(df, [(c, [0.5, 0.9]) for c in df.columns])
    finally:
        S._counts = real
    assert len(counts) == 2
