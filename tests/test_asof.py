"""As-of join at seconds, against plain Python; one key with a third of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from staylens.operators.asof import asof_join

T0 = dt.datetime(2024, 1, 1)


def tables(spark, seed, n=3000):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 5 + ["é", "b"] + [f"k{i}" for i in range(8)])
    at = lambda: None if rng.random() < 0.02 else T0 + dt.timedelta(seconds=rng.randrange(2000))
    left = [(i, None if rng.random() < 0.02 else key(), at(), rng.choice([None, 1.5])) for i in range(n)]
    right = [(i, None if rng.random() < 0.02 else key(), at(), rng.choice(["x", "y", None]), rng.randrange(3)) for i in range(n // 10)]
    l = spark.createDataFrame(left, "id long, k string, cut timestamp_ntz, other double").repartition(5)
    r = spark.createDataFrame(right, "rid long, k string, ts timestamp_ntz, bed string, n int").repartition(3)
    return left, right, l, r


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("partitions", [1, 2, 9, 60])
def test_last_row_at_or_before(spark, exact, partitions):
    left, right, l, r = tables(spark, partitions)
    got = {row["id"]: (row["k"], row["cut"], row["other"], row["bed"], row["n"], row["rid"])
           for row in asof_join(l, r, ["k"], "cut", "ts", ["bed", "n", "rid"], ["n", "rid"], exact, partitions).collect()}
    assert len(got) == len(left)
    for i, k, cut, other in left:
        best = max(((ts, n, rid, bed) for rid, rk, ts, bed, n in right
                    if k is not None and cut is not None and rk == k and ts is not None and (ts <= cut if exact else ts < cut)), default=None)
        assert got[i] == (k, cut, other, *((best[3], best[1], best[2]) if best else (None, None, None)))


def test_hot_key_lies_in_many_ranges(spark):
    left, right, l, r = tables(spark, 7)
    one = l.withColumn("k", F.lit("hot"))
    got = asof_join(one, r, ["k"], "cut", "ts", ["rid"], ["rid"], partitions=12)
    assert got.count() == len(left)
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_two_keys_empty_sides_and_clashes(spark):
    l = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "x int, y string, cut timestamp_ntz")
    r = spark.createDataFrame([(1, "a", T0, 5), (1, "b", T0, 6), (2, "b", T0 - dt.timedelta(seconds=1), 7)], "x int, y string, ts timestamp_ntz, v int")
    assert sorted((q["x"], q["v"]) for q in asof_join(l, r, ["x", "y"], "cut", "ts", ["v"]).collect()) == [(1, 5), (2, 7)]
    assert [q["v"] for q in asof_join(l, r.limit(0), ["x", "y"], "cut", "ts", ["v"]).collect()] == [None, None]
    assert asof_join(l.limit(0), r, ["x", "y"], "cut", "ts", ["v"]).collect() == []
    with pytest.raises(ValueError):
        asof_join(l, r, ["x", "y"], "cut", "ts", ["y"])
