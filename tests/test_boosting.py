"""Histogram boosting against a plain numpy boosting on the same bins, and level dictionaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.operators import boosting as B
from staylens.operators import levels as L


def plain_tree(x, g, h, s):
    """Best-first growth, one leaf at a time, every split tried in turn."""
    def best(rows):
        out = (0.0, None, None)
        for f in range(len(x)):
            for at in range(int(x[f].max()) + 1):
                left = rows[x[f][rows] <= at]
                right = rows[x[f][rows] > at]
                if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_hessian:
                    continue
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + s.l2) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                if gain > out[0] + 1e-9:
                    out = (gain, f, at)
        return out

    leaves, splits = [(best(np.arange(len(g))), np.arange(len(g)))], []
    while len(leaves) < s.leaves and max(b[0] for b, _ in leaves) > 0:
        k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (_, f, at), rows = leaves.pop(k)
        splits.append((f, at, len(rows)))
        leaves += [(best(r), r) for r in (rows[x[f][rows] <= at], rows[x[f][rows] > at])]
    values = np.zeros(len(g))
    for _, rows in leaves:
        values[rows] = -s.learning_rate * g[rows].sum() / (h[rows].sum() + s.l2)
    return sorted(splits), values


def data(n, seed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.standard_normal(n), rng.integers(0, 12, n).astype(float), rng.random(n) ** 4
    y = (a + 0.3 * (b > 6) * np.sign(a) + np.where(c > 0.5, 1, -0.2) + rng.standard_normal(n) * 0.5 > 0).astype(float)
    return a, b, c, y, rng.integers(1, 4, n).astype(float)


@pytest.mark.parametrize("l2", [0.0, 5.0])
def test_splits_equal_those_of_plain_boosting(spark, l2):
    a, b, c, y, w = data(1500, 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, w)], "a double, b double, c double, y double, w double").repartition(3)
    s = B.Settings(rounds=4, leaves=12, l2=l2, held_out=0)
    model = B.fit(df, ["a", "b", "c"], "y", "w", s)
    x = np.stack([B.binned(v, cut) for v, cut in zip((a, b, c), model.cuts)])
    assert len(model.cuts[1]) == 11 and len(model.cuts[0]) == B.BINS - 1
    margin = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    assert abs(model.base - margin[0]) < 1e-12
    for tree in model.trees:
        g, h = B.gradients(y, w, margin)
        want, values = plain_tree(x, g, h, s)
        sizes = {0: len(y)}
        at = tree.nodes(x)
        def below(node):
            return [node] if tree.feature[node] < 0 else below(tree.left[node]) + below(tree.left[node] + 1)
        got = sorted((tree.feature[k], tree.bin[k], int(np.isin(at, below(k)).sum())) for k in range(len(tree.feature)) if tree.feature[k] >= 0)
        assert got == want and len(got) == 11
        margin = margin + values
        assert np.allclose(np.asarray(tree.value)[at], values)
    assert np.allclose(model.margins((a, b, c)), margin)
    scored = df.select("a", "b", "c", model.margin().alias("m")).toPandas()
    assert np.allclose(scored.m, model.margins((scored.a, scored.b, scored.c)))
    again = B.Boosted.from_json(model.to_json())
    assert np.array_equal(again.margins((a, b, c)), model.margins((a, b, c)))


def test_deep_trees_and_early_stopping(spark):
    n = 6000
    rng = np.random.default_rng(3)
    a = rng.random(n)
    y = ((a * 64).astype(int) % 2).astype(float)                   # only many cuts of one feature tell the classes apart
    df = spark.createDataFrame([(i, float(v), float(t), 1.0) for i, (v, t) in enumerate(zip(a, y))], "id long, a double, y double, w double")
    model = B.fit(df, ["a"], "y", "w", B.Settings(rounds=30, early_rows=1000, patience=3), "id")
    def depth(tree, node=0):
        return 0 if tree.feature[node] < 0 else 1 + max(depth(tree, tree.left[node]), depth(tree, tree.left[node] + 1))
    assert max(depth(t) for t in model.trees) > 5 and all(t.feature.count(-1) <= 31 for t in model.trees)
    assert model.losses[-1] < 0.5 * model.losses[0]
    noise = df.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(7)) < 3).cast("double"))
    stopped = B.fit(noise, ["a"], "y", "w", B.Settings(rounds=60, early_rows=1000, patience=3), "id")
    assert len(stopped.trees) < 30


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "a double, y double, w double")
    assert B.fit(empty, ["a"], "y", "w").trees == []
    same = spark.createDataFrame([(1.0, float(i % 2), 1.0) for i in range(100)] + [(None, 1.0, 1.0)], "a double, y double, w double")
    assert B.fit(same, ["a"], "y", "w").trees == []


def test_codes_of_levels(spark):
    train = spark.createDataFrame([("b",), ("a",), ("é",), (None,), ("b",), ("B",)], "v string")
    levels = L.ordinal_levels(train, "v")
    assert sorted(map(tuple, levels.collect())) == [("B", 0), ("a", 1), ("b", 2), ("é", 3)]
    new = spark.createDataFrame([("b", 1), ("z", 2), (None, 3), ("B", 4)], "v string, level int")
    got = L.ordinal_code(new, "v", levels, "c").collect()
    assert sorted((r["level"], r["c"]) for r in got) == [(1, 2), (2, -1), (3, -1), (4, 0)]


def test_few_partitions_are_summed_without_a_shuffle_and_give_the_same_trees(spark, monkeypatch):
    a, b, c, y, w = data(900, 6)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, w)], "a double, b double, c double, y double, w double").repartition(3)
    blocks, s = B.blocks(df, ["a", "b", "c"], [[0.0], [5.0], [0.5]], "y", "w", F.lit(False), B.BLOCK_ROWS * 3, 0.0), B.Settings()
    sc = spark.sparkContext
    found = {}
    for few in (B.FEW_PARTS, 0):
        monkeypatch.setattr(B, "FEW_PARTS", few)
        sc.setJobGroup(f"splits-{few}", "")
        found[few] = B.splits(blocks, B.Tree(), [0], s, 2)
        (job,) = sc.statusTracker().getJobIdsForGroup(f"splits-{few}")
        found[few, "stages"] = len(sc.statusTracker().getJobInfo(job).stageIds)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found[0, "stages"] - found[16, "stages"] == 1
    few, many = found[16], found[0]
    assert few.keys() == many.keys() == {0, 1, 2, "loss"} and np.allclose(few["loss"], many["loss"])
    for f in range(3):
        (one,), (two,) = few[f], many[f]
        assert one[1] == two[1] and np.allclose([one[0], *one[2], *one[3]], [two[0], *two[2], *two[3]])


def test_a_tree_reads_the_rows_of_one_child_of_a_split_and_no_more_than_it_needs(spark, monkeypatch):
    a, b, c, y, w = data(1200, 9)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y, w)], "a double, b double, c double, y double, w double").repartition(2)
    asked, sums = [], B.sums

    def spy(rows, tree, nodes, *rest):
        asked.append((tree.left[:], list(nodes)))
        found = sums(rows, tree, nodes, *rest)
        assert not nodes or [found[f].shape for f in range(3)] == [(len(nodes), 3, n) for n in (255, 12, 255)]    # as wide as the bins
        return found

    monkeypatch.setattr(B, "sums", spy)
    monkeypatch.setattr(B, "NEAR_ROWS", 0)
    model = B.fit(df, ["a", "b", "c"], "y", "w", B.Settings(rounds=2, leaves=8, held_out=0))
    assert len(model.trees) == 2 and all(t.feature.count(-1) == 8 for t in model.trees)
    for left, nodes in asked:
        assert nodes == [0] or all(n in left or n - 1 in left for n in nodes)
        assert not any(n + 1 in nodes and n in left for n in nodes)                                 # never both children
    jobs = len(asked)
    asked.clear()
    monkeypatch.setattr(B, "NEAR_ROWS", 200)                                                        # some leaves send their rows
    monkeypatch.setattr(B, "FEW_PARTS", 0)
    again = B.fit(df, ["a", "b", "c"], "y", "w", B.Settings(rounds=2, leaves=8, held_out=0))
    monkeypatch.undo()
    monkeypatch.setattr(B, "sums", spy)
    assert [(t.feature, t.bin, t.left) for t in again.trees] == [(t.feature, t.bin, t.left) for t in model.trees] and len(asked) <= jobs
    assert all(np.allclose(t.value, u.value) for t, u in zip(again.trees, model.trees))
    asked.clear()
    stumps = B.fit(df, ["a", "b", "c"], "y", "w", B.Settings(rounds=3, leaves=2, held_out=0))
    assert [nodes for _, nodes in asked] == [[0]] * 4                                               # the last split's children aren't summed
    x = np.stack([B.binned(v, cut) for v, cut in zip((a, b, c), stumps.cuts)])
    g, h = B.gradients(y, w, np.full(len(y), stumps.base))
    at = stumps.trees[0].nodes(x)
    assert np.allclose(stumps.trees[0].value[1:], [-0.1 * g[at == k].sum() / h[at == k].sum() for k in (1, 2)])


def test_the_other_child_holds_what_its_parent_leaves(spark):
    rng = np.random.default_rng(4)
    x, g, h = rng.integers(0, 40, (1, 500)).astype(np.uint8), rng.standard_normal(500), rng.random(500)
    rows = np.arange(500)
    (both,), (left,), (right,) = (B.histograms(x, [own], [g[own]], [h[own]], [64]) for own in (rows, rows[x[0] <= 17], rows[x[0] > 17]))
    got = B.rest(both[0], left[0])
    assert np.allclose(got, right[0]) and np.array_equal(got[2], right[0, 2]) and not got[:, :18].any()


def test_partitions_follow_the_cores():
    assert [B.parts(n, 6) for n in (0, 1500, 40_000, 720_000, 7_200_000)] == [1, 1, 2, 6, 12]
    assert B.parts(720_000, 6) <= B.FEW_PARTS and B.parts(10**9, 6) * B.PART_ROWS >= 10**9
