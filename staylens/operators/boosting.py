"""Histogram gradient boosting (M10): binary log loss, best-first trees.

Features are binned once to a byte (exact quantiles as cut points, or every value of
a column with few). Rows live in blocks of numpy arrays, cached on the executors, about one
for each core; a block carries its margins. A tree grows best-first: the leaf with the largest
gain is split next, up to ``leaves`` leaves, whatever the depth. To know the gains, one job
sums gradients, hessians and counts over (feature, node, bin) for the smaller child of every
leaf that may still be split; the other child's sums are what its parent's leave. Tasks read
only the rows of the nodes asked for and send one array per feature, as wide as the feature has
bins. Arrays meet per feature and the driver gets their sum; up to ``FEW_PARTS`` partitions are
summed by the driver instead: a fit is about a thousand such jobs, and one without a shuffle
takes half the time. The next tree's first job also moves the margins on and sums the loss of
the held-out rows, on which fitting stops early. Leaves of few rows (``NEAR_ROWS`` a tree,
smallest first) send the rows themselves, once: what is below them is summed by the driver, with
no more jobs.

A lost executor's blocks are computed again from the last checkpoint
(``CHECKPOINT_EVERY`` trees, in the cluster's shared folder).
"""

from __future__ import annotations

import json
import math
import operator
import pickle
from dataclasses import asdict, dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .selection import exact_quantiles

BINS = 255
BLOCK_ROWS = 32_768
CHECKPOINT_EVERY = 20
#: Rows that a task holds at most.
PART_ROWS = 786_432
#: Partitions up to which the driver adds up the histograms (at most 6 kB a feature and node from each).
FEW_PARTS = 16
#: Rows (a byte for each feature, and two numbers) that a tree's small leaves may send to the driver.
NEAR_ROWS = 131_072


@dataclass
class Settings:
    rounds: int = 100
    learning_rate: float = 0.1
    leaves: int = 31
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 0.0
    #: Share of the rows held out for early stopping (0: none), used from ``early_rows`` rows on.
    held_out: float = 0.1
    early_rows: int = 10_000
    patience: int = 10
    tolerance: float = 1e-7


# -- bins ------------------------------------------------------------------------------------------------------------

def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the ascending cut points; a value's bin is the number of cuts below it.

    A column of at most ``bins`` values is cut between all of them, others at the
    ``bins`` - 1 inner quantiles."""
    about = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    cuts: dict[str, list[float]] = {}
    few = [f for f in features if about[f] <= bins * 1.1]
    if few:
        # about 1.1 x ``bins`` values a feature, found in the same job
        for f, found in zip(few, df.agg(*[F.collect_set(F.col(f).cast("double")) for f in few]).first()):
            values = sorted(found)
            if len(values) <= bins:
                cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    rest = [f for f in features if f not in cuts]
    if rest:
        probs = [i / bins for i in range(1, bins)]
        for f, found in zip(rest, exact_quantiles(df, [(f, probs) for f in rest])):
            cuts[f] = sorted({x for x in found if x is not None})
    return [cuts[f] for f in features]


def binned(values: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    """Bin of every value; NaN is bin 0."""
    out = np.searchsorted(np.asarray(cuts, float), values, side="left")
    out[np.isnan(values)] = 0
    return out.astype(np.uint8)


# -- trees -----------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Arrays by node: feature (-1: leaf), bin (rows up to it go left), left child (the right one follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> int:
        """Splits a leaf; returns its left child."""
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(0.0)
        return self.left[node]

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every column of ``x`` (features, rows)."""
        feature, at_bin, left = (np.asarray(a) for a in (self.feature, self.bin, self.left))
        at, rows = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        open_ = np.flatnonzero(feature[at] >= 0)
        while len(open_):
            n = at[open_]
            at[open_] = left[n] + (x[feature[n], rows[open_]] > at_bin[n])
            open_ = open_[feature[at[open_]] >= 0]
        return at


def rows_of(tree: Tree, x: np.ndarray, rows: np.ndarray, nodes: Sequence[int]) -> list[np.ndarray]:
    """The rows (of ``rows``) in each of ``nodes``, none of which is below another; only paths to them are followed."""
    need, found = set(nodes), {}
    for k in reversed(range(len(tree.feature))):                    # children come after their parent
        if tree.feature[k] >= 0 and k not in need and {tree.left[k], tree.left[k] + 1} & need:
            need.add(k)
    wanted, open_ = set(nodes), [(0, rows)]
    while open_:
        node, own = open_.pop()
        if node in wanted:
            found[node] = own
            continue
        right, left = x[tree.feature[node]][own] > tree.bin[node], tree.left[node]
        if left in need:
            open_.append((left, own[~right]))
        if left + 1 in need:
            open_.append((left + 1, own[right]))
    return [found[n] for n in nodes]


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return w * (p - y), w * p * (1 - p)


def log_loss(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> float:
    return float((w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum())


def histograms(x: np.ndarray, rows: Sequence[np.ndarray], g: Sequence[np.ndarray], h: Sequence[np.ndarray], bins: Sequence[int]) -> list[np.ndarray]:
    """Per feature (places, 3, bins): sums of gradient, hessian and rows; ``rows``, ``g`` and ``h`` are given by place."""
    out = [np.empty((len(rows), 3, n)) for n in bins]
    for place, own in enumerate(rows):
        for of, hist, n in zip(x, out, bins):
            key = of[own].astype(np.intp)
            for k, weights in enumerate((g[place], h[place], None)):
                hist[place, k] = np.bincount(key, weights, n)
    return out


def rest(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(3, bins) of the rows of ``whole`` that aren't in ``part``; bins without rows hold exact zeros."""
    out = whole - part
    out[:, out[2] == 0] = 0.0
    return out


def best_splits(hist: np.ndarray, s: Settings) -> list[tuple]:
    """Best (gain, bin, left sums) of every place of one feature's (places, 3, bins) array; gain 0 if none is allowed."""
    left = np.cumsum(hist, axis=2)
    total = left[:, :, -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(a[:, 0] ** 2 / (a[:, 1] + s.l2) for a in (left, right)) - total[:, 0] ** 2 / (total[:, 1] + s.l2)
    bad = (np.minimum(left[:, 2], right[:, 2]) < s.least_rows) | (np.minimum(left[:, 1], right[:, 1]) < s.least_hessian) | ~np.isfinite(gain)
    gain[bad] = 0.0
    at = gain.argmax(axis=1)
    rows = np.arange(len(hist))
    return [(float(gain[i, b]), int(b), tuple(left[i, :, b].tolist()), tuple(total[i, :, 0].tolist())) for i, b in zip(rows, at)]


class Growth:
    """Best-first growth of one tree, given the best split of every node asked for."""

    def __init__(self, s: Settings):
        self.s, self.tree, self.known = s, Tree(), {}

    def smaller(self, nodes: Sequence[int]) -> dict[int, tuple[int, int]]:
        """The child with fewer rows of each pair in ``nodes`` -> (its sibling, their parent)."""
        parents = {self.tree.left[n]: n for n in self.known if self.tree.feature[n] >= 0}
        out = {}
        for left in nodes[::2]:
            _, _, _, of_left, of_both = self.known[parents[left]]
            node, other = (left, left + 1) if 2 * of_left[2] <= of_both[2] else (left + 1, left)
            out[node] = (other, parents[left])
        return out

    def learn(self, nodes: Sequence[int], found: dict[int, list[tuple]]) -> None:
        """``found``: feature -> best split of each of ``nodes``; equal gains go to the smaller feature."""
        for k, node in enumerate(nodes):
            feature = max(sorted(found), key=lambda f: found[f][k][0])
            gain, at, left, total = found[feature][k]
            self.known[node] = (gain, feature, at, left, total)

    def ask(self) -> list[int]:
        """Nodes whose split must be known to go on; empty when the tree is grown, with its leaves' values set."""
        if not self.known:
            return [0]
        leaves, chosen = [0], []
        while len(leaves) < self.s.leaves:
            node = max(leaves, key=lambda n: (self.known[n][0], -n))
            if self.known[node][0] <= 0:
                break
            if len(leaves) + 1 == self.s.leaves and self.tree.feature[node] < 0:
                self.tree.split(node, *self.known[node][1:3])       # the last split: what its children could gain doesn't matter
            elif self.tree.feature[node] < 0 or self.tree.left[node] not in self.known:
                # its children may be better than the leaves after it: look at all that may still be split, at once
                room = self.s.leaves - len(leaves)
                able = sorted((n for n in leaves if self.known[n][0] > 0), key=lambda n: -self.known[n][0])[:room]
                new = []
                for n in able:
                    if self.tree.feature[n] < 0:
                        self.tree.split(n, *self.known[n][1:3])
                    if self.tree.left[n] not in self.known:
                        new += [self.tree.left[n], self.tree.left[n] + 1]
                return new
            leaves.remove(node)
            chosen.append(node)
            leaves += [self.tree.left[node], self.tree.left[node] + 1]
        self._cut(chosen, leaves)
        return []

    def _cut(self, chosen: list[int], leaves: list[int]) -> None:
        """Drops splits that were only looked at; sets the leaves' values."""
        out, at = Tree(), {0: 0}
        for node in chosen:
            left = out.split(at[node], self.tree.feature[node], self.tree.bin[node])
            at[self.tree.left[node]], at[self.tree.left[node] + 1] = left, left + 1
        totals = {node: of[4] for node, of in self.known.items()}
        for node in chosen[-1:]:
            _, _, _, of_left, of_both = self.known[node]
            totals.setdefault(self.tree.left[node], of_left)
            totals.setdefault(self.tree.left[node] + 1, tuple(a - b for a, b in zip(of_both, of_left)))
        for node in leaves:
            g, h, _ = totals[node]
            out.value[at[node]] = -self.s.learning_rate * g / (h + self.s.l2) if h + self.s.l2 > 0 else 0.0
        self.tree = out


# -- fitting ---------------------------------------------------------------------------------------------------------

@dataclass
class Block:
    """Rows of a task: bins (features, rows), label, weight, held out, margin."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    margin: np.ndarray
    #: Bins of each feature.
    bins: list[int]

    def moved(self, tree: Tree) -> "Block":
        leaves = [n for n, f in enumerate(tree.feature) if f < 0]
        margin = self.margin.copy()
        for n, rows in zip(leaves, rows_of(tree, self.x, np.arange(len(margin)), leaves)):
            margin[rows] += tree.value[n]
        return Block(self.x, self.y, self.w, self.held, margin, self.bins)

    def summed(self, tree: Tree, nodes: Sequence[int], loss: bool, whole: Sequence[int] = ()):
        """(feature, histograms of ``nodes``), (("rows", node), [bins, gradients, hessians]) of the nodes in ``whole``
        and, if asked for, ("loss", ...) of the block."""
        rows = rows_of(tree, self.x, np.flatnonzero(~self.held), [*nodes, *whole])
        slopes = [gradients(self.y[r], self.w[r], self.margin[r]) for r in rows]
        if n := len(nodes):
            yield from enumerate(histograms(self.x, rows[:n], *zip(*slopes[:n]), self.bins))
        for node, r, (g, h) in zip(whole, rows[n:], slopes[n:]):
            yield ("rows", node), [(self.x[:, r], g, h)]
        if loss:
            yield "loss", np.array([log_loss(self.y[m], self.w[m], self.margin[m]) for m in (self.held, ~self.held)])


@dataclass
class Boosted:
    """A fitted model as plain values."""

    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def margins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        x = np.stack([binned(np.asarray(v, float), c) for v, c in zip(columns, self.cuts)])
        out = np.full(x.shape[1], self.base)
        for tree in self.trees:
            out += np.asarray(tree.value)[tree.nodes(x)]
        return out

    def margin(self) -> Column:
        """The margin of a row, as a column over ``features``."""
        @F.pandas_udf(T.DoubleType())
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(self.margins([rows[c].to_numpy(float, na_value=np.nan) for c in rows.columns]))

        return run(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        plain = json.loads(text)
        return cls(**{**plain, "trees": [Tree(**t) for t in plain["trees"]]})


def parts(rows: int, cores: int) -> int:
    """Partitions for ``rows``: one for each core, or as many for each as ``PART_ROWS`` asks for; fewer for few rows."""
    return max(1, min(math.ceil(rows / BLOCK_ROWS), cores * math.ceil(rows / (cores * PART_ROWS))))


def blocks(df: DataFrame, features: Sequence[str], cuts, label: str, weight: str, held: Column, rows: int, base: float):
    """Cached blocks of ``df`` in evenly filled partitions."""
    n, bins = parts(rows, df.sparkSession.sparkContext.defaultParallelism), [len(c) + 1 for c in cuts]
    plain = df.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double"), F.col(weight).cast("double"), held).repartition(n)

    def run(batches):
        import pyarrow as pa

        def block(got):
            x, y, w, out = (np.concatenate(c, axis=-1) for c in zip(*got))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(x, y, w, out, np.full(len(y), base), bins))], pa.binary())], names=["block"])

        got, size = [], 0
        for b in batches:
            if b.num_rows:
                *x, y, w, out = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                got.append((np.stack([binned(v.astype(float), c) for v, c in zip(x, cuts)]), y, w, out.astype(bool)))
                size += b.num_rows
            if size >= PART_ROWS:
                yield block(got)
                got, size = [], 0
        if got:
            yield block(got)

    return plain.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)


def _added(blocks, *asked):
    """``Block.summed`` of all blocks of a partition together."""
    out = {}
    for b in blocks:
        for k, v in b.summed(*asked):
            out[k] = out[k] + v if k in out else v
    return out.items()


def sums(held_rows, tree: Tree, nodes: Sequence[int], n_out: int, loss: bool = True, whole: Sequence[int] = ()) -> dict:
    """feature -> histograms of ``nodes``, ("rows", node) -> rows of those in ``whole``, and "loss" if asked for, over all blocks."""
    found = held_rows.mapPartitions(lambda blocks: _added(blocks, tree, nodes, loss, whole))
    if held_rows.getNumPartitions() > FEW_PARTS:
        return dict(found.reduceByKey(operator.add, n_out).collect())
    total = {}
    for k, v in found.collect():
        total[k] = total[k] + v if k in total else v
    return total


def splits(held_rows, tree: Tree, nodes: Sequence[int], s: Settings, n_out: int) -> dict:
    """feature -> best split of each of ``nodes``, and "loss", over all blocks."""
    return {k: v if k == "loss" else best_splits(v, s) for k, v in sums(held_rows, tree, nodes, n_out).items()}


class Sums:
    """Histograms of a tree's nodes, by feature, and the rows of its small nodes."""

    def __init__(self, growth: Growth, root: list[np.ndarray]):
        self.growth, self.known, self.bins = growth, {0: root}, [h.shape[1] for h in root]
        self.near, self.room = {}, NEAR_ROWS

    def wanted(self, nodes: Sequence[int]) -> tuple[dict, list[int], list[int]]:
        """(``Growth.smaller`` of ``nodes``, those to sum on the executors, the parents whose rows are to be sent)."""
        few, whole = self.growth.smaller(nodes), []
        size = lambda parent: self.growth.known[parent][4][2]
        for parent in sorted((p for _, p in few.values() if p not in self.near), key=lambda p: (size(p), p)):
            if size(parent) > self.room:
                break
            self.room -= size(parent)
            whole.append(parent)
        return few, [n for n, (_, parent) in few.items() if parent not in self.near and parent not in whole], whole

    def add(self, few: dict, summed: list[int], found: dict) -> None:
        """Learns the nodes of ``few`` from what ``sums`` found for ``wanted``."""
        for k, got in found.items():
            if isinstance(k, tuple):
                self.near[k[1]] = tuple(np.concatenate(of, axis=-1) for of in zip(*got))
        tree = self.growth.tree
        for node, (other, parent) in few.items():
            if parent in self.near:
                x, g, h = self.near[parent]
                right = x[tree.feature[parent]] > tree.bin[parent]
                for child, own in ((tree.left[parent], ~right), (tree.left[parent] + 1, right)):
                    self.near[child] = x[:, own], g[own], h[own]
                x, g, h = self.near[node]
                hist = [of[0] for of in histograms(x, [slice(None)], [g], [h], self.bins)]
            else:
                hist = [found[f][summed.index(node)] for f in range(len(self.bins))]
            self.known[node], self.known[other] = hist, [rest(a, b) for a, b in zip(self.known[parent], hist)]


def fit(df: DataFrame, features: Sequence[str], label: str, weight: str, settings: Settings | None = None, id_col: str | None = None) -> Boosted:
    """Fit on ``df``. Rows are held out by a hash of ``id_col`` (of all features without one)."""
    s = settings or Settings()
    ensure_checkpoint_dir(df.sparkSession)
    rows, total, positive = df.agg(F.count(F.lit(1)), F.sum(weight), F.sum(F.when(F.col(label) > 0, F.col(weight)).otherwise(0.0))).first()
    if not rows or not total:
        return Boosted(list(features), [[] for _ in features], 0.0, [])
    share = min(max(positive / total, 1e-12), 1 - 1e-12)
    cuts = cut_points(df, features)
    early = bool(s.held_out) and rows >= s.early_rows
    by = [F.col(id_col).cast("string")] if id_col else [F.col(f) for f in features]
    held = (F.pmod(F.xxhash64(*by), F.lit(1000)) < int(1000 * s.held_out)) if early else F.lit(False)
    model = Boosted(list(features), cuts, math.log(share / (1 - share)), [])
    held_rows = blocks(df, features, cuts, label, weight, held, rows, model.base)
    held_rows.checkpoint()                                          # else every job goes through the stages of the input's plan
    n_out, best, since, before = min(len(features) + 1, held_rows.getNumPartitions() * 2), math.inf, 0, None
    try:
        for turn in range(s.rounds + 1):
            growth = Growth(s)
            found = sums(held_rows, growth.tree, growth.ask(), n_out)
            if before is not None:                                  # the moved blocks are held now
                before.unpersist()
            loss = float(found.pop("loss")[0 if early else 1])
            growth.learn([0], {f: best_splits(of, s) for f, of in found.items()})
            below = Sums(growth, [found[f][0] for f in sorted(found)])
            while turn < s.rounds and (nodes := growth.ask()):
                few, summed, whole = below.wanted(nodes)
                below.add(few, summed, sums(held_rows, growth.tree, summed, n_out, False, whole) if summed or whole else {})
                growth.learn(nodes, {f: best_splits(np.stack([below.known[n][f] for n in nodes]), s) for f in found})
            model.losses.append(loss)
            since = 0 if loss < best - s.tolerance * abs(best if best < math.inf else 0) else since + 1
            best = min(best, loss)
            if turn == s.rounds or early and since >= s.patience or len(growth.tree.feature) == 1:
                break
            model.trees.append(growth.tree)
            before, last = held_rows, growth.tree
            held_rows = before.map(lambda b, last=last: b.moved(last)).persist(StorageLevel.MEMORY_AND_DISK)
            if len(model.trees) % CHECKPOINT_EVERY == 0:
                held_rows.checkpoint()
        return model
    finally:
        for old in (before, held_rows):
            if old is not None:
                old.unpersist()
