"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long bit string (``BITS`` signs of random
projections around their median); a tree is the sorted array of these strings,
dealt out in blocks by their leading bits. A query descends each tree to the
longest prefix it shares and ascends all trees together, one bit at a time,
until the entries below its prefixes number ``candidates`` in all; those are
compared exactly. Blocks hold the vectors, so a query visits the blocks under
its prefixes, finds its range in the sorted array by binary search, and brings
back only its nearest.

``candidates`` is measured, not guessed: ``CALIBRATION`` queries are searched
by brute force (one pass over the rows), and the least number that finds
``RECALL`` of their true neighbours is taken for all. Equal vectors are one
entry with their k + 1 smallest ids, which is all a result can need, so groups
of copies don't load a block; large blocks are split by entry.

Fitted on a bounded sample: the medians, on ``SAMPLE`` vectors of smallest
hash. Every row is indexed.

Edge cases: vectors that are null, empty, all zero or hold a null or a
non-finite component take no part, nor do those of another length than the
most common one (ties: the shorter); rows that repeat vec_id and vector count
once; a query's own vec_id is never its neighbour; null vec_ids take no part;
fewer than k candidates give fewer rows, empty tables none; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small_batches, stored

TREES = 16
BITS = 48
SAMPLE = 4096
CALIBRATION = 64
RECALL = 0.96
BLOCK = 8192
#: Levels below the block's at which entries are still counted.
FINE = 6
BROADCAST_ROWS = 1_000_000


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(rows: DataFrame) -> DataFrame:
    """vec_id and the vector as packed numbers (0.0 for -0.0) of the usable rows of
    the most common length; stored."""
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    ok = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    size = ok.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    ok = ok.where(F.size("embedding") == (size[0][0] if size else 0))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            flat = b.column("embedding")
            values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(flat), -1) + np.dtype(kind).type(0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([x.tobytes() for x in values], pa.binary())], names=["vec_id", "v"])

    return stored(ok.mapInArrow(run, "vec_id long, v binary"), "vectors"), kind


class Forest:
    """The projections and their medians."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int = TREES):
        self.trees = trees
        self.planes = np.random.Generator(np.random.PCG64(11)).standard_normal((dim, trees * BITS))
        self.middle = np.median(sample @ self.planes, axis=0) if len(sample) else np.zeros(trees * BITS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors x trees) bit strings as integers, the first bit the highest."""
        bits = (x @ self.planes > self.middle).reshape(len(x), self.trees, BITS)
        return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """node, v, ids (the k + 1 smallest) of every distinct vector; stored."""
    first = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    made = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(made.select(F.monotonically_increasing_id().alias("node"), "v", "ids"), "vector-nodes")


def with_codes(nodes: DataFrame, forest: Forest, kind: str) -> DataFrame:
    """nodes with their bit strings, one per tree; stored."""
    shared = nodes.sparkSession.sparkContext.broadcast((forest.planes, forest.middle, forest.trees))

    def run(batches):
        import pyarrow as pa

        own = Forest.__new__(Forest)
        own.planes, own.middle, own.trees = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v").to_pylist(), kind)
                codes = own.codes(x)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * own.trees, pa.int32()), pa.array(codes.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), b.column("ids"), made], names=["node", "v", "ids", "codes"])

    return stored(nodes.mapInArrow(run, "node long, v binary, ids array<long>, codes array<long>"), "forest")


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def _prefix(code: Column, level) -> Column:
    return F.call_function("shiftright", code, (F.lit(BITS) - level).cast("int"))


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact Euclidean distances of the k nearest rows of x (with all
    that tie or nearly tie with the last)."""
    rough = np.einsum("ij,ij->i", x, x) - 2 * (x @ q)
    if len(x) > k:
        last = np.partition(rough, k - 1)[k - 1]
        at = np.flatnonzero(rough <= last + 1e-9 * (1 + abs(last) + q @ q))
    else:
        at = np.arange(len(x))
    return at, np.sqrt(((x[at] - q) ** 2).sum(1))


def brute_force(nodes: DataFrame, queries: np.ndarray, kind: str, k: int) -> list[list[tuple[float, bytes]]]:
    """The k nearest distinct vectors (distance, v) of a few queries, themselves
    included: every task returns its k nearest per query."""
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        import pandas as pd

        best = [[] for _ in shared.value]
        for b in batches:
            values = [bytes(v) for v in b["v"]]
            if values:
                x = _matrix(values, kind)
                for i, q in enumerate(shared.value):
                    at, d = _nearest(q, x, k)
                    best[i] = sorted(best[i] + [(s, values[j]) for j, s in zip(at, d)])[:k]
        yield pd.DataFrame([(i, s, v) for i, one in enumerate(best) for s, v in one], columns=["q", "s", "v"])

    rows = nodes.select("v").mapInPandas(run, "q int, s double, v binary")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("s", "v"))).where(F.col("r") <= k)
    out = [[] for _ in queries]
    for r in top.orderBy("q", "r").collect():
        out[r["q"]].append((r["s"], bytes(r["v"])))
    return out


def _counts(entries: DataFrame, fine: int) -> DataFrame:
    """Entries below every prefix: (tree, level, prefix, n) for levels 0..fine, each
    level summed up from the next finer one; stored."""
    table = stored(entries.groupBy("tree", _prefix(F.col("code"), F.lit(fine)).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "prefix-counts")
    out = table.select("tree", F.lit(fine).alias("level"), "prefix", "n")
    for level in range(fine):
        part = table.groupBy("tree", F.call_function("shiftright", F.col("prefix"), F.lit(fine - level)).alias("prefix")).agg(F.sum("n").alias("n"))
        out = out.unionByName(part.select("tree", F.lit(level).alias("level"), "prefix", "n"))
    return stored(out, "level-counts")


def _below(probes: DataFrame, counts: DataFrame, fine: int) -> DataFrame:
    """(q, level, n): entries that share the first ``level`` bits with q, over all trees."""
    asked = probes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(fine)))).withColumn("prefix", _prefix(F.col("code"), F.col("level")))
    return asked.join(counts, ["tree", "level", "prefix"]).groupBy("q", "level").agg(F.sum("n").alias("n"))


def calibrated(index: DataFrame, below: DataFrame, forest: Forest, kind: str, k: int, recall: float, total: int) -> int:
    """Least number of candidates with which the calibration queries (those of
    smallest hash among q) find ``recall`` of their true neighbours."""
    picked = below.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(CALIBRATION)
    rows = index.join(F.broadcast(picked), F.col("node") == F.col("q")).select("q", "v").orderBy("q").collect()
    if not rows:
        return k
    queries = _matrix([bytes(r["v"]) for r in rows], kind)
    true = brute_force(index, queries, kind, k + 1)
    levels: dict[int, dict[int, int]] = {}
    for r in below.join(F.broadcast(picked), "q").collect():
        levels.setdefault(r["q"], {})[r["level"]] = r["n"]
    own = forest.codes(queries)
    needs = []                                    # per true neighbour: candidates at which it is reached
    for i, r in enumerate(rows):
        for d, v in true[i]:
            if v == bytes(r["v"]):
                continue
            other = forest.codes(_matrix([v], kind))[0]
            deep = max(BITS - int(a ^ b).bit_length() for a, b in zip(own[i], other))
            have = levels[r["q"]]
            needs.append(have[min(deep, max(have))])
    needs.sort()
    return min(total, max(k, needs[min(len(needs) - 1, int(recall * len(needs)))])) if needs else k


def search(rows: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest neighbours found of every row (vec_id, embedding) for which
    ``is_query``: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    vectors, kind = packed(rows)
    nodes = nodes_of(vectors, k)
    chosen = nodes.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()
    sample = _matrix([bytes(r["v"]) for r in chosen], kind) if chosen else np.zeros((0, 1))
    forest = Forest(sample, sample.shape[1], trees)
    index = with_codes(nodes, forest, kind)
    total = index.count()
    base = max(0, (max(1, total) // BLOCK).bit_length())
    fine = min(BITS, base + FINE)
    entries = index.select("node", F.posexplode("codes").alias("tree", "code"))
    counts = _counts(entries, fine)
    asking = stored(vectors.where(is_query).distinct().join(nodes.select("v", "node"), "v").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "query-nodes")
    probes = asking.select("q").distinct().join(index, F.col("q") == F.col("node")).select("q", "v", F.posexplode("codes").alias("tree", "code"))
    below = stored(_below(probes.select("q", "tree", "code"), counts, fine), "below")
    candidates = calibrated(index, below, forest, kind, k, recall, total * trees)
    level = below.where(F.col("n") >= candidates).groupBy("q").agg(F.max("level").alias("level"))
    # blocks: the entries below a prefix of `base` bits, split by entry where they are many
    blocks = stored(counts.where(F.col("level") == base).select("tree", F.col("prefix").alias("block"), F.ceil(F.col("n") / (2 * BLOCK)).cast("int").alias("parts")), "blocks")
    known = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    held = (index.select("node", "v", F.col("ids")[0].alias("least"), F.posexplode("codes").alias("tree", "code"))
            .withColumn("block", _prefix(F.col("code"), F.lit(base))).join(known, ["tree", "block"])
            .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"))
    wide = F.greatest(F.lit(base) - F.col("level"), F.lit(0))
    low = F.call_function("shiftleft", _prefix(F.col("code"), F.least(F.col("level"), F.lit(base))), wide)
    visits = (probes.join(level, "q").withColumn("block", F.explode(F.sequence(low, low + F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1)))
              .join(known, ["tree", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))

    def visit(asked, entries):
        import pandas as pd

        if not len(asked) or not len(entries):
            return pd.DataFrame({"q": [], "node": [], "least": [], "score": []})
        order = np.argsort(entries["code"].to_numpy(), kind="stable")         # the sorted array of this block
        code, node, least = (entries[c].to_numpy()[order] for c in ("code", "node", "least"))
        x = _matrix([bytes(v) for v in entries["v"]], kind)[order]
        out = []
        for q, c, lev, v in zip(asked["q"], asked["code"], asked["level"], _matrix([bytes(v) for v in asked["v"]], kind)):
            shift = BITS - int(lev)
            lo = np.searchsorted(code, (int(c) >> shift) << shift)
            hi = np.searchsorted(code, ((int(c) >> shift) + 1) << shift)
            if lo < hi:
                at, d = _nearest(v, x[lo:hi], k + 1)
                at = at + lo
                best = np.lexsort((least[at], d))[: k + 1]
                out.append(pd.DataFrame({"q": q, "node": node[at[best]], "least": least[at[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "node": [], "least": [], "score": []})

    keys = ["tree", "block", "part"]
    visits = stored(visits.select(*keys, "q", "v", "code", "level"), "visits")
    met = visits.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(visit, "q long, node long, least long, score double")
    near = met.groupBy("q", "node").agg(F.min("score").alias("score"), F.min("least").alias("least"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "least"))).where(F.col("r") <= k + 1)
    named = (near.join(nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("vec_id"))
             .withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return (asking.join(named, "q").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op1_hash_prefix_forest": op1_hash_prefix_forest}
ORACLE: dict[str, str] = {}
