"""From buckets of candidates to classes of linked nodes, without pairing a bucket's members.

A bucket holds nodes that may be similar; every pair that is linked shares a
bucket. In each round a bucket's member with the most candidates leads: it is
compared with the members that aren't in its class yet and then leaves the
bucket. Buckets whose members are in one class are done. What is left after
``rounds`` goes through a prefix filter (``prefix_pairs``), which is exact for
any similarity of at least ``t`` between sets: features are ordered by how many
of the left nodes have them, and two nodes meet only if they share one among
their rarest and if what follows its places in both orders can suffice. Members of
a group that are just below the threshold have too many features of their own
to meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Up to so many ids the documents that are read again are picked by a broadcast.
BROADCAST_ROWS = 500_000
#: Members compared with one copy of their leader.
CELL = 500
#: Digests a task remembers.
SEEN = 200_000
#: Texts or forms in an Arrow batch.
BATCH_ROWS = 500


@dataclass
class Method:
    """What a join has of its own. A document's form is what is compared, as bytes."""

    #: text (bytes or None) -> (digest of the form, None if there is nothing to compare; number of features; form)
    encode: Callable[[bytes | None], tuple[bytes | None, int, bytes]]
    #: form -> bucket keys, 64-bit; linked documents share one
    keys: Callable[[bytes], np.ndarray]
    #: Whether two forms are linked
    similar: Callable[[bytes, bytes], bool]
    #: form -> distinct features, 64-bit; linked documents' features have a Jaccard similarity of ``t`` or more
    features: Callable[[bytes], np.ndarray]
    t: float
    #: Of a key column: (a group of keys, how many of the group linked documents share at least)
    agree: Callable[[Column], tuple[Column, Column]] | None = None


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in ``links`` (a, b): every node moves to its least
    neighbour (pointers are doubled once), edges are contracted, until none is left."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    moves = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "moves")
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = stored(step.join(ahead, "to", "left").select("node", F.coalesce("then", "to").alias("to")), "moves")
        moves.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), "edges")
    if not moves:
        return links.sparkSession.createDataFrame([], "node long, comp long")
    out = moves[0].select("node", F.col("to").alias("comp"))
    for step in moves[1:]:
        out = out.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(out, "components")


def needed(a, b, t: float) -> Column:
    """Common features that two sets of so many need (with room for rounding)."""
    return t / (1 + t) * (F.col(a) + F.col(b)) - 1e-6


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another row has too; one shuffle, keys are streamed in order."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, again = [np.zeros(0, np.int64)] * 2, False             # the last row seen, and whether it is one to keep
        for b in batches:
            key, node = (np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for c, h in enumerate(held))
            if not len(key):
                continue
            equal = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= equal
            keep[:-1] |= equal
            keep[0] |= again
            held, again = [key[-1:], node[-1:]], bool(keep[-1])
            at = np.flatnonzero(keep[:-1])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at])], names=["key", "node"])
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["key", "node"])

    return rows.select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def _several(rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, comp) of the buckets that hold more than one class; stored."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return stored(rows.join(keys, "key", "left_semi"), "link-mixed")


def described(docs: DataFrame, method: Method) -> DataFrame:
    """row, doc_id, text_md5, same (digest of the form), n and keys (null where the
    task had the form before, or there are none) of every document; stored."""
    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_md5"), text.alias("text"))

    def run(batches):
        import pyarrow as pa

        seen, row = set(), TaskContext.get().partitionId() << 33
        for b in batches:
            same, n, keys = [], [], []
            for text in b.column(2).to_pylist():
                mark, size, form = method.encode(text)
                own = None
                if mark is not None and mark not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(mark)
                    own = method.keys(form)
                same.append(mark)
                n.append(size)
                keys.append(own if own is not None and len(own) else None)
            at = pa.array(np.arange(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays([at, b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["row", "doc_id", "text_md5", "same", "n", "keys"])

    return stored(rows.mapInArrow(run, "row long, doc_id long, text_md5 string, same binary, n long, keys array<long>"), "link-rows", BATCH_ROWS)


def forms_of(docs: DataFrame, asked: DataFrame, method: Method) -> DataFrame:
    """(node, form) of the ``asked`` nodes (node, doc_id, same), read from the texts again; stored."""
    wanted = asked.select(F.col("doc_id").alias("asked_id")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [method.encode(text) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _, _ in found], pa.binary()), pa.array([f for _, _, f in found], pa.binary())], names=["same", "form"])

    found = rows.select("text").mapInArrow(run, "same binary, form binary")
    one = found.join(asked.select("node", "same"), "same").groupBy("same").agg(F.min("node").alias("node"), F.min("form").alias("form"))
    return stored(one.select("node", "form"), "link-forms", BATCH_ROWS)


def _some(forms: DataFrame, nodes: DataFrame) -> DataFrame:
    """``forms`` of ``nodes`` (one column); forms don't move if the ids can be broadcast."""
    nodes = nodes.toDF("node").distinct()
    return forms.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "node", "left_semi")


def verified(pairs: DataFrame, forms: DataFrame, method: Method) -> DataFrame:
    """The pairs (x, y) that are linked, as (a, b); stored. A leader x meets its
    partners in cells of about ``CELL``, for each of which its form is sent once."""
    cells = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    side = lambda c: _some(forms, pairs.select(c)).select(F.col("node").alias(c), "form")
    dealt = stored(pairs.join(cells, "x").select("x", "y", F.pmod(F.xxhash64("y"), "cells").alias("cell")), "link-cells")
    leaders = dealt.select("x", "cell").distinct().join(side("x"), "x").select("x", "cell", F.lit(None).cast("long").alias("y"), "form")
    rows = leaders.unionByName(dealt.join(side("y"), "y").select("x", "cell", "y", "form"))

    def run(batches):
        import pyarrow as pa

        left = None
        for batch in batches:
            a, b = [], []
            for x, y, form in zip(*(c.to_pylist() for c in batch.columns)):
                if y is None:
                    left = form
                elif method.similar(left, form):
                    a.append(min(x, y))
                    b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.repartition("x", "cell").sortWithinPartitions("x", "cell", F.col("y").asc_nulls_first()).select("x", "y", "form")
    return stored(rows.mapInArrow(run, "a long, b long"), "link-links", BATCH_ROWS)


def features_of(nodes: DataFrame, forms: DataFrame, method: Method) -> DataFrame:
    """(node, f): the features of ``nodes``."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for node, form in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = method.features(form).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), node), pa.int64()), pa.array(f)], names=["node", "f"])

    return _some(forms, nodes.select("node")).select("node", "form").mapInArrow(run, "node long, f long")


def classes(docs: DataFrame, method: Method) -> DataFrame:
    """One row per document: doc_id, text_md5, n, class_id (smallest doc_id that links
    reach, null if there is none) and kept (of each class the rows that equal, in doc_id and
    text, its first by doc_id, null last, and text_md5). Rows with nothing to compare are
    classes by doc_id and text."""
    rows = described(docs, method)
    equal = rows.where(F.col("same").isNotNull()).groupBy("same").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("first"))
    nodes = stored(equal, "link-nodes")
    keyed = rows.where(F.col("keys").isNotNull())
    # forms that several tasks have seen are one node
    other = keyed.select("row", "same").join(nodes, "same").where("row <> node").select("row", F.col("node").alias("one"))
    members = shared_keys(keyed.select(F.explode("keys").alias("key"), F.col("row").alias("node"))).join(other, F.col("node") == F.col("row"), "left")
    members = stored(members.select("key", F.coalesce("one", "node").alias("node")).distinct(), "link-buckets")
    several = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    members = members.join(several, "key")
    if method.agree:
        # a node that shares too few keys with any others has no link
        group, least = method.agree(F.col("key"))
        enough = members.groupBy("node", group.alias("group"), least.alias("least")).agg(F.count(F.lit(1)).alias("n")).where("n >= least")
        members = members.withColumn("group", group).join(enough.select("node", "group"), ["node", "group"], "left_semi").select("key", "node")
    members = stored(members, "link-members")
    named = rows.select(F.col("row").alias("node"), "doc_id", "same", "n")
    asked = stored(named.join(members.select("node").distinct(), "node"), "link-asked")
    forms = forms_of(docs, asked, method)
    comp = link(members.join(asked.select("node", "n"), "node"), lambda pairs: verified(pairs, forms, method),
                lambda some: features_of(some, forms, method), method.t)
    classed = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = classed.groupBy("comp").agg(F.min("least").alias("class_id"), F.min("first").alias("best"))
    by_same = classed.join(whole, "comp").select("same", "class_id", "best")
    own = F.col("same").isNull()
    kept = own | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_md5").eqNullSafe(F.col("best.text_md5")))
    return rows.select("doc_id", "text_md5", "same", "n").join(by_same, "same", "left").select(
        "doc_id", "text_md5", "n", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], features: Callable[[DataFrame], DataFrame], t: float, rounds: int = 2) -> DataFrame:
    """(node, comp) of the nodes that have a link.

    members: (key, node, n), n the node's number of features; verify: the pairs
    (x, y) that are linked, as (a, b); features: (node, f) of nodes (node)."""
    links, comp, tested = None, None, None

    def classed(rows):
        if comp is None:
            return rows.select("key", "node", "n", F.col("node").alias("comp"))
        return rows.select("key", "node", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def compared(pairs):
        nonlocal links, comp, tested
        a, b = F.least("x", "y"), F.greatest("x", "y")
        if tested is not None:
            pairs = pairs.withColumns({"a": a, "b": b}).join(tested, ["a", "b"], "left_anti").select("x", "y")
        pairs = stored(pairs, "link-pairs")
        now = pairs.select(a.alias("a"), b.alias("b"))
        tested = now if tested is None else tested.unionByName(now)
        found = verify(pairs)
        links = found if links is None else links.unionByName(found)
        comp = components(links)

    rows = _several(classed(members))
    for _ in range(rounds):
        if not rows.limit(1).count():
            break
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        degree = rows.join(sizes, "key").groupBy("node").agg(F.sum("m").alias("degree"))
        # the member with the most candidates is the likeliest to be what the others are copies of
        lead = (rows.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))).alias("lead"))
                .select("key", "lead.x", "lead.nx", "lead.cx"))
        led = stored(rows.join(lead, "key").where("node <> x"), "link-led")
        near = F.least("n", "nx") >= needed("n", "nx", t)
        compared(led.where((F.col("comp") != F.col("cx")) & near).select("x", F.col("node").alias("y")).distinct())
        rows = _several(classed(led))
    if rows.limit(1).count():
        compared(prefix_pairs(rows.select("node", "n", "comp").distinct(), features, t))
    return comp if comp is not None else members.sparkSession.createDataFrame([], "node long, comp long")


def prefix_pairs(nodes: DataFrame, features: Callable[[DataFrame], DataFrame], t: float) -> DataFrame:
    """Pairs (x, y) of ``nodes`` (node, n, comp) in different classes that may be similar by ``t``.

    A set of n features needs ceil(t n) of them in common with any partner, and
    ceil(2t / (1 + t) n) with one that isn't smaller. So in one order of all features
    two similar sets share one among the smaller's first n - ceil(2t / (1 + t) n) + 1 and
    the larger's first n - ceil(t n) + 1; the first one they share has all the others
    after it in both."""
    longer = F.floor(F.col("n") * (1 - t) + 1e-6) + 1
    shorter = F.floor(F.col("n") * (1 - 2 * t / (1 + t)) + 1e-6) + 1
    held = features(nodes)
    alone = (held.groupBy("f").agg(F.count(F.lit(1)).alias("m"), F.max("node").alias("node")).where("m = 1")
             .groupBy("node").agg(F.count(F.lit(1)).alias("alone")))
    # features that no other node has come first in the order
    able = stored(nodes.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).where(F.col("alone") < longer), "link-able", BATCH_ROWS)
    rows = features(able)
    common = rows.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    place = F.row_number().over(Window.partitionBy("node").orderBy("m", "f"))
    rows = rows.join(common, "f").withColumn("place", place).join(able, "node").withColumn("place", F.col("place") + F.col("alone"))
    rows = stored(rows.where(F.col("place") <= longer).select("f", "node", "n", "comp", "place", (F.col("place") <= shorter).alias("first")), "link-places", BATCH_ROWS)
    x = rows.where("first").select("f", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("place").alias("px"))
    y = rows.select("f", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("place").alias("py"))
    smaller = F.struct("nx", "x") < F.struct("ny", "y")
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    return x.join(y, "f").where((F.col("cx") != F.col("cy")) & smaller & (rest >= needed("nx", "ny", t))).select("x", "y").distinct()
