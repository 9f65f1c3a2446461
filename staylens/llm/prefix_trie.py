"""Prefix trie of conversations in adaptive radix trees.

A turn is a fixed-width id of ``WIDTH`` bytes: the UTF-8 length of its text as a
big-endian number, then 128 bits of SHA-256 of role and text. A conversation is
the concatenation of its turns' ids, so bytewise order is trie order. Keys are
dealt out in ranges of that order; each task inserts its range into an adaptive
radix tree (layouts for 4, 16, 48 and 256 children that grow when full,
compressed paths) and walks it bottom-up. Branches inside an id are not nodes:
only byte depths that are whole turns emit one (``grow``).

A node whose prefix doesn't begin the first or the last key of a range has all
its members in that range and is final. The others are open; what a task knows
of them is one item each, which goes to the next round like a conversation, in
fewer ranges, until one range is left. A round passes on at most two paths per
range, and never more bytes than it read. Frequent first turns and copies are
split like any other keys (equal keys by conv_id).

What moves: ids (``WIDTH`` bytes a turn) and conversation numbers, never texts. The
driver holds Spark's range bounds. One conversation's key must fit in a task (2 MB
for 100,000 turns). The hash of a node's ends is sequential by definition; for
open nodes one task streams their packed numbers in order.

Edge cases: rows with a null conv_id belong to no conversation; null turns come
first; rows that repeat a turn number are ordered by role, the text's first 64
characters, then the id; null role or text is empty; negative conv_ids are
rounded towards zero to their source; turnless conversations are members of the
root; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

#: Bytes of a turn id: text length, digest.
LENGTH, DIGEST = 4, 16
WIDTH = LENGTH + DIGEST
#: A conversation copies turns of the first of SHARED neighbours, at most MOST - 1 of them.
SHARED, MOST = 5, 9
#: Key bytes of a range; less if tasks would stand idle.
RANGE_BYTES, LEAST_BYTES = 16 << 20, 256 << 10
CHUNK_IDS = 65_536
NODE, ITEM, ENDS = 0, 1, 2
_ITEM = "key binary, conv_id long, n long, children long, leaves long, saved long, ends boolean"
_ROW = ("kind int, key binary, conv_id long, n long, children long, leaves long, saved long, "
        "depth long, parent_conv_id long, digest binary, parent_digest binary, ends_sha256 string, ids binary")
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


# -- the tree --------------------------------------------------------------------------------------------------------

class Sorted:
    """Layouts 4 and 16: labels in order, children beside them."""

    def __init__(self, room: int):
        self.room, self.labels, self.kids = room, bytearray(), []

    def get(self, label: int):
        at = self.labels.find(label)
        return self.kids[at] if at >= 0 else None

    def put(self, label: int, kid) -> None:
        at = bisect_left(self.labels, label)
        if at < len(self.labels) and self.labels[at] == label:
            self.kids[at] = kid
        else:
            self.labels.insert(at, label)
            self.kids.insert(at, kid)

    def items(self):
        return zip(self.labels, self.kids)

    def __len__(self):
        return len(self.kids)


class Indexed:
    """Layout 48: a place for every label that says where its child is."""

    room = 48

    def __init__(self):
        self.places, self.kids = bytearray(256), []

    def get(self, label: int):
        return self.kids[self.places[label] - 1] if self.places[label] else None

    def put(self, label: int, kid) -> None:
        if self.places[label]:
            self.kids[self.places[label] - 1] = kid
        else:
            self.kids.append(kid)
            self.places[label] = len(self.kids)

    def items(self):
        return ((x, self.kids[p - 1]) for x, p in enumerate(self.places) if p)

    def __len__(self):
        return len(self.kids)


class Direct:
    """Layout 256: the label is the child's place."""

    room = 256

    def __init__(self):
        self.kids, self.n = [None] * 256, 0

    def get(self, label: int):
        return self.kids[label]

    def put(self, label: int, kid) -> None:
        self.n += self.kids[label] is None
        self.kids[label] = kid

    def items(self):
        return ((x, kid) for x, kid in enumerate(self.kids) if kid is not None)

    def __len__(self):
        return self.n


def _wider(layout):
    out = Sorted(16) if layout.room == 4 else Indexed() if layout.room == 16 else Direct()
    for label, kid in layout.items():
        out.put(label, kid)
    return out


class Node:
    """path: the bytes from the parent's end to this node, its label first; own:
    what is known of the key that ends here."""

    __slots__ = ("path", "layout", "own")

    def __init__(self, path: bytes):
        self.path, self.layout, self.own = path, Sorted(4), None

    def add(self, kid: "Node") -> None:
        if len(self.layout) == self.layout.room:
            self.layout = _wider(self.layout)
        self.layout.put(kid.path[0], kid)


def shared(a: bytes, b: bytes) -> int:
    """Number of leading bytes that are equal."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:                                                  # a[:lo] is equal, a[:hi] isn't
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def insert(root: Node, key: bytes) -> Node:
    """The node at which ``key`` ends, made if need be."""
    node, at = root, 0
    while at < len(key):
        kid = node.layout.get(key[at])
        if kid is None:
            kid = Node(key[at:])
            node.add(kid)
            return kid
        same = shared(kid.path, key[at:at + len(kid.path)])
        if same < len(kid.path):                                        # part of a compressed path: split it
            upper = Node(kid.path[:same])
            kid.path = kid.path[same:]
            upper.add(kid)
            node.layout.put(key[at], upper)
            kid = upper
        node, at = kid, at + same
    return node


class Sum:
    """What lies at or below a place of the tree and isn't passed on as an item: conversations, the least
    of them, whole-turn children, childless nodes, saved bytes, and the rows that wait for their parent."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "waiting", "ends")

    def __init__(self):
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.waiting, self.ends = None, [], None

    def add(self, n, least, children, leaves, saved):
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved


def ids_sha256(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class Walk:
    """Bottom-up walk over a tree; ``rows`` are what it has to say (columns as in ``_ROW``)."""

    def __init__(self, first: bytes, last: bytes, whole: bool, later: bool):
        #: Keys whose prefixes are open; all nodes are final if the tree is whole. In later rounds nodes carry a digest.
        self.bounds, self.whole, self.later = (first, last), whole, later
        self.rows: list[list] = []
        self.trail, self.hashes = bytearray(), [hashlib.sha256()]

    def digest(self, depth: int) -> bytes:
        while len(self.hashes) <= depth:
            at = (len(self.hashes) - 1) * WIDTH
            self.hashes.append(self.hashes[-1].copy())
            self.hashes[-1].update(self.trail[at:at + WIDTH])
        return self.hashes[depth].digest()[:DIGEST]

    def emit(self, depth: int, s: Sum, is_open: bool) -> Sum:
        """The node of ``depth`` turns on the trail, ``s`` lying below; returns what its parent sees."""
        up = Sum()
        if is_open:
            mark = self.digest(depth)
            for at in s.waiting:
                self.rows[at][10] = mark
            if s.n:
                self.rows.append([ITEM, bytes(self.trail[:depth * WIDTH]), s.least, s.n, s.children, s.leaves, s.saved, depth,
                                  None, mark, None, None, None])
            for k in range(0, len(s.ends or ()), CHUNK_IDS):
                part = s.ends[k:k + CHUNK_IDS]
                self.rows.append([ENDS, None, part[0], len(part), 0, 0, 0, depth, None, mark, None, None, part.tobytes()])
            return up
        size = int.from_bytes(self.trail[(depth - 1) * WIDTH:(depth - 1) * WIDTH + LENGTH]) if depth else 0
        leaves, saved = s.leaves if s.children else 1, s.saved + (s.n - 1) * size
        for at in s.waiting:
            self.rows[at][8] = s.least
        up.add(s.n, s.least, 1, leaves, saved)
        up.waiting.append(len(self.rows))
        self.rows.append([NODE, None, s.least, s.n, s.children, leaves, saved, depth, None, self.digest(depth) if self.later else None,
                          None, None if self.later else ids_sha256(s.ends or ()), None])
        return up

    def leave(self, node: Node, start: int, s: Sum, limit: int) -> Sum:
        """Emits the whole-turn depths of the node's path (bytes start to the trail's end), deepest first."""
        if node.own is not None:
            o = node.own
            s.add(o.n, o.least, o.children, o.leaves, o.saved)
            s.ends = o.ends
        for depth in range(len(self.trail) // WIDTH, start // WIDTH, -1):
            s = self.emit(depth, s, depth * WIDTH <= limit)
        del self.trail[max(start, 0):]
        del self.hashes[max(start, 0) // WIDTH + 1:]
        return s

    def run(self, root: Node) -> None:
        limit = -1 if self.whole else 0
        frames = [(root, -1, iter(list(root.layout.items())), Sum(), limit, (not self.whole,) * 2)]
        while frames:
            node, start, kids, s, limit, on = frames[-1]
            kid = next(kids, (0, None))[1]
            if kid is None:
                frames.pop()
                up = self.leave(node, start, s, limit)
                if frames:
                    t = frames[-1][3]
                    t.add(up.n, up.least, up.children, up.leaves, up.saved)
                    t.waiting += up.waiting
                continue
            at = len(self.trail)
            same = [shared(kid.path, b[at:at + len(kid.path)]) if o else 0 for o, b in zip(on, self.bounds)]
            limit = max([at + m for o, m in zip(on, same) if o], default=-1)
            self.trail += kid.path
            frames.append((kid, at, iter(list(kid.layout.items())), Sum(), limit, tuple(o and m == len(kid.path) for o, m in zip(on, same))))


def grow(whole: bool, later: bool):
    """A task of a round: items sorted by (key, conv_id) in, rows out."""
    def run(batches):
        import pyarrow as pa

        root, first, last = Node(b""), None, None
        for b in batches:
            for key, conv, n, children, leaves, saved, ends in zip(*(c.to_pylist() for c in b.columns)):
                first, last = key if first is None else first, key
                node = insert(root, key)
                if node.own is None:
                    node.own = Sum()
                    node.own.ends = array("q")
                node.own.add(n, conv, children, leaves, saved)
                if ends:
                    node.own.ends.append(conv)
        if first is None:
            return
        walk = Walk(first, last, whole, later)
        walk.run(root)
        schema = _arrow_schema(pa)
        for k in range(0, len(walk.rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*walk.rows[k:k + 20_000]), schema)], schema=schema)

    return run


def _arrow_schema(pa):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _ROW.split(", "))])


# -- the jobs --------------------------------------------------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0"), F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * DIGEST)))


def rebuilt(conversations: DataFrame, neighbours: int = SHARED, most: int = MOST) -> DataFrame:
    """conv_id and key of every conversation after it has taken the first h turns of
    its source (conv_id without its remainder by ``neighbours``) in place of its own
    first h, h being crc32(conv_id) modulo ``most``; stored."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(conv.isNotNull()).select(
        (conv - conv % neighbours).alias("base"), conv.alias("conv"), (F.crc32(conv.cast("string").cast("binary")) % most).cast("int").alias("h"),
        F.col("turn").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("begin"), turn_id(role, text).alias("id"))
    # a source comes before the conversations that copy it
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "begin", "id")

    def run(batches):
        import pyarrow as pa

        out, size = [], 0
        source, base, conv, h, own = [], None, None, 0, []

        def done():
            nonlocal source
            if conv == base:
                source = own[:most]
                return conv, b"".join(own)
            return conv, b"".join(source[:h] + own[h:])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([k for _, k in out], pa.binary())], names=["conv_id", "key"])

        for b in batches:
            for base_of, c, hc, t in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv:
                    if conv is not None:
                        out.append(done())
                        size += len(out[-1][1])
                        if size > 8 << 20 or len(out) >= 10_000:
                            yield batch()
                            out, size = [], 0
                    if base_of != base:
                        source, base = [], base_of
                    conv, h, own = c, hc, []
                own.append(t)
        if conv is not None:
            out.append(done())
            yield batch()

    return stored(rows.select("base", "conv", "h", "id").mapInArrow(run, "conv_id long, key binary"), "trie-keys")


def _ranges(items: DataFrame) -> tuple[int, int]:
    """(key bytes with what a row adds, ranges to deal them out in)."""
    size = items.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    idle = min(items.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES)
    return size, max(1, -(-size // RANGE_BYTES), idle)


def trie(keys: DataFrame) -> DataFrame:
    """The nodes of the trie over ``keys`` (conv_id, key): conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    items = keys.select("key", "conv_id", F.lit(1).cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")],
                        F.lit(True).alias("ends"))
    rounds, size = [], None
    while True:
        before, (size, n) = size, _ranges(items)
        if before is not None and size > before // 2:                   # one path makes up nearly all of it
            n = 1
        dealt = items.repartitionByRange(n, "key", "conv_id") if n > 1 else items.coalesce(1)
        rounds.append(stored(dealt.sortWithinPartitions("key", "conv_id").mapInArrow(grow(n == 1, bool(rounds)), _ROW), "trie-round"))
        if n == 1:
            break
        items = rounds[-1].where(F.col("kind") == ITEM).select("key", "conv_id", "n", "children", "leaves", "saved", F.lit(False).alias("ends"))
    nodes = reduce(DataFrame.unionByName, [r.where(F.col("kind") == NODE) for r in rounds])
    if len(rounds) > 1:
        nodes = _joined(nodes, rounds[0].where(F.col("kind") == ENDS))
    return nodes.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def _joined(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Gives nodes that were open the hash of their ends, and nodes below them their parent."""
    def run(batches):
        import pyarrow as pa

        mark, sha, out = None, None, []
        for b in batches:
            for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest != mark:
                    if mark is not None:
                        out.append((mark, sha.hexdigest()))
                    mark, sha = digest, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, memoryview(ids).cast("q"))).encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["digest", "sha"])
                out = []
        if mark is not None:
            out.append((mark, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["digest", "sha"])

    hashes = ends.repartition("digest").sortWithinPartitions("digest", "conv_id").select("digest", "ids").mapInArrow(run, "digest binary, sha string")
    final = nodes.where(F.col("digest").isNull()).unionByName(
        nodes.where(F.col("digest").isNotNull()).join(hashes, "digest", "left")
        .withColumn("ends_sha256", F.coalesce("sha", F.lit(ids_sha256([])))).drop("sha"))
    names = nodes.where(F.col("digest").isNotNull()).select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("above"))
    return final.where(F.col("parent_digest").isNull()).unionByName(
        final.where(F.col("parent_digest").isNotNull()).join(names, "parent_digest", "left").withColumn("parent_conv_id", F.col("above")).drop("above"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(read_table(spark, sf_dir, "conversations")))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
_SQL_CRC_TABLE = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b)))"
ORACLE = {"op12_prefix_trie": f"""
WITH crc_table AS MATERIALIZED (SELECT {_SQL_CRC_TABLE} AS tab),
said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS MATERIALIZED (
  SELECT c, id, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), size, id) AS p
  FROM (SELECT *, octet_length(encode(text)) AS size, sha256(octet_length(encode(role)) || ':' || role || text) AS id FROM said)),
convs AS MATERIALIZED (
  SELECT c, c - c % {SHARED} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'),
    lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295) % {MOST} AS h
  FROM (SELECT DISTINCT c FROM said), crc_table),
rebuilt AS (
  SELECT v.c, 0 AS part, t.p, t.id, t.size FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
  UNION ALL SELECT v.c, 1, t.p, t.id, t.size FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h),
conv AS MATERIALIZED (
  SELECT v.c, coalesce(r.ids, []) AS ids, coalesce(r.sizes, []) AS sizes
  FROM convs v LEFT JOIN (SELECT c, list(id ORDER BY part, p) AS ids, list(size ORDER BY part, p) AS sizes FROM rebuilt GROUP BY c) r USING (c)),
member AS MATERIALIZED (
  SELECT c, d, len(ids) = d AS ends, array_to_string(ids[1:d], ',') AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM conv)),
node AS MATERIALIZED (
  SELECT d, path, min(c) AS c, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY d, path),
up AS MATERIALIZED (SELECT *, CASE WHEN d > 0 THEN d - 1 END AS pd, substr(path, 1, greatest(65 * (d - 1) - 1, 0)) AS ppath FROM node),
kids AS MATERIALIZED (SELECT pd AS d, ppath AS path, count(*) AS k FROM up WHERE pd IS NOT NULL GROUP BY pd, ppath),
own AS (SELECT u.*, coalesce(k.k, 0) AS k FROM up u LEFT JOIN kids k USING (d, path)),
below AS (
  SELECT a AS d, substr(path, 1, greatest(65 * a - 1, 0)) AS path, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1, 2)
SELECT o.c::BIGINT AS conv_id, o.d::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, o.n::BIGINT AS n_convs, o.k::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN below b USING (d, path) LEFT JOIN node p ON p.d = o.pd AND p.path = o.ppath"""}
