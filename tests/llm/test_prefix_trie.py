"""Adaptive radix trees and the rounds that join their ranges, against plain Python."""

import random
from collections import defaultdict

import pytest

from staylens.llm import prefix_trie as P


def plain_nodes(keys):
    w, members, ends, kids, leaves, saved = P.WIDTH, defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, key in keys:
        for d in range(len(key) // w + 1):
            members[key[:d * w]].append(c)
        ends[key].append(c)
    for p in members:
        if p:
            kids[p[:-w]] += 1
    for p in members:
        for d in range(len(p) // w + 1):
            leaves[p[:d * w]] += kids[p] == 0
            saved[p[:d * w]] += (len(members[p]) - 1) * (int.from_bytes(p[-w:-w + 4]) if p else 0)
    return sorted(((min(m), len(p) // w, min(members[p[:-w]]) if p else None, len(m), kids[p], leaves[p], saved[p], P.ids_sha256(sorted(ends[p])))
                   for p, m in members.items()), key=str)


def some_keys(rng, n):
    def turn(k):
        return bytes([0, 0, 0, k]) + bytes([rng.choice([0, 7])] * 3) + b"z" * 13

    out = []
    for c in range(n):
        if rng.random() < 0.6:
            out.append((c, b"".join(turn(rng.randrange(3)) for _ in range(rng.choice([0, 1, 2, 3, 5, 30])))))
        else:                                                        # a third of all: copies and their prefixes
            out.append((c, (b"\0\0\0\1" + b"q" * 16) * rng.choice([4, 4, 4, 9])))
    return out


@pytest.mark.parametrize("size", [None, 20_000, 4_000, 100])
def test_nodes_whatever_the_ranges(spark, monkeypatch, size):
    keys = some_keys(random.Random(1), 1200)
    if size:                                                         # many ranges, rounds of open nodes; 100: a key or two in each
        monkeypatch.setattr(P, "RANGE_BYTES", size)
    df = spark.createDataFrame(keys[:150] if size == 100 else keys, "conv_id long, key binary")
    assert sorted(map(tuple, P.trie(df).collect()), key=str) == plain_nodes(keys[:150] if size == 100 else keys)


def test_layouts_grow_and_find():
    root, rng = P.Node(b""), random.Random(2)
    keys = [bytes([x]) + bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for x in range(256)] + [b"\x05\x01\x02\x03", b"\x05\x01\x02", b"\x05\x01"]
    rng.shuffle(keys)
    kinds = set()
    for k, key in enumerate(keys):
        P.insert(root, key).own = key
        kinds.add((type(root.layout).__name__, root.layout.room))
        for seen in keys[:k + 1]:
            assert P.insert(root, seen).own == seen
    assert kinds == {("Sorted", 4), ("Sorted", 16), ("Indexed", 48), ("Direct", 256)} and len(root.layout) == 256
    assert [label for label, _ in root.layout.items()] == list(range(256))


def test_shared_prefix_length():
    rng = random.Random(3)
    for _ in range(500):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        b = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert P.shared(a, b) == want


def test_rebuilt_takes_turns_of_its_source(spark, tables, edge_dir):
    import zlib

    own = defaultdict(list)
    for r in tables["conversations"]:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", (r["text"] or "")[:64], len((r["text"] or "").encode())))
    got = {r["conv_id"]: r["key"] for r in P.rebuilt(spark.read.parquet(f"{edge_dir}/conversations.parquet")).collect()}
    assert got.keys() == own.keys()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = own.get(int(c / 5) * 5, [])                         # rounded towards zero
        want = [t[4] for t in sorted(source)[:h] + sorted(turns)[h:]]
        assert [int.from_bytes(got[c][i:i + 4]) for i in range(0, len(got[c]), P.WIDTH)] == want
