"""PartEnum signatures and the linking of buckets, against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from staylens.llm import linking as L
from staylens.llm import partenum as P

from .conftest import WORDS


def components(sets, linked):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                parent[root(a)] = root(b)
    return [root(x) for x in range(len(sets))]


def similar(a, b, num=90, den=100):
    return bool(len(a) and len(b)) and den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b))


@pytest.mark.parametrize("num,parts,errors", [(90, 2, 1), (90, 3, 1), (80, 4, 2), (95, 2, 1)])
def test_similar_sets_share_a_signature(num, parts, errors):
    rng, bands = np.random.default_rng(num + parts), P.Bands(num, 100, parts, errors)
    met = 0
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        cut, more = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
        if similar(a, b, num) and len(np.setxor1d(a, b)):
            met += 1
            common = Counter(x % 256 for x in set(P.signatures(a, bands).tolist()) & set(P.signatures(b, bands).tolist()))
            assert any(n >= bands.agree(band) for band, n in common.items())
    assert met > 100


@pytest.mark.parametrize("parts,errors", [(2, 1), (3, 1), (3, 2), (4, 2)])
def test_least_number_of_shared_signatures(parts, errors):
    """Against every way of spreading the differences over three groups."""
    from itertools import combinations_with_replacement
    from math import comb

    for k in range(3 * parts + 1):
        worst = min(sum(comb(parts - d, parts - errors) if d <= errors else 0 for d in spread)
                    for spread in combinations_with_replacement(range(parts + 1), 3) if sum(spread) <= k)
        assert P.agreeing(3, k, parts, errors) == worst


def test_bands_cover_every_size():
    bands = P.Bands()
    for n in range(1, 3000):
        own = bands.instances(n)
        assert bands.of(n) == own[0] and own[-1] == bands.of(n * 10 // 9)
        assert bands.differences(own[0]) >= 2 * n * 10 // 190


def documents(rng):
    """Groups of near copies at, above and below the threshold, chains, copies and short texts."""
    invented = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(5))
    texts = []
    for size, edits in [(40, 1), (40, 2), (60, 3), (25, 5)]:
        base = [rng.choice(WORDS) + rng.choice("abc") for _ in range(100)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = invented()
            texts.append(" ".join(w))
    chain = [rng.choice(WORDS) + rng.choice("abc") for _ in range(60)]
    for _ in range(30):                                              # each one like the last, the ends unlike each other
        chain[rng.randrange(60)] = invented()
        texts.append(" ".join(chain))
    passage = " ".join(rng.choice(WORDS) for _ in range(60))         # in many documents
    texts += [passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40, 80))) for _ in range(60)]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 14))) for _ in range(80)]
    texts += [texts[3].upper(), texts[3] + "  ", None, "", "  \t", "one", "ONE", "one two", "two one", "one two three"] + [texts[0]] * 20
    rng.shuffle(texts)
    return texts


def test_components_are_those_of_all_pairs(spark):
    texts = documents(random.Random(4))
    rows = [(None if i == 11 else 5 if i == 17 else i, t, "clash") for i, t in enumerate(texts)]
    got = L.classes(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(7), P.method())
    sets = [P.shingle_set(None if t is None else t.encode()) for t in texts]
    comp = components(sets, similar)
    want = Counter()
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        want[(doc_id, len(sets[i]), doc_id if not len(sets[i]) else min(ids, default=None))] += 1
    assert Counter((r["doc_id"], r["n"], r["class_id"]) for r in got.collect()) == want
    assert len(set(comp)) < len(texts) - 60


def test_prefix_pairs_lose_no_link_and_spare_near_misses(spark):
    rng = np.random.default_rng(6)
    core = rng.integers(0, 1 << 62, 100)
    sets = []
    for k in range(120):                                             # 6 of 100 changed: any two are at 0.887
        sets.append(np.concatenate([np.delete(core, rng.choice(100, 6, replace=False)), rng.integers(0, 1 << 62, 6)]))
    for k in range(40):                                              # linked ones among them
        sets.append(np.concatenate([np.delete(sets[k], rng.choice(100, 2, replace=False)), rng.integers(0, 1 << 62, int(rng.integers(0, 3)))]))
    rows = [(i, int(f)) for i, s in enumerate(sets) for f in s]
    held = spark.createDataFrame(rows, "node long, f long").cache()
    nodes = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node long, n long, comp long")
    got = {tuple(sorted(r)) for r in L.prefix_pairs(nodes, lambda some: held.join(some.select("node"), "node", "left_semi"), 0.9).collect()}
    want = {(b, a) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])}
    assert len(want) >= 40 and want <= got
    assert len(got) < 0.2 * len(sets) * (len(sets) - 1) / 2


def test_keys_that_another_row_has(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3000), i) for i in range(4000)] + [(7, 100_000 + i) for i in range(1500)]
    often = Counter(k for k, _ in rows)
    got = L.shared_keys(spark.createDataFrame(rows, "key long, node long")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if often[r[0]] > 1)
