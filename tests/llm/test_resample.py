"""Importance resampling: its parts, against plain Python and full sorts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staylens.llm import resample as R

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, width):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_features(width):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB9 .\n\x85É語-_z") for _ in range(rng.randrange(60)))
        n, runs = plain_features(text, width)
        got_n, got = R.features(text.encode(), width, 1000)
        assert got_n == n and sorted(got.tolist()) == sorted(zlib.crc32(f.encode()) % 1000 for f in runs)
    assert R.features(None)[0] == 0 and len(R.features(b"?!")[1]) == 0


def test_every_score_and_rank(spark, tables, edge_dir):
    docs, target = tables["documents"], tables["benchmark"]
    s = Counter(zlib.crc32(f.encode()) % 10000 for r in docs for f in plain_features(r["text"] or "", 2)[1])
    t = Counter(zlib.crc32(f.encode()) % 10000 for r in target for f in plain_features(r["text"] or "", 2)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    want = []
    for r in docs:
        n, runs = plain_features(r["text"] or "", 2)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in (zlib.crc32(f.encode()) % 10000 for f in runs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        want.append((r["doc_id"], n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = Counter((x[0], x[2], x[3], x[4], k + 1) for k, x in enumerate(able[:25 * len(able) // 100]))
    got = [tuple(r) for r in R.op11_resample(spark, edge_dir).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert Counter(r[:4] for r in got) == Counter((x[0], *x[2:]) for x in want)
    assert Counter(r for r in got if r[4] is not None) == drawn


@pytest.mark.parametrize("accuracy", [10_000, 3])
@pytest.mark.parametrize("k", [1, 2, 499, 1000, 1999, 2000])
def test_bracket_holds_the_rank(spark, k, accuracy):
    values = [random.Random(k).choice([5, 5, 5, x % 97, x]) for x in range(2000)]
    scores = spark.createDataFrame([(v,) for v in values], "score long")
    lo, hi, above = R.bracket(scores, k, len(values), accuracy)         # a coarse sketch must be widened, not believed
    cut = sorted(values, reverse=True)[k - 1]
    assert lo <= cut <= hi and above == sum(v > hi for v in values)


def test_ties_are_cut_by_id(spark):
    rows = [(None if i == 7 else i, f"m{i}", 30, 1, 0, 5 if i % 3 else 9) for i in range(90)] + [(50, "m50", 30, 1, 0, 5)] * 3
    scores = spark.createDataFrame(rows, "doc_id long, text_md5 string, n_words long, n_features long, weight long, score long")
    got = R.draw(scores, percent=50).collect()
    order = sorted(rows, key=lambda r: (-r[5], r[0] is None, r[0] or 0, r[1]))
    k = len(rows) // 2
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, k + 1)) and len(got) == len(rows)
    assert Counter(r["doc_id"] for r in got if r["rank"]) == Counter(r[0] for r in order[:k])


def test_resampling_leans_towards_the_target(spark):
    rng = random.Random(2)
    near, far = "alpha beta gamma delta".split(), "one two three four".split()
    text = lambda w: " ".join(rng.choice(w) for _ in range(40))
    docs = spark.createDataFrame([(i, text(near if i % 10 == 0 else far), "x") for i in range(1000)], "doc_id long, text string, score string")
    target = spark.createDataFrame([(text(near),) for _ in range(20)], "text string")
    out = R.resample(docs, target, percent=10)
    assert out.columns == docs.columns and out.count() == 100
    assert out.where(F.col("doc_id") % 10 == 0).count() >= 80
