"""The language model and its limits learn from every labelled row."""

import random

import numpy as np
from pyspark.sql import functions as F

from staylens.llm import langid as L

SYLLABLES = {"x": "ba ce di fo gu la", "y": "mo nu pe qui ra sti"}


def prose(rng, lang, n=12):
    some = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(some) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_fit_equals_one_over_all_rows_together(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "xy"[i % 5 > 2]), "xy"[i % 5 > 2]) for i in range(1200)]
    rows += [(7, prose(rng, "y"), rows[7][2]), rows[9], rows[9]]                    # a second text of an id counts by its least bits, a copy not at all
    odd = [(None, "bace", "y"), (5000, "12 34", "x"), (5001, None, "x"), (5002, "bace", None)]
    got = L.fit(table(spark, rows + odd), F.lit(True))
    bits = {}
    for i, text, lang in rows:
        one = np.packbits(L.presence(text)).tobytes()
        bits[i, lang] = min(one, bits.get((i, lang), one))
    order = {r["doc_id"]: r["h"] for r in table(spark, rows).select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    keys = sorted(bits, key=lambda k: order[k[0]])
    want = L.train(np.stack([np.frombuffer(bits[k], np.uint8) for k in keys]), [k[1] for k in keys])
    assert got.languages == want.languages == ["x", "y"]
    assert np.allclose(got.weights, want.weights, atol=1e-5) and np.allclose(got.intercept, want.intercept, atol=1e-5)


def test_limits_come_from_every_row_but_one_in_a_thousand(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, "xy"[i % 5 > 3], 30), "xy"[i % 5 > 3]) for i in range(1600)]
    model = L.fit(table(spark, rows[:200]), F.lit(True))
    seen, real = [], L.class_limits
    monkeypatch.setattr(L, "class_limits", lambda clean, noise: seen.append((clean, noise)) or real(clean, noise))
    plain = L.limits(table(spark, rows), model, F.lit(True))
    values = {True: {}, False: {}}
    for _, text, lang in rows:
        for noise, (name, k, v) in ((False, *model.fits([text])), (True, *model.fits([L.shuffled(text)]))):
            if noise or name == lang:
                values[noise].setdefault(k, []).append(v)
    for noise, got in zip((False, True), seen[0]):
        assert {k: n for k, (n, _) in got.items()} == {k: len(v) for k, v in values[noise].items()}
        for k, (n, end) in got.items():
            assert abs(end - sorted(values[noise][k], reverse=noise)[n // L.TAIL]) < 1e-5
    assert all(max(map(len, v.values())) > L.TAIL for v in values.values())
    assert plain == real(*seen[0])
