"""What a Python worker holds in the pipeline's language stage, and how many workers a core has."""

import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline as P
from staylens.llm import langid as L

from .test_language_fit import prose


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    return L.Model(["x", "y"], rng.standard_normal((L.WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32))


def test_scoring_holds_few_texts_at_once_and_gives_their_own_values(model):
    rng = random.Random(6)
    texts = [prose(rng, "xy"[i % 2], 30) for i in range(600)]
    for work in (model.fits, model.predict):
        tracemalloc.start()
        work(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 * 2**20
    one = [model.fits([t])[0] for t in texts]
    assert [x[:2] for x in model.fits(texts)] == [x[:2] for x in one]
    assert np.allclose([x[2] for x in model.fits(texts)], [x[2] for x in one], atol=1e-4)


def test_shuffled_texts_are_made_a_few_at_a_time(spark, model, monkeypatch):
    rng = random.Random(7)
    rows = [(i, prose(rng, "xy"[i % 2], 30), "xy"[i % 2]) for i in range(200)]
    plans, stored = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    L.limits(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, L.F.lit(True))
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Pandas" not in plans[0]


def test_ids_and_texts_are_made_in_stages_of_their_own(spark):
    docs = spark.createDataFrame([(1, "some words, é", "x", "a"), (2, None, None, None), (3, "", "y", "b")], "doc_id long, text string, lang string, source string")
    out = P.tokens(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: (r["lang"], r["source"], r["n_tokens"] > 0, r["text"]) for r in out.collect()}
    assert got == {1: ("x", "a", True, "some words, é"), 2: (None, None, False, ""), 3: ("y", "b", False, "")}
