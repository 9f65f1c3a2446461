"""The language model's size, and its step against a plain one."""

import numpy as np

from staylens.llm import gru_lm as G


def test_the_network_is_not_shrunk():
    assert (G.WORDS, G.CLASSES, G.HIDDEN) == (2048, 32, 16)
    assert G.STEPS * G.STREAMS == 8192 and G.Weights.SIZE == sum(np.prod(s) for s in G.Weights.SHAPES.values())


def test_gradient_of_the_inputs_and_of_the_state():
    rng = np.random.default_rng(2)
    w = G.Weights.first(np.arange(G.WORDS, 0, -1), 10, 100)
    w.flat += rng.standard_normal(G.Weights.SIZE).astype(np.float32) * 0.2
    s = G.Streams([np.append(rng.integers(0, G.WORDS + 2, n), G._END).astype(np.int32) for n in (9, 7, 4)])
    a, b, n = next(s.windows())
    zero = np.zeros((s.target.shape[1], G.HIDDEN), np.float32)
    v, grad = G.Window(w, s, a, b, n, zero), G.Weights(np.zeros(G.Weights.SIZE, np.float32))
    dx = v.back(w, G._outputs(w, v.states, v.target, grad)[1], grad)
    np.add.at(grad.g, v.x, dx)
    way = grad.flat / np.linalg.norm(grad.flat)                 # along the gradient the loss falls by its length

    def loss(step):
        moved = G.Weights((w.flat + step * way).astype(np.float32))
        u = G.Window(moved, s, a, b, n, zero)
        return -G._outputs(moved, u.states, u.target, None)[0].astype(np.float64).sum()

    slope = (loss(0.01) - loss(-0.01)) / 0.02
    assert abs(slope / np.linalg.norm(grad.flat) - 1) < 0.01


ODD = [None, "", " \t ", " a  B\tc\x0b\x0cd ", "\x1c\x85 É x y z", "Ab\nAB  ", "\x00 KK", "one"]


def test_words_of_a_batch_are_those_of_its_texts():
    import pyarrow as pa

    whole = pa.array(ODD)
    for batch in (whole, whole.slice(3, 3), whole.slice(0, 0), whole.slice(0, 1)):
        flat, n = G.split(batch)
        want = [G.words(x) for x in batch.to_pylist()]
        assert n.tolist() == [len(x) for x in want] and flat.to_pylist() == [y for x in want for y in x]
        head = pa.array([b"ab", b"x"], pa.binary())
        assert G.ranks(flat, head).tolist() == [{b"ab": 0, b"x": 1}.get(y, -1) for x in want for y in x]


def test_a_task_scores_its_texts_in_few_large_steps(spark, monkeypatch):
    """Side by side in one buffer: a buffer's longest text alone decides how many steps it takes."""
    assert G.SCORED >= 1 << 24
    rows = [(i, x) for i, x in enumerate(ODD * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = G.word_counts(docs)
    want = {}
    for _, x in rows:
        for y in G.words(x) + [G.END]:
            want[y] = want.get(y, 0) + 1
    assert {bytes(r["word"]): r["c"] for r in counts.collect()} == want
    model = G.fit(docs, counts)
    one = {r["doc_id"]: r for r in G.score(docs, model, counts).collect()}
    monkeypatch.setattr(G, "SCORED", 100)
    many = {r["doc_id"]: r for r in G.score(docs, model, counts).collect()}
    assert len(one) == len(many) == len(rows)
    total, size = sum(want.values()), len(want)
    for i, x in rows:
        tokens = G.words(x) + [G.END]
        assert abs(one[i]["score"] - many[i]["score"]) < 1e-3 and one[i]["n_tokens"] == one[i]["n_known"] == len(tokens)
        assert abs(one[i]["base_score"] - sum(np.log10((want[y] + 1) / (total + size + 1)) for y in tokens)) < 1e-9
