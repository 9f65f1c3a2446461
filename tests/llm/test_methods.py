"""The operators' own parts, without tables."""

import random
import zlib

import numpy as np
import pytest

from staylens.llm import bpe, decontaminate, gru_lm, langid, omh_dedup, secrets, sharding, warc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(last + 1 if x == y else row[j + 1], row[j])
    return row[-1]


def test_aligned_similarity_is_the_lcs_one():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at: at + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
        m = lcs(a, b)
        want = bool(b) and m >= 0.8 * (len(a) + len(b) - m) - 1e-9
        assert omh_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == want or not b


def test_sketch_follows_order():
    s = omh_dedup.shingles(np.arange(200, dtype=np.uint32))
    turned = np.concatenate([s[100:], s[:100]])
    same = lambda a, b: len(set(omh_dedup.sketches(a).tolist()) & set(omh_dedup.sketches(b).tolist()))
    assert same(s, s) == omh_dedup.SKETCHES and same(s, turned) < omh_dedup.SKETCHES / 2
    assert len(omh_dedup.sketches(s[:0])) == 0 and len(omh_dedup.sketches(s[:1])) == omh_dedup.SKETCHES


def test_repeated_shingles_differ():
    s = omh_dedup.labelled(np.array([5, 5, 5, 7], np.uint64))
    assert len(set(s.tolist())) == 4


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35)]
    got = {r["node"]: r["comp"] for r in omh_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, **{i: 30 for i in range(30, 36)}}


def test_merges_by_heap_and_by_list_agree():
    ranks, _ = bpe.default_tokenizer()
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b" abcdeinorst\xc3\xa9") for _ in range(rng.randrange(1, 120)))
        assert bpe._merge_heap(word, ranks) == bpe._merge_short(word, ranks)


def test_fold_by_higher_order_functions(spark):
    ranks, _ = bpe.default_tokenizer()
    some = [" thinstable", "Éauouon", "a", "zzzzzzzzq", " 1234567"]
    df = spark.createDataFrame([(w,) for w in some], "w string")
    got = {r["w"]: r["ids"] for r in df.select("w", bpe.fold_words(df["w"], ranks).alias("ids")).collect()}
    assert got == {w: bpe.merge(w.encode(), ranks) for w in some}


def test_id_array(spark):
    ranks, pattern = bpe.default_tokenizer()
    df = bpe.encode(spark.createDataFrame([("hello there",), (None,)], "text string"), ranks, pattern)
    rows = {r["text"]: r["a"] for r in df.select("text", bpe.id_array(df["ids"]).alias("a")).collect()}
    assert rows[None] == [] and b"".join({v: k for k, v in ranks.items()}[i] for i in rows["hello there"]) == b"hello there"


def test_archive_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    import io

    data = [warc.record(i, "u", b"p" * i, warc.base32_sha1(b"p" * i), None if i % 2 else 4) for i in range(20)]
    stream = io.BytesIO(b"".join(map(warc.member, data)))
    got = [warc.parse(x) for x in warc.members(warc._pieces(stream))]
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got] == [(i, i, None if i % 2 else 4) for i in range(20)]


@pytest.mark.parametrize("change", [lambda x: x[:-5], lambda x: x.replace(b"ppp", b"ppq"), lambda x: x + b"more"])
def test_damaged_records_are_refused(change):
    with pytest.raises(warc.WarcError):
        warc.parse(change(warc.record(1, "u", b"ppp", warc.base32_sha1(b"ppp"), None)))
    with pytest.raises((warc.WarcError, zlib.error)):
        list(warc.members(iter([warc.member(b"abc")[:-3]])))


def test_rebalancing_edits_the_map():
    rng = random.Random(3)
    totals = {s: rng.randrange(1, 1000) for s in range(1000)}
    first = sharding.first_map(1000, 8)
    second = sharding.rebalance(first, totals, 8)
    load = [sum(totals[s] for s in range(1000) if second[s] == k) for k in range(8)]
    assert max(load) - min(load) <= 50 and sum(a != b for a, b in zip(first, second)) < 200
    fewer = sharding.rebalance(second, totals, 7)
    assert set(fewer) == set(range(7))
    assert sharding.rebalance(first, {}, 8) == first


def test_randomness_battery(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ones = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    structured = ["abcabcabc" * 5 + "A1", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaB7"]
    docs = spark.createDataFrame([(i, f"see {s} here") for i, s in enumerate(random_ones + structured)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.scan(docs).collect() if any(s["kind"] == "random" for s in r["spans"])}
    assert len(found & set(range(60))) >= 55 and not found & {60, 61, 62}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef1234567890abcdef1234567890 end"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got == {1: "é [SECRET] end", 2: "clean", 3: None}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox and a blue bird"), (2, "blue x x x x x red"), (3, "bird")], "doc_id long, text string")
    phrases = spark.createDataFrame([(0, ["red", "blue"]), (1, ["bird"])], "phrase_id long, words array<string>")
    terms = decontaminate.vocabulary(phrases)
    index = decontaminate.build_index(docs, terms)
    near = decontaminate.proximity_matches(index, phrases, terms, 4).join(decontaminate.index_rows(index), "key")
    assert {(r["phrase_id"], r["doc_id"]) for r in near.collect()} == {(0, 1), (1, 1), (1, 3)}


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    w = gru_lm.Weights.first(np.arange(gru_lm.WORDS, 0, -1), 10, 100)
    texts = [np.append(rng.integers(0, gru_lm.WORDS + 2, n), gru_lm._END).astype(np.int32) for n in (5, 9, 3)]
    before = gru_lm.score_buffer(w, texts).sum()
    one = sum(gru_lm.score_buffer(w, [t])[0] for t in texts)
    assert abs(before - one) < 1e-3                                  # texts side by side don't touch each other
    seen = np.full(gru_lm.Weights.SIZE, 1e-2, np.float32)
    for _ in range(5):
        gru_lm.train_buffer(w, seen, texts)
    assert gru_lm.score_buffer(w, texts).sum() > before


def test_probabilities_sum_to_one():
    w = gru_lm.Weights.first(np.arange(gru_lm.WORDS, 0, -1), 10, 100)
    h = np.random.default_rng(1).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.WORDS + 2)
    logp, _ = gru_lm._outputs(w, np.repeat(h, len(every), 0), every, None)
    assert abs(np.exp(logp.astype(np.float64)).sum() - 1) < 1e-4


def test_language_accuracy_and_pieces(monkeypatch):
    rng = random.Random(8)
    make = {"x": "ba ce di fo gu".split(), "y": "mo nu pe qui ra".split()}
    draw = lambda k: " ".join("".join(rng.choice(make[k]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    texts = [(k, draw(k)) for k in "xy" for _ in range(60)]
    model = langid.train(np.packbits(np.stack([langid.presence(t) for _, t in texts]), axis=1), [k for k, _ in texts], landmarks=20)
    fresh = [(k, draw(k)) for k in "xy" for _ in range(50)]
    names, scores = model.predict([t for _, t in fresh] + [None, "12 3"])
    assert names[:-2] == [k for k, _ in fresh] and names[-2:] == ["und", "und"] and scores[-1] == 0
    whole = langid.presence("abc def" * 50)
    monkeypatch.setattr(langid, "PIECE", 16)
    assert (whole & ~langid.presence("abc def" * 50)).sum() == 0
