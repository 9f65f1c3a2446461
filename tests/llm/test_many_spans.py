"""Secret scans of texts with very many spans, and the false-discovery step against plain Python."""

import random
import re

from staylens.llm import secrets


def plain_redact(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_one_text_with_a_hundred_thousand_spans(spark):
    rng = random.Random(5)
    text = "é🙂 ".join("%024x" % rng.randrange(16 ** 24) for _ in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    want = [m.span() for m in re.finditer(r"[0-9a-f]{24,}", text)]
    assert [(s["start"], s["end"]) for s in rows[1] if s["kind"] == "hex"] == want
    assert rows[2] == rows[3] == rows[4] == []
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got == {1: plain_redact(text, want), 2: "plain", 3: None, 4: ""}


def test_replaced_texts_equal_plain_replacement(spark):
    rng = random.Random(6)
    parts = ["token=abcdef", "password: 'zz", "0123456789abcdef" * 2, "AKIA" + "Q7" * 10, "é", "🙂\n", " ", "word", "x" * 4000, "=", "secret=token=abcdefgh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got == {i: plain_redact(t, spans[i]) for i, t in enumerate(texts)}
    assert sum(map(len, spans.values())) > 100


def test_false_discovery_step_equals_plain_benjamini_hochberg(spark):
    rng = random.Random(7)
    tests = [(size, rng.choice([rng.randrange(0, 12), rng.randrange(0, 161)])) for size in (4, 5, 6) for _ in range(300)] + [(7, 0)] * 5
    got = {r["size"]: r["from_bin"] for r in secrets.rejections(spark.createDataFrame(tests, "size int, bin int")).collect()}
    import math
    want = {}
    for size in {s for s, _ in tests}:
        bins = sorted((b for s, b in tests if s == size), reverse=True)
        ok = [b for rank, b in enumerate(bins, 1) if math.exp(-b / 4) <= secrets.FDR * rank / len(bins)]
        if ok:
            want[size] = min(ok)
    assert got == want and 7 not in got
