"""Recall of the randomness battery on short keys of mixed one-case letters and digits."""

import random

from staylens.llm import secrets

ALPHABETS = {
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}
WORDS = "invoice order update report version build release customer january data model table section".split()


def found(spark, texts):
    docs = spark.createDataFrame([(i, f"see {s} here") for i, s in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in secrets.scan(docs).collect() if any(s["kind"] == "random" for s in r["spans"])}


def joined_words(rng):
    """Names with numbers below the floor of 30 symbols that holds without the mixed test."""
    while True:
        out = "".join(rng.choice(WORDS) + (str(rng.randrange(1, 10000)) if rng.random() < 0.5 else "") for _ in range(3)) + "7"
        if 20 <= len(out) < 30:
            return out


def test_short_mixed_keys_are_found_and_names_with_numbers_are_not(spark):
    rng = random.Random(21)
    groups = [("base32", 20), ("base32", 32), ("base36", 24), ("base36", 28), ("BASE36", 20)]
    keys = ["".join(rng.choice(ALPHABETS[name]) for _ in range(n)) for name, n in groups for _ in range(200)]
    plain = [joined_words(rng) for _ in range(200)] + ["internationalisierungsmassnahmen"]
    got = found(spark, keys + plain)
    for g, group in enumerate(groups):
        assert len([i for i in got if i // 200 == g]) >= 160, group
    assert len([i for i in got if i >= len(keys)]) <= 10
