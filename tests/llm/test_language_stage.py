"""The pipeline's language stage: what the model rejects and what it keeps."""

import random

import corpus_pipeline as P

SYLLABLES = {"x": "ba ce di fo gu la", "y": "mo nu pe qui ra sti", "z": "vel hon jar kus wep tiz"}
SCHEMA = "doc_id long, text string, lang string"


def prose(rng, lang, n=60):
    some = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(some) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled_rows(rng):
    return [(i, prose(rng, "xyz"[i % 3]), "xyz"[i % 3]) for i in range(600)]


def kept(spark, rows):
    return {r["doc_id"] for r in P.language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}


def test_noise_and_unlearned_scripts_go_and_clean_texts_stay(spark):
    rng = random.Random(12)
    rows = labelled_rows(rng)
    noise = [(1000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), None) for i in range(20)]
    script = [(2000 + i, " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(60)), "x") for i in range(3)]
    clean = [(3000 + i, prose(rng, "xyz"[i % 3]), None) for i in range(20)]
    short = [(4000, "bace", None), (4001, "12 34", None), (4002, None, "x")]
    got = kept(spark, rows + noise + script + clean + short)
    assert got == {r[0] for r in rows + clean} | {4000}


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (5, "слова", None), (None, "more words", None)]
    assert kept(spark, rows) == {1, 5, None}
    held = [(i, t, "x") for i, t, _ in rows if i == 5]                   # crc32("5") % 4 == 2: labelled, but held out
    assert kept(spark, rows[:3] + held) == {1, 5}
