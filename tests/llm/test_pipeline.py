"""Every stage of the pipeline on the awkward tables, against plain Python."""

import re

import pytest

import corpus_pipeline as P
from staylens.llm.common import stored

from .test_contracts import brute_classes

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(text, benchmark):
    w = words(text)
    for b in benchmark:
        item = words(b["text"])
        n = min(10, len(item))
        for i in range(max(1, len(item) - 9) if item else 0):
            if any(w[j: j + n] == item[i: i + n] for j in range(len(w) - n + 1)):
                return True
    return False


@pytest.fixture(scope="module")
def stages(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, edge_dir), f"test-{name}")
        out.append([r.asDict() for r in docs.collect()])
    return out


def ids(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None)


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "byte_bpe"]
    for rows in stages[:-1]:
        assert set(DOCUMENT) <= set(rows[0]) and "key" in rows[0]            # extra columns travel along


def test_language_stage_keeps_texts_with_a_letter(stages):
    want = [r for r in stages[0] if r["text"] and any(map(str.isalpha, r["text"]))]
    assert ids(stages[1]) == ids(want) and len(stages[1]) == len(want)


def test_one_document_of_each_class_stays(stages):
    want = []
    for rows in brute_classes(stages[1]):
        named = [stages[1][i] for i in rows if stages[1][i]["doc_id"] is not None]
        if named:
            want.append(min(r["doc_id"] for r in named))
    assert sorted(r["doc_id"] for r in stages[2] if r["doc_id"] is not None) == sorted(want)


def test_benchmark_passages_go(stages, tables):
    assert ids(stages[3]) == ids(r for r in stages[2] if not contaminated(r["text"], tables["benchmark"]))
    assert len(stages[3]) < len(stages[2])


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = {r["doc_id"]: r for r in stages[3]}, {r["doc_id"]: r for r in stages[4]}
    assert before.keys() == after.keys()
    changed = {k for k in before if before[k]["text"] != after[k]["text"]}
    assert {183, 184} <= changed <= {183, 184, 185} and all("[SECRET]" in after[k]["text"] for k in changed)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4])


def test_tokens_give_the_text_back(stages):
    assert {r["doc_id"]: r["text"] for r in stages[5]} == {r["doc_id"]: r["text"] for r in stages[4]}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] > 0 for r in stages[5])


def test_empty_tables(spark, empty_dir):
    assert P.run(spark, empty_dir).collect() == []
