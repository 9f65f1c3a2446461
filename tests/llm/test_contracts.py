"""The registered queries on awkward and empty tables, against SQL twins or plain Python."""

import base64
import hashlib
import math
import os
import re
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import pytest

from staylens import llm

COLUMNS = {
    "op1_hash_prefix_forest": "query_id rank vec_id score", "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_gru_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_virtual_slots": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op7_omh_dedup": "doc_id class_id",
    "op8_licenses": "doc_id licenses", "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_langid": "doc_id held_out lang_pred score", "op11_resample": "doc_id n_features weight score rank",
    "op12_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_partenum": "doc_id n_shingles component_id",
}
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def rows_of(spark, folder, name):
    return [r.asDict() for r in llm.queries()[name](spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, empty_dir, name):
    out = llm.queries()[name](spark, empty_dir)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    assert out.collect() == []


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_sql_twin_on_awkward_rows(spark, edge_dir, name):
    got = llm.queries()[name](spark, edge_dir)
    con = duckdb.connect()
    for f in os.listdir(edge_dir):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{edge_dir}/{f}')")
    twin = con.sql(llm.oracles()[name])
    columns = sorted(got.columns)
    assert sorted(twin.columns) == columns
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM twin").fetchall(), key=key)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == want


def test_shards(spark, edge_dir, tables):
    rows = rows_of(spark, edge_dir, "op5_virtual_slots")
    assert len(rows) == len(tables["documents"])
    load = Counter()
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        load[s] = sum(r["size"] for r in own)
    big = max(r["size"] for r in rows)
    assert max(load.values()) <= max(big, sum(load.values()) / 8 * 1.05) + 1


def test_bpe_is_the_library(spark, edge_dir, tables):
    import public_tokenizers as P
    import tiktoken

    from staylens.llm import bpe

    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in tables["documents"]:
        ids = enc.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, edge_dir, "op2_bpe")) == want


def test_base_score_and_model(spark, edge_dir, tables):
    learn = Counter()
    split = lambda r: zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2
    tokens = lambda r: (r["text"] or "").encode().translate(LOWER).split() + [b""]
    for r in tables["documents"]:
        if not split(r):
            learn.update(tokens(r))
    n, v = sum(learn.values()), len(learn)
    key = lambda x: tuple(map(str, x))
    want = sorted(((r["doc_id"], split(r), len(t := tokens(r)), sum(x in learn for x in t), n,
                    round(sum(math.log10((learn[x] + 1) / (n + v + 1)) for x in t), 5)) for r in tables["documents"]), key=key)
    rows = rows_of(spark, edge_dir, "op3_gru_lm")
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), key=key)
    assert got == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_secret_patterns(spark, edge_dir, tables):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = Counter()
    for r in tables["documents"]:
        t = r["text"] or ""
        found = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        count = Counter(k for k, _, _ in found)
        want[(r["doc_id"], count["assign"], count["access"], count["hex"], hashlib.sha256(",".join("%s:%d:%d" % x for x in found).encode()).hexdigest())] += 1
    rows = rows_of(spark, edge_dir, "op6_secrets")
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want
    assert next(r["spans"] for r in rows if r["doc_id"] == 185) == "random:4:36"          # the long word is not random


def test_warc_digests(spark, edge_dir, tables):
    rows = rows_of(spark, edge_dir, "op9_warc")
    for r in tables["pages"]:
        payload = (r["html"] or "").encode()
        own = [x for x in rows if x["page_id"] == r["page_id"]]
        assert {(x["payload_bytes"], x["payload_digest"]) for x in own} == {(len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())}
    assert {x["refers_to"] for x in rows if x["page_id"] in range(40, 59)} == {59}


def test_languages(spark, edge_dir, tables):
    rows = rows_of(spark, edge_dir, "op10_langid")
    assert len(rows) == len(tables["documents"])
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {160, 161, 162, 163} <= und and all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)


def test_neighbours(spark, edge_dir, tables):
    ok = {}
    for r in tables["embeddings"]:
        e = r["embedding"]
        if r["vec_id"] is not None and e and len(e) == 16 and all(x is not None and math.isfinite(x) for x in e) and any(e):
            ok[r["vec_id"]] = np.array(e, np.float64)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    rows = rows_of(spark, edge_dir, "op1_hash_prefix_forest")
    hit = total = 0
    for q in [int(i) for i in ids if i % 100 == 0]:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [k for k, _, _ in own] == list(range(1, 11)) and q not in [v for _, v, _ in own]
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        for _, v, s in own:
            assert abs(s - np.linalg.norm(ok[v] - ok[q])) < 1e-12
        d = np.where(ids == q, np.inf, np.sqrt(((x - ok[q]) ** 2).sum(1)))
        hit += len({int(v) for v in ids[np.lexsort((ids, d))[:10]]} & {v for _, v, _ in own})
        total += 10
    assert {r["query_id"] for r in rows} == {int(i) for i in ids if i % 100 == 0} and hit / total >= 0.9


def brute_classes(documents):
    """class of every row index by all pairs of distinct word sequences."""
    from staylens.llm import omh_dedup as O

    crc, nodes = O._Crc(), {}
    for i, r in enumerate(documents):
        w = tuple(O._WORD.findall((r["text"] or "").lower()))
        nodes.setdefault(w or ("", i), []).append(i)
    keys = list(nodes)
    seq = [O.shingles(np.array([crc[x] for x in k], np.uint32)) if k[0] != "" else None for k in keys]
    parent = list(range(len(keys)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(keys)):
        for b in range(a):
            if seq[a] is not None and seq[b] is not None and len(np.intersect1d(seq[a], seq[b])) and O.similar(seq[a], seq[b]):
                parent[root(a)] = root(b)
    groups = {}
    for k, rows in enumerate(nodes.values()):
        groups.setdefault(root(k), []).extend(rows)
    return groups.values()


def test_near_duplicate_classes(spark, edge_dir, tables):
    docs = tables["documents"]
    want = Counter()
    for rows in brute_classes(docs):
        least = min((docs[i]["doc_id"] for i in rows if docs[i]["doc_id"] is not None), default=None)
        want.update((docs[i]["doc_id"], least) for i in rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in rows_of(spark, edge_dir, "op7_omh_dedup")) == want


def test_near_duplicates_with_null_and_repeated_ids(spark):
    from staylens.llm import omh_dedup as O

    rng = __import__("random").Random(1)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    near = " ".join(base[:-1] + ["other"])
    rows = [(None, " ".join(base)), (5, " ".join(base)), (9, near), (9, " ".join(base).upper()), (5, near), (None, "alone in the world and without any name"),
            (None, "alone in the world and without any name"), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = O.classes(docs, O.method()).collect()
    assert {r["class_id"] for r in got if r["doc_id"] in (5, 9)} == {5}
    assert Counter(r["class_id"] for r in got) == Counter({5: 5, None: 2, 3: 2, 4: 1})
    left = [tuple(r) for r in O.drop_near_duplicates(docs).collect()]
    assert Counter(r[0] for r in left) == Counter({5: 1, None: 1, 3: 1, 4: 1})
    assert len([r for r in left if r[1] and r[1].startswith("alone")]) == 1


def test_licence_of_wrapped_text(spark, edge_dir):
    rows = {r["doc_id"]: r["licenses"] for r in rows_of(spark, edge_dir, "op8_licenses")}
    assert rows[186] == "MIT" and rows[187] == "BSD-2-Clause" and rows[160] == rows[0] == ""
