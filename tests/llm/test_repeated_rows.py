"""Equal rows spread over the slots, and the SQL twin agrees on them."""

import duckdb

from staylens.llm import sharding


def test_repeated_rows_are_divided(spark, tmp_path):
    rows = [(7, "the same text of every copy")] * 800 + [(i, "text %d" % i) for i in range(100, 290)] + [(None, None)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op5_virtual_slots(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(load) <= sum(load) / 8 * 1.05 and min(load) >= sum(load) / 8 * 0.95
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, size, text_crc32, shard, slot, virtual_slot FROM ({sharding.ORACLE['op5_virtual_slots']})").fetchall()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    mine = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["virtual_slot"]) for r in got]
    assert sorted(mine, key=key) == sorted(want, key=key)


def test_long_runs_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    docs = spark.createDataFrame([(1, "a")] * 10 + [(2, "b")] * 3 + [(3, "c")], "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=2).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 10, 2: 3, 3: 1}
