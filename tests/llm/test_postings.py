"""The postings are made by many small sorts and hold every row once."""

import re

from pyspark.sql import functions as F

from staylens.llm import decontaminate as D


def test_postings_of_every_row_once_in_small_sorts(spark):
    rows = [(i, " ".join(["to", "be", f"w{i}"] * 3)) for i in range(400)] + [(None, "to be"), (400, None), (401, ""), (3, "to")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    terms = spark.createDataFrame([("to", 0), ("be", 1), ("w7", 2)], "term string, term_id long")
    index = D.build_index(docs, terms)
    want = sorted((t, i, p + 1) for i, text in rows for p, w in enumerate((text or "").split()) for t in [{"to": 0, "be": 1, "w7": 2}.get(w)] if t is not None and i is not None)
    named = D.index_rows(index)
    assert named.count() == named.select("key").distinct().count() == len(rows)
    got = D.postings(index).join(named, "key").where(F.col("doc_id").isNotNull()).select("term_id", "doc_id", "pos").collect()
    assert sorted(map(tuple, got)) == want
    # a task's postings, one file, are those of a part of its split only, sorted by term
    files = index.where(F.col("term_id") >= 0).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("term_id").alias("t")).collect()
    assert len(files) >= D.SLICES and max(r["n"] for r in files) < 2 * len(want) / D.SLICES
    assert all(r["t"] == sorted(r["t"]) for r in files)


def test_the_digest_of_a_text_is_made_once_a_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "to be or not to be")], "doc_id long, text string")
    terms = spark.createDataFrame([("to", 0), ("be", 1)], "term string, term_id long")
    plans = []
    monkeypatch.setattr(D, "stored", lambda df, name, *_: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    D.build_index(docs, terms)
    steps = re.findall(r"\bGenerate\b|\bmd5\(", plans[-1])       # from the last step to the first
    assert steps == ["Generate", "md5("] * D.SLICES
