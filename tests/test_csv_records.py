"""Quoted line ends read by many tasks, against Spark's reader that takes a file whole."""

import csv
import io
import os
import random

import pytest

from staylens.sources import csv_text as S
from staylens.sources.csv_records import quoted_records


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(rng):
    return "".join(rng.choice(["a", "é", ",", '"', "\n", "\n\n", " ", "xyz", ";"]) for _ in range(rng.choice([1, 1, 2, 5, 30])))


def write(folder, name, rng, rows, end="\n", encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    records = [[f"r{i}", field(rng), field(rng)] for i in range(rows)]
    text = io.StringIO()
    out = csv.writer(text, lineterminator=end, quoting=csv.QUOTE_ALL)
    out.writerows([["Id", "Uno", "Dos"], *records])
    with open(os.path.join(folder, name), "w", encoding=encoding, newline="") as f:
        f.write(text.getvalue())
    return records


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_reading_files_whole(spark, scratch, small_splits, seed):
    rng = random.Random(seed)
    folder = f"{scratch}/csv"
    want = [r for k in range(3) for r in write(folder, f"f{k}.csv", rng, rng.choice([1, 40, 120]))]
    got = S.read_text_csv(spark, folder, quoted_newlines=True)
    rows = sorted((r["id"], r["uno"], r["dos"]) for r in got.collect())
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    assert rows == sorted((a, b, c) for a, b, c in want)
    assert rows == sorted(map(tuple, whole.collect()))
    ordered = sorted(got.select("_file_name", "_scan_id", "id").collect())
    assert [int(r["id"][1:]) for r in ordered if r["_file_name"] == "f0.csv"] == list(range(sum(r["_file_name"] == "f0.csv" for r in ordered)))


def test_one_file_is_read_by_many_tasks(spark, scratch, small_splits):
    want = write(f"{scratch}/big", "big.csv", random.Random(9), 300)
    records = quoted_records(spark, f"{scratch}/big")
    assert records.rdd.getNumPartitions() > 20
    assert records.select("block").distinct().count() > 20 and records.count() == len(want) + 1


def test_long_record_crosses_many_splits_and_other_line_ends(spark, scratch, small_splits):
    folder = f"{scratch}/long"
    os.makedirs(folder)
    body = "line\r\n" * 500
    with open(f"{folder}/a.csv", "w", encoding="iso-8859-1", newline="") as f:
        f.write(f'Id,Uno\r\n1,"{body}"\r\n2,"\xe9 ""q"""\r\n\r\n3,plain\r\n4,"never closed\r\nends here')
    rows = {r["id"]: r["uno"] for r in S.read_text_csv(spark, folder, quoted_newlines=True).collect()}
    assert rows["1"].replace("\r\n", "\n") == body.replace("\r\n", "\n")
    assert rows["2"] == '\xe9 "q"' and rows["3"] == "plain" and len(rows) == 4
    assert "ends here" in rows["4"]


def test_overlong_rows_come_back(spark, scratch):
    os.makedirs(f"{scratch}/over")
    with open(f"{scratch}/over/a.csv", "w") as f:
        f.write('a,b\n1,"x\ny"\n2,3,"4\n5"\n6\n')
    rows, bad = S.read_text_csv(spark, f"{scratch}/over", quoted_newlines=True, rejects=True)
    assert sorted((r["a"], r["b"]) for r in rows.collect()) == [("1", "x\ny"), ("6", None)]
    assert [r["_line"] for r in bad.collect()] == ['2,3,"4\n5"']
