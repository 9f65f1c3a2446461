"""Patches and deletes of a stored table: equal to the DataFrame form, untouched files stay."""

import os

from pyspark.sql import functions as F

from staylens.operators import changes as C
from staylens.operators import rewrites as W

KEYS, PART = ["episodio", "marca"], ["dia"]


def stored(spark, path):
    rows = spark.range(60).select(F.concat(F.lit("E"), F.col("id") % 20).alias("episodio"), (F.col("id") * 1000).alias("marca"),
                                  F.concat(F.lit("c"), "id").alias("cama"), (F.col("id") % 7).cast("int").alias("dias"),
                                  F.when(F.col("id") % 12 < 10, F.concat(F.lit("2024-01-0"), F.col("id") % 12 % 5 + 1).cast("date")).alias("dia"))
    rows.write.partitionBy("dia").parquet(path)
    return spark.read.parquet(path)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_patches(spark, scratch):
    path = f"{scratch}/t"
    base = stored(spark, path)
    patch = spark.createDataFrame(
        [("E0", 0, "2024-01-01", {"cama": "new", "dias": None}), ("E11", 11000, None, {"cama": "unknown day"}), ("E1", 999, "2024-01-02", {"cama": "no such key"}),
         ("E2", 2000, "2024-01-03", {"dias": "x"}), ("E0", 0, "2024-01-01", {"dia": "2025-01-01"})],
        "episodio string, marca long, dia string, fields map<string,string>").withColumn("dia", F.col("dia").cast("date"))
    want, rejected = C.apply_patch_map(base, patch.drop("dia"), KEYS, protected=PART)
    want, rejected = rows_of(want), rejected.collect()                                     # before the files change
    before = files(path)
    got = W.patch_stored(path, patch, KEYS, PART)
    assert sorted(r["motivo"] for r in got.collect()) == sorted(r["motivo"] for r in rejected) == ["no_encontrado", "patch_vacio", "valor_invalido"]
    assert rows_of(spark.read.parquet(path)) == want
    kept = before & files(path)
    assert all("dia=2024-01-01" in f or "dia=2024-01-03" in f or "__HIVE_DEFAULT" in f for f in before - kept)
    assert any("dia=2024-01-02" in f for f in kept) and any("dia=2024-01-04" in f for f in kept)
    once = spark.read.parquet(path).collect()
    W.patch_stored(path, patch, KEYS, PART)                                                 # replay
    assert sorted(map(str, once)) == sorted(map(str, spark.read.parquet(path).collect()))


def test_patches_of_supplied_values(spark, scratch):
    path = f"{scratch}/t"
    base = stored(spark, path)
    patch = spark.createDataFrame([("E3", 3000, "2024-01-04", "z", None), ("E4", 4000, "2024-01-05", None, 9)],
                                  "episodio string, marca long, dia string, cama string, dias int").withColumn("dia", F.col("dia").cast("date"))
    want = rows_of(C.apply_patch_nonnull(base, patch.drop("dia"), KEYS)[0])
    assert W.patch_stored_nonnull(path, patch, KEYS, PART).collect() == []
    assert rows_of(spark.read.parquet(path)) == want


def test_deletes_remove_emptied_partitions(spark, scratch):
    path = f"{scratch}/t"
    base = stored(spark, path)
    first = base.where("dia = DATE'2024-01-01'").select(*KEYS, "dia")
    gone = first.unionByName(spark.createDataFrame([("none", 1, None)], "episodio string, marca long, dia date"))
    gone = spark.createDataFrame(gone.collect(), gone.schema)
    want = rows_of(C.delete_keys(base, gone, KEYS)[0])
    before = files(path)
    not_found = W.delete_stored(path, gone, KEYS, PART)
    assert [r["episodio"] for r in not_found.collect()] == ["none"]
    assert rows_of(spark.read.parquet(path)) == want and not any("dia=2024-01-01" in f for f in files(path))
    assert files(path) < before
