"""Remaining inventory lines: stratified split (M3), the full training run
with the linear baseline (M9), controlled cases (G2), header filters (P12,
P15), UTC rendering (X25) and the overwrite sink (S10)."""

import datetime as dt

from pyspark.sql import functions as F

from staylens.functions import headers as H
from staylens.functions import scalars as X
from staylens.operators import datagen as G
from staylens.operators import features as FE
from staylens.operators import training as TR
from staylens.sources import csv_text as S


def generated_dataset(spark, n=800):
    keys = spark.range(n).withColumnRenamed("id", "k")
    grd = G.generate_grd(keys, "k") \
        .withColumn("estancia_del_episodio", F.col("estancia_norma_grd") + (F.col("edad_en_anos") - 50) / 10.0) \
        .withColumn("fecha_ingreso_completa",
                    F.timestamp_add("HOUR", F.regexp_extract("episodio_cmbd", r"(\d+)", 1).cast("int"),
                                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    score = G.generate_score(keys, "k").withColumn("gestion", F.lit("si")) \
        .withColumn("categorizacion_de_gestion", F.lit("coordinacion_familiar"))
    return FE.make_dataset(grd, score)


def test_stratified_split_exact_per_class(spark):
    ds = generated_dataset(spark)
    train, test = FE.stratified_split(ds, "excede_norma", "episodio")
    sizes = {r[0]: r[1] for r in ds.groupBy("excede_norma").count().collect()}
    got = {r[0]: r[1] for r in train.groupBy("excede_norma").count().collect()}
    assert got == {k: round(v * 0.8) for k, v in sizes.items()}
    assert train.join(test, "episodio").count() == 0
    assert train.count() + test.count() == ds.count()


def test_training_run_with_baseline(spark):
    res = TR.train_and_score(generated_dataset(spark), with_baseline=True, rounds=10)
    assert set(res["models"]) == {"baseline", "boosted", "calibrator"}
    m_boost = TR.evaluate(res["test_scores"]).first()
    m_base = TR.evaluate(res["baseline_scores"]).first()
    assert 0.0 <= m_boost["brier"] <= 1.0 and 0.0 <= m_base["roc_auc"] <= 1.0
    assert res["test_scores"].count() == res["baseline_scores"].count() > 0


def test_a_fit_reads_its_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = generated_dataset(spark, 300).withColumn("w", F.col("peso")).localCheckpoint()
    TR.fit(rows.mapInArrow(read, rows.schema), rounds=2)
    assert reads.value == 300


def test_saved_model_scores_as_before(spark, scratch):
    ds = generated_dataset(spark).withColumn("w", F.col("peso"))
    many = ds.withColumn("servicio_ingreso", F.concat(F.lit("S"), (F.abs(F.xxhash64("episodio")) % 300).cast("string")))
    data = many if "servicio_ingreso" in ds.columns else ds
    for kind in ("gbt", "logistic"):
        fitted = TR.fit(data, kind, rounds=3)
        TR.save_models({"boosted" if kind == "gbt" else "baseline": fitted}, f"{scratch}/models-{kind}")
        name, loaded, calibrator = TR.load_preferred(f"{scratch}/models-{kind}")
        before = {r["episodio"]: r["p_raw"] for r in TR.margin(fitted, data).select("episodio", "p_raw").collect()}
        after = {r["episodio"]: r["p_raw"] for r in TR.margin(loaded, data).select("episodio", "p_raw").collect()}
        assert calibrator is None and before == after


def test_controlled_cases_order(spark):
    grd, score = G.controlled_cases(spark)
    grd = grd.withColumn("fecha_ingreso_completa", F.lit(None).cast("timestamp_ntz"))
    # training also needs the management fields (FIXTURES §4)
    score = score.withColumn("gestion", F.lit("no")) \
                 .withColumn("categorizacion_de_gestion", F.lit(None).cast("string"))
    ds = FE.make_dataset(grd, score, stay=None)
    rows = {r["episodio"]: r for r in ds.collect()}
    assert rows["HIGH001"]["riesgo_social"] == 2.0 and rows["LOW001"]["riesgo_social"] == 0.0
    assert rows["HIGH001"]["riesgo_clinico"] == 2.0 and rows["LOW002"]["riesgo_clinico"] == 0.0


def test_header_filters_and_utc_text(spark):
    cols = ["edad_en_anos", "estancia_del_episodio", "horas_de_estancia", "prevision_desc_"]
    assert H.leakage_columns(cols, ["estancia_del_episodio", "horas_de_estancia"]) == \
        ["estancia_del_episodio", "horas_de_estancia"]
    assert H.whitelist(cols, ["prevision_desc_", "edad_en_anos", "ir_grd"]) == ["prevision_desc_", "edad_en_anos"]
    df = spark.createDataFrame([(dt.datetime(2024, 5, 1, 12, 30),)], "t timestamp")
    assert df.select(X.utc_iso("t")).first()[0] == "2024-05-01T12:30:00Z"


def test_overwrite_sink(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    S.write_table(df, f"{scratch}/t")
    S.write_table(df.union(df), f"{scratch}/t")
    assert spark.read.parquet(f"{scratch}/t").count() == 2


def test_page_counts_and_iso_rendering(spark):
    from staylens.operators import summaries as SU
    stays = spark.createDataFrame(
        [(f"E{i}", dt.datetime(2024, 1, 1, i % 24), "A") for i in range(30)],
        "episodio string, marca_temporal timestamp_ntz, cama string")
    page = SU.people_summary(stays, skip=5, limit=10)
    assert page.count() == 10                                   # A12: count <= limit
    assert [r["episodio"] for r in page.collect()][0] == sorted(f"E{i}" for i in range(30))[5]
    df = spark.createDataFrame([(dt.datetime(2024, 5, 1, 7, 5, 9),)], "t timestamp_ntz")
    assert df.select(X.iso_text("t")).first()[0] == "2024-05-01T07:05:09"   # P10


def test_coerce_types_and_record_addressing(spark):
    from staylens.operators import changes as C
    df = spark.createDataFrame([(1, 2.5, True, "a", None), (2, float("nan"), False, None, "x")],
                               "k int, v double, b boolean, s string, t string")
    out, num, cat = FE.coerce_types(df, exclude=["k"])
    assert num == ["v", "b"] and cat == ["s", "t"]
    rows = out.collect()
    assert rows[1]["v"] is None and rows[0]["b"] == 1.0 and rows[1]["s"] is None
    stays = spark.createDataFrame([("E1", dt.datetime(2024, 1, 1, 10)), ("E1", dt.datetime(2024, 1, 2, 10))],
                                  "episodio string, marca_temporal timestamp_ntz")
    rid = stays.select(X.row_id("episodio", "marca_temporal").alias("r")).first()["r"]
    assert C.address_records(stays, "E1", rid).count() == 1
    hit = C.address_records(stays, "E1", "2024-01-02T10:00:00").first()
    assert hit["marca_temporal"] == dt.datetime(2024, 1, 2, 10)


def test_table_views(spark):
    from staylens.session import register_tables
    register_tables(spark, "/root/testdata/sf0.001", ["orders", "customer"])
    n = spark.sql("SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey").first()[0]
    assert n > 0
