"""Sinks (S8, S9, S12, S13), census variants and report edge cases from
FIXTURES.md (§2 census cases, §6 tied scores)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from staylens.operators import ingest as I
from staylens.operators import reports as R
from staylens.sources import csv_text as S


def _csv(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    p = os.path.join(folder, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_census_datetime_column_and_date_only(spark, scratch):
    p = _csv(f"{scratch}/a", "x.csv", "Cama,Fecha Hora\nc1,05/03/2025 14:30\nc2,45000.5\n")
    rows, _ = I.normalize_census(S.read_text_csv(spark, p))
    got = {r["cama"]: r["snapshot_at"] for r in rows.collect()}
    assert got == {"C1": dt.datetime(2025, 3, 5, 14, 30), "C2": dt.datetime(2023, 3, 15, 12, 0)}
    p = _csv(f"{scratch}/b", "y.csv", "Cama,Fecha\nc1,05/03/2025\n")
    rows, key = I.normalize_census(S.read_text_csv(spark, p))
    assert rows.first()["snapshot_at"] == dt.datetime(2025, 3, 5) and key == ["cama", "snapshot_at"]


def test_census_file_name_variants(spark, scratch):
    for name, want in [("camas_05-03-2025.csv", dt.datetime(2025, 3, 5)),
                       ("camas%2005-03-2025%201430.csv", dt.datetime(2025, 3, 5, 14, 30)),
                       ("camas.csv", None)]:
        p = _csv(f"{scratch}/{len(name)}", name, "Cama,Estado\nA1,libre\n")
        rows, _ = I.normalize_census(S.read_text_csv(spark, p))
        assert rows.first()["snapshot_at"] == want, name


def test_decile_lift_with_ties(spark):
    df = spark.createDataFrame([(i, 0.5 if i < 60 else i / 100.0, int(i % 3 == 0)) for i in range(100)],
                               "id int, p double, y int")
    out = R.decile_lift(df, "y", "p").orderBy("decile").collect()
    assert len(out) < 10 and sum(r["n"] for r in out) == 100
    exact = R.decile_lift(df, "y", "p", method="exact").orderBy("decile").collect()
    assert [tuple(r) for r in out] == [tuple(r) for r in exact]


def test_history_runs_and_metrics(spark, scratch):
    df = spark.createDataFrame([(1, 0.2), (2, 0.9)], "k int, p double")
    for stamp in ["2024-01-01T10:00", "2024-01-02T10:00", "2024-01-03T10:00"]:
        S.append_run(df, f"{scratch}/runs", stamp)
    runs = [r[0] for r in S.latest_runs(spark, f"{scratch}/runs", 2).collect()]
    assert runs == ["2024-01-03T10:00", "2024-01-02T10:00"]
    S.append_history(df, f"{scratch}/hist")
    S.append_history(df.withColumn("extra", F.lit("x")), f"{scratch}/hist")
    h = S.read_history(spark, f"{scratch}/hist")
    assert h.count() == 4 and "extra" in h.columns and "created_at" in h.columns
    S.write_metrics(spark.createDataFrame([(0.8, 0.5, 0.1)], "roc_auc double, pr_auc double, brier double"),
                    f"{scratch}/metrics")
    assert spark.read.json(f"{scratch}/metrics").first()["roc_auc"] == 0.8


def test_model_save_and_preferred_load(spark, scratch):
    from staylens.operators import training as TR
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.classification import LogisticRegression
    d = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, excede_norma int")
    m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                         LogisticRegression(labelCol="excede_norma")]).fit(d)
    TR.save_models({"baseline": m}, f"{scratch}/models")
    name, loaded, _ = TR.load_preferred(f"{scratch}/models")
    assert name == "baseline" and loaded.transform(d).count() == 12


def test_typed_csv_standardised_headers(spark, scratch):
    p = _csv(f"{scratch}/grd", "grd.csv",
             "Episodio CMBD,Edad en años,Sexo  (Desc),Estancia Norma GRD ,IR GRD Código\n"
             "TEST1,70,Mujer,4.5,51401\n")
    df = S.read_typed_csv(spark, p)
    assert df.columns == ["episodio_cmbd", "edad_en_anos", "sexo_desc_", "estancia_norma_grd", "ir_grd_codigo"]
    assert df.first()["sexo_desc_"] == "Mujer"


def test_analysis_bundle(spark):
    df = spark.createDataFrame(
        [(i, i / 20.0, 20 + i * 3, "UCI" if i % 2 else "MED") for i in range(21)],
        "id int, p double, edad int, servicio string")
    rep = R.analysis_report(df, "p", "edad", "servicio", "id")
    assert set(rep) == {"stats", "distribution", "top10", "by_age", "by_service", "tiers"}
    assert rep["stats"].first()["n"] == 21 and rep["top10"].count() == 10
    dist = {r["riesgo_categoria"]: r["n"] for r in rep["distribution"].collect()}
    assert sum(dist.values()) == 21 and set(dist) == {"Baja", "Media", "Alta"}
    tiers = rep["tiers"].first()
    assert tiers["alto"] + tiers["medio"] + tiers["bajo"] == 21
    assert {r["grupo_edad"] for r in rep["by_age"].collect()} == {"<30", "30-50", "50-70", "70+"}


def test_bucketed_table_avoids_shuffle(spark, scratch):
    from staylens.operators import summaries as SU
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        F.col("user_id").cast("string").alias("episodio"), F.col("ts").alias("marca_temporal"),
        F.col("event_type").alias("cama"))
    t = S.write_bucketed_table(ev, "stays_bucketed_test", f"{scratch}/stays_b", ["episodio"], 4)
    latest = SU.latest_per_key(t, ["episodio"], ["marca_temporal"], ["cama"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert latest.count() == ev.select("episodio").distinct().count()
    spark.sql("DROP TABLE stays_bucketed_test")




def test_typed_csv_keeps_count_of_long_rows(spark, scratch):
    from pyspark.sql import types as T

    p = os.path.join(scratch, "typed.csv")
    with open(p, "w") as f:
        f.write("Mi Col,Otra\n1,a\n2,b,too long\nx,c\n4\n")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    rows, bad = S.read_typed_csv(spark, p, schema, rejects=True)
    assert sorted((r["n"] or 0, r["s"] or "") for r in rows.collect()) == [(0, "c"), (1, "a"), (4, "")]
    assert [r["_line"] for r in bad.collect()] == ["2,b,too long"]
    with pytest.raises(Exception, match="more fields than the header"):
        S.read_typed_csv(spark, p, schema).collect()
    with pytest.raises(ValueError):
        S.read_typed_csv(spark, p, T.StructType(schema.fields[:1]))


def test_training_and_scoring_share_their_categories(spark):
    from staylens.operators import features as FE
    from staylens.operators import scoring as SC

    given = [("e1", " M ", None, None), ("e2", "mujer", "UCI", "Fonasa"), ("e3", None, "UCI", None), ("e4", "otro", None, "x")]
    grd = spark.createDataFrame([(e, s, v, p, 50, 101, 3.0) for e, s, v, p in given],
                                "episodio_cmbd string, sexo_desc_ string, servicio_ingreso_descripcion_ string, prevision_desc_ string, "
                                "edad_en_anos int, ir_grd_codigo_ int, estancia_norma_grd double")
    survey = spark.createDataFrame([], "episodio string, total int, salud_mental int, gestion string, categorizacion_de_gestion string")
    trained = FE.make_dataset(grd, survey, fecha=None, stay=None)
    new = SC.records_frame(spark, [{"sexo": s, "servicio_clinico": v, "prevision": p, "edad": 50, "codigo_grd": 101} for _, s, v, p in given])
    scored = SC.scoring_features(new)
    levels = lambda df: sorted(map(tuple, df.select("sexo", "servicio_clinico", "prevision").collect()))
    assert levels(trained) == levels(scored)
    assert ("Hombre", "Desconocido", "Desconocido") in levels(trained)
