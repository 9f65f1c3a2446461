"""Change application (D1-D7) on literal fixtures, and the distributed
order helpers checked against brute force on the sf0.01 tables."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from staylens.operators import changes as C
from staylens.operators import ranking as RK
from staylens.operators import summaries as S

SF = "/root/testdata/sf0.01"


def test_task_checks_first_reason_wins(spark):
    tasks = spark.createDataFrame(
        [(1, "ana", "E1", "social", "alta", None),
         (2, "zoe", "E9", "social", "alta", "pendiente"),       # two faults: manager reported
         (3, "ana", "E9", "social", "alta", "pendiente"),
         (4, "ana", "E1", "otro", "nula", "pendiente"),         # tipo before prioridad
         (5, "ana", "E1", "clinica", "baja", "hecho")],
        "id int, gestor string, paciente_episodio string, tipo string, prioridad string, status string")
    managers = spark.createDataFrame([("ana",)], "name string")
    stays = spark.createDataFrame([("E1",)], "episodio string")
    ok, bad = C.insert_tasks(tasks, managers, stays)
    assert [r["id"] for r in ok.collect()] == [1]
    assert ok.first()["status"] == "pendiente"                  # default status
    reasons = {r["id"]: r["motivo"] for r in bad.collect()}
    assert reasons == {2: "gestora_inexistente", 3: "paciente_inexistente", 4: "tipo_invalido",
                       5: "status_invalido"}


def test_patch_modes(spark):
    base = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "k int, name string, v double")
    pm = spark.createDataFrame([(1, {"v": None, "k": "9"}), (7, {"v": "1"})], "k int, fields map<string,string>")
    patched, rejected = C.apply_patch_map(base, pm, ["k"])
    assert sorted(map(tuple, patched.collect())) == [(1, "a", None), (2, "b", 20.0)]
    assert [r["k"] for r in rejected.collect()] == [7]
    pn = spark.createDataFrame([(1, None, None), (2, "B", None)], "k int, name string, v double")
    patched, rejected = C.apply_patch_nonnull(base, pn, ["k"])
    assert sorted(map(tuple, patched.collect())) == [(1, "a", 10.0), (2, "B", 20.0)]
    assert [(r["k"], r["motivo"]) for r in rejected.collect()] == [(1, "patch_vacio")]
    kept, missing = C.delete_keys(base, spark.createDataFrame([(2,), (5,)], "k int"), ["k"])
    assert [r["k"] for r in kept.collect()] == [1] and [r["k"] for r in missing.collect()] == [5]
    names = C.add_managers(spark.createDataFrame([("ana",)], "name string"),
                           spark.createDataFrame([(" ana ",), ("luz",), ("",), (None,), ("luz",)], "name string"))
    assert [r["name"] for r in names.collect()] == ["luz"]


def test_patches_of_one_key_are_merged_and_bad_ones_refused(spark):
    base = spark.createDataFrame([(1, "a", 10.0), (None, "n", 5.0), (3, "c", 1.0)], "k int, name string, v double")
    pm = spark.createDataFrame([(1, {"v": "2.5", "name": "x"}, 1), (1, {"v": "3.5"}, 2), (3, {"v": "12,5"}, 1), (3, {"k": "9"}, 2),
                                (None, {"name": "z"}, 1)], "k int, fields map<string,string>, o int")
    patched, rejected = C.apply_patch_map(base, pm, ["k"], order_cols=["o"])
    assert sorted(map(tuple, patched.collect()), key=str) == sorted([(1, "x", 3.5), (None, "z", 5.0), (3, "c", 1.0)], key=str)
    assert sorted((r["o"], r["motivo"]) for r in rejected.collect()) == [(1, "valor_invalido"), (2, "patch_vacio")]
    pn = spark.createDataFrame([(1, "p", None, 1), (1, "q", None, 2), (3, None, "soon", 1)], "k int, name string, v string, o int")
    patched, rejected = C.apply_patch_nonnull(base, pn, ["k"], order_cols=["o"])
    assert sorted(map(tuple, patched.collect()), key=str) == sorted([(1, "q", 10.0), (None, "n", 5.0), (3, "c", 1.0)], key=str)
    assert [(r["k"], r["motivo"]) for r in rejected.collect()] == [(3, "valor_invalido")]


def test_task_patches_are_checked_again(spark):
    tasks = spark.createDataFrame([(1, "ana", "E1", "social", "alta", "pendiente")],
                                  "id int, gestor string, paciente_episodio string, tipo string, prioridad string, status string")
    patch = spark.createDataFrame([(1, "eva", None), (1, None, "hecho"), (1, None, "completado")], "id int, gestor string, status string")
    check = C.validate_task_patch(spark.createDataFrame([("ana",)], "name string"), spark.createDataFrame([("E1",)], "episodio string"))
    patched, rejected = C.apply_patch_nonnull(tasks, patch, ["id"], validate=check)
    assert patched.first()["status"] == "completado" and patched.first()["gestor"] == "ana"
    assert sorted(r["motivo"] for r in rejected.collect()) == ["gestora_inexistente", "status_invalido"]


def test_every_inserted_row_is_accepted_or_rejected(spark):
    batch = spark.createDataFrame([("E1", "t1", "a"), ("E1", "t1", "a"), ("E1", "t1", "b"), ("E2", None, "c"), ("E3", "t1", "d")],
                                  "episodio string, marca_temporal string, x string")
    stored = spark.createDataFrame([("E3", "t1")], "episodio string, marca_temporal string")
    ok, bad = C.insert_stays(batch, stored, stamp=False)
    assert [(r["episodio"], r["x"]) for r in ok.collect()] == [("E1", "a")]
    assert sorted((r["x"], r["motivo"]) for r in bad.collect()) == [("a", "duplicado"), ("b", "duplicado"), ("c", "falta_clave"), ("d", "duplicado")]


def test_position_in_key_equals_row_number(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    mine = RK.position_in_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], name="pos")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ref = o.withColumn("pos", F.row_number().over(w) - 1)
    assert mine.select("o_orderkey", "pos").exceptAll(ref.select("o_orderkey", "pos")).count() == 0
    assert mine.count() == ref.count()


def test_running_totals_match_cumsum(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    got = RK.running_totals(li, ["l_partkey"], ["q"]).orderBy("l_partkey").toPandas()
    exp = li.orderBy("l_partkey").toPandas()
    assert np.allclose(got["cum_q"].to_numpy(), exp["q"].cumsum().to_numpy())


def test_current_state_nulls_last(spark):
    snaps = spark.createDataFrame(
        [("E1", None, 5, "X"), ("E1", 3, 1, "A"), ("E1", 3, 2, "B"), ("E2", None, 1, "Z")],
        "ep string, snap int, mt int, cama string")
    cur = {r["ep"]: r["cama"] for r in S.current_state(snaps, "ep", "snap", "mt", ["cama"]).collect()}
    assert cur == {"E1": "B", "E2": "Z"}


def test_people_summary_and_history(spark):
    import datetime as dt
    stays = spark.createDataFrame(
        [("E1", dt.datetime(2024, 1, 1, 8), "A1", None, "Ana", None),
         ("E1", dt.datetime(2024, 1, 3, 23), "A2", None, "  ", None),
         ("E1", dt.datetime(2024, 1, 4, 9), None, "2024-01-03", "Ana", "0.7"),
         ("E2", dt.datetime(2024, 2, 1, 8), "B1", None, "Luz", None)],
        "episodio string, marca_temporal timestamp_ntz, cama string, fecha_alta string, nombre string, "
        "probabilidad_sobre_estadia string")
    rows = {r["episodio"]: r for r in S.people_summary(stays).collect()}
    assert rows["E1"]["ultima_cama"] == "A2"          # last non-null bed up to the discharge day
    assert rows["E1"]["prob_sobre_estadia"] == "0.7" and rows["E1"]["nombre"] == "Ana"
    assert rows["E2"]["ultima_cama"] is None          # not discharged
    hist = S.episode_history(stays).where(F.col("episodio") == "E1").orderBy("pos").collect()
    assert [r["cama"] for r in hist] == ["A1", "A2", None] and hist[1]["pos"] == 1
    nested = S.episode_history(stays, episode="E1", nested=True).first()["registros"]
    assert [r["cama"] for r in nested] == ["A1", "A2", None]


def test_two_table_scoring(spark):
    from staylens.operators import datagen as G
    from staylens.operators import features as FE
    from staylens.operators import training as TR
    keys = spark.range(400).withColumnRenamed("id", "k")
    grd = G.generate_grd(keys, "k").withColumn(
        "estancia_del_episodio", (F.col("estancia_norma_grd") + (F.col("edad_en_anos") - 50) / 10.0)) \
        .withColumn("fecha_ingreso_completa", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    score = G.generate_score(keys, "k").withColumn("gestion", F.lit("si")) \
        .withColumn("categorizacion_de_gestion", F.lit("soporte_financiero"))
    ds = FE.make_dataset(grd, score).withColumn("w", F.col("peso"))
    fitted = TR.fit(ds, "gbt", rounds=10)
    raw_grd = grd.drop("estancia_del_episodio", "fecha_ingreso_completa") \
        .withColumnRenamed("sexo_desc_", "Sexo  (Desc)").withColumnRenamed("ir_grd_codigo_", "IR GRD Código")
    out = TR.score_tables(fitted, raw_grd, score, template=["ir_grd_codigo_"])
    rows = out.collect()
    assert len(rows) == 400 and all(0.0 <= r["p"] <= 1.0 for r in rows)
    assert {r["riesgo_categoria"] for r in rows} <= {"Baja", "Media", "Alta"}
    wide = TR.score_tables(fitted, raw_grd, score, template=["ir_grd_codigo_"], output="all",
                           run_stamp="2024-05-01T10:00")
    assert {"edad", "codigo_grd", "fecha_prediccion"} <= set(wide.columns) and wide.count() == 400


def _fitted_on_generated(spark):
    from staylens.operators import datagen as G
    from staylens.operators import features as FE
    from staylens.operators import training as TR
    keys = spark.range(600).withColumnRenamed("id", "k")
    grd = G.generate_grd(keys, "k").withColumn(
        "estancia_del_episodio", F.col("estancia_norma_grd") + (F.col("edad_en_anos") - 50) / 10.0) \
        .withColumn("fecha_ingreso_completa", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    score = G.generate_score(keys, "k").withColumn("gestion", F.lit("no")) \
        .withColumn("categorizacion_de_gestion", F.lit("otra"))
    return FE.make_dataset(grd, score).withColumn("w", F.col("peso"))


def test_isotonic_cv_ensemble(spark):
    from staylens.operators import training as TR
    ds = _fitted_on_generated(spark)
    members = TR.fit_isotonic_cv(ds, "gbt", n_folds=3, rounds=5)
    out = TR.apply_isotonic_cv(members, ds).select("episodio", "excede_norma", "p")
    rows = out.collect()
    assert len(rows) == 600 and all(0.0 <= r["p"] <= 1.0 for r in rows)
    auc = TR.evaluate(out).first()["roc_auc"]
    assert auc > 0.7


def test_scoring_drop_folder_stream(spark, scratch):
    import os
    from staylens.operators import scoring as SC
    from staylens.operators import training as TR
    from staylens.streaming import streams as ST
    fitted = TR.fit(_fitted_on_generated(spark), "gbt", rounds=10)
    recs = SC.records_frame(spark, [
        {"edad": 80, "sexo": "m", "servicio_clinico": "UCI Medicina", "prevision": "FONASA",
         "fecha_estimada_de_alta": "3", "riesgo_social": "alto", "riesgo_clinico": "2",
         "riesgo_administrativo": "media", "codigo_grd": 51401, "episodio": "N1"}], "episodio string")
    assert recs.count() == 1
    drop, out, ckpt = f"{scratch}/drop", f"{scratch}/scores", f"{scratch}/ckpt"
    os.makedirs(drop)
    cols = ["episodio", "edad", "sexo", "servicio_clinico", "prevision", "fecha_estimada_de_alta",
            "riesgo_social", "riesgo_clinico", "riesgo_administrativo", "codigo_grd"]
    with open(f"{drop}/batch1.csv", "w") as fh:
        fh.write(",".join(cols) + "\n")
        fh.write("N1,80,m,UCI Medicina,FONASA,3,alto,2,media,51401\n")
        fh.write("N2,30,F,Cirugía,Isapre,2024-03-09,bajo,0,0,61203\n")
        fh.write("N3,,x,,,,,,,\n")
    stream = ST.text_stream(spark, drop, cols)
    ST.run_available(stream, ST.scoring_handler(fitted, out, keep=["episodio"],
                                                reference_medians={"dias": 5.0, "edad": 60.0}), ckpt)
    res = {r["episodio"]: r for r in spark.read.parquet(out).collect()}
    assert set(res) == {"N1", "N2", "N3"}
    assert all(0.0 <= r["probabilidad_sobre_estadia"] <= 1.0 for r in res.values())
    assert res["N1"]["riesgo_categoria"] in ("Baja", "Media", "Alta") and res["N1"]["created_at"] is not None
    assert res["N2"]["fecha_estimada_de_alta"] == 9.0 and res["N2"]["sexo"] == "Mujer"


def test_current_bed_job(spark):
    import datetime as dt
    census = spark.createDataFrame(
        [("E1", None, "N2", "C1", dt.datetime(2024, 1, 2), None),
         ("E1", "UCI", None, "C2", None, dt.datetime(2024, 1, 9)),     # no snapshot: ranks last
         ("E2", "", "N1", "D1", dt.datetime(2024, 1, 3), None)],
        "episodio string, unidad string, asign_enfermeria string, cama string, "
        "snapshot_at timestamp_ntz, marca_temporal timestamp_ntz")
    stays = spark.createDataFrame(
        [("E1", dt.datetime(2024, 1, 1), None), ("E2", dt.datetime(2024, 1, 1), None),
         ("E2", dt.datetime(2024, 1, 5), "2024-01-05")],
        "episodio string, marca_temporal timestamp_ntz, fecha_alta string")
    all_beds = {r["episodio"]: r for r in S.current_bed(census).collect()}
    assert all_beds["E1"]["cama"] == "C1" and all_beds["E1"]["unidad"] == "N2"
    assert all_beds["E2"]["unidad"] == "N1"                      # '' is not truthy
    assert all_beds["E1"]["timestamp"] == dt.datetime(2024, 1, 2)
    active = [r["episodio"] for r in S.current_bed(census, stays, include_discharged=False).collect()]
    assert active == ["E1"]
