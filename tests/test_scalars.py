"""Literal fixtures for the row-level expressions (FIXTURES.md cases and the
semantic decisions of SURVEY §7.4)."""

import datetime as dt

from pyspark.sql import functions as F

from staylens.functions import headers as H
from staylens.functions import scalars as X


def one(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_lenient_int(spark):
    assert one(spark, ["12.5", " $53.052.920 ", "--5", "-7", "", None], X.lenient_int) == \
        [125, 53052920, None, -7, None, None]


def test_excel_serial(spark):
    out = one(spark, ["45000.5", "45000,5", "abc", "1d"], X.excel_serial_to_timestamp)
    assert out[0] == dt.datetime(2023, 3, 15, 12, 0) and out[1] == out[0]
    assert out[2] is None and out[3] is None        # Spark alone would read "1d" as 1.0


def test_parse_datetime(spark):
    vals = ["04/03/2023 10:00", "2023-03-04T10:00:00", "2023-03-04T10:00:00+00:00", "45000.5",
            "2023", "", "04/25/2023", "31/02/2023", "4-3-2023 9:05:07", "no date", "13/13/2023", "2/1/2023 24:00"]
    out = one(spark, vals, lambda c: X.parse_datetime(c, True))
    assert out[0] == dt.datetime(2023, 3, 4, 10, 0)          # day first
    assert out[1] == out[2] == dt.datetime(2023, 3, 4, 10, 0)  # ISO is ISO, offset dropped
    assert out[3] == dt.datetime(2023, 3, 15, 12, 0)
    assert out[4] == dt.datetime(1905, 7, 15) and out[5] is None   # R4: any number is a serial day
    assert out[6] == dt.datetime(2023, 4, 25)                  # month-first fallback
    assert out[7] is None and out[8] == dt.datetime(2023, 3, 4, 9, 5, 7)
    assert out[9:] == [None, None, None]


def test_check_digit_and_seed(spark):
    assert one(spark, [17085132], X.check_digit, "bigint") == ["3"]
    seed = one(spark, ["EP1"], X.seed_from_key)[0]
    import hashlib
    assert seed == int(hashlib.sha1(b"EP1").hexdigest()[:12], 16)


def test_tiers_at_boundaries(spark):
    ps = [0.0, 0.33, 0.66, 1.0, None, 1.1, 0.5]
    assert one(spark, ps, X.tier_vector, "double") == ["Baja", "Baja", "Media", "Alta", None, None, "Media"]
    assert one(spark, ps, X.tier_scalar, "double") == ["Baja", "Media", "Media", "Alta", "Desconocido",
                                                       "Alta", "Media"]


def test_sex_risk_stay(spark):
    assert one(spark, ["m", " H ", "MUJER", "x", None], X.normalize_sex) == \
        ["Hombre", "Hombre", "Mujer", "x", "Desconocido"]
    assert one(spark, ["alta", "Bajo", "3", "-1", "x", None], X.encode_risk) == [2.0, 0.0, 2.0, 0.0, None, None]
    assert one(spark, ["7", "2024-03-15", None], X.allowed_stay_days) == [7.0, 15.0, None]


def test_codes_and_weights(spark):
    df = spark.createDataFrame([(10.0, 5.0), (5.0, 10.0), (100.0, 1.0), (None, 3.0)], "d double, n double")
    rows = df.select(X.excess_label("d", "n"), X.sample_weight("d", "n")).collect()
    assert [r[0] for r in rows] == [1, 0, 1, 0]
    assert [round(r[1], 6) for r in rows] == [1.25, 1.0, 3.0, 1.0]
    assert one(spark, [0.0, 2.0, 9.0, None], X.clinical_code, "double") == [0.0, 1.0, 2.0, 1.0]
    df = spark.createDataFrame([("Si ", "otra"), ("no", " Soporte_Financiero "), (None, None)], "g string, c string")
    assert [r[0] for r in df.select(X.admin_code("g", "c")).collect()] == [1.0, 2.0, 0.0]


def test_tercile_code_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    q = df.agg(F.percentile("v", [0.33, 0.66]).alias("q"))
    out = df.crossJoin(q).select(X.tercile_code(F.col("v"), F.col("q")[0], F.col("q")[1])).collect()
    assert [r[0] for r in out] == [0.0, 0.0, 1.0]      # all-equal values: q66 nudged, missing -> 1


def test_age_bands_right_closed(spark):
    assert one(spark, [30, 31, 70, 71, 0, 101], X.age_band, "int") == ["<30", "30-50", "50-70", "70+", None, None]


def test_headers():
    assert H.slug("Marco Temporal") == "marco_temporal"
    assert H.slug("  Año / Mes ") == "ano_mes"
    assert H.standardize("Sexo  (Desc)") == "sexo_desc_"
    assert H.standardize("Estancia Norma GRD ") == "estancia_norma_grd"
    assert H.align_trailing_underscore(["ir_grd_codigo", "edad"], ["ir_grd_codigo_", "edad"]) == \
        {"ir_grd_codigo": "ir_grd_codigo_"}
    assert H.first_existing(["id", "episodio"], ["episodio_cmbd", "episodio"]) == "episodio"


def test_identity_fill_keeps_real_values(spark):
    from staylens.operators.ingest import fill_identity
    df = spark.createDataFrame(
        [("E1", "123-4", "Ana Soto", "Femenino", dt.date(1980, 1, 1), None, None),
         ("E2", None, None, None, None, "40", dt.datetime(2024, 5, 1)),
         (None, None, None, None, None, None, None)],
        "episodio string, run string, nombre string, sexo string, fecha_de_nacimiento date, "
        "edad string, marca_temporal timestamp_ntz")
    rows = {r["episodio"]: r for r in fill_identity(df).collect()}
    assert rows["E1"]["run"] == "123-4" and rows["E1"]["_synthetic_identity"] is False
    e2 = rows["E2"]
    assert e2["_synthetic_identity"] is True and e2["run"] == e2["rut"]
    body, dv = e2["run"].split("-")
    assert 7_000_000 <= int(body) <= 27_000_000
    assert one(spark, [int(body)], X.check_digit, "bigint") == [dv]
    assert e2["fecha_de_nacimiento"].year == 1984                # 2024 - 40
    assert (e2["sexo"] == "Masculino") == (e2["nombre"].split()[0] in X.MALE_FIRST_NAMES)
    assert rows[None]["run"] is None                               # no episode, no identity
