"""Level dictionaries (M7) and the scoring jobs (M20, M21) end to end.

The scoring jobs run a frozen boosted model of two small trees over patients derived
from ``customer`` and over the tables of the training run, so that preparation
(medians, modes, level codes, one spelling of unknown), trees, adjustment and
tiers have an SQL twin.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import features as FE
from ..operators import levels as LV
from ..operators import scoring as SC
from ..operators import training as TR
from ..session import read_table
from .clinical_queries import _CLINICAL
from .scoring_queries import INPUT_SQL, ROUND, _BOOST, _TIER_V, scoring_input
from .training_queries import clinical_and_survey

#: Frozen model: medians and modes that fill gaps, then trees over age, stay norm, social risk and service code.
MEDIANS = {"edad": 60.0, "fecha_estimada_de_alta": 5.0, "riesgo_social": 1.0}
BASE = -0.5


def _trees():
    first, second = B.Tree(), B.Tree()
    left = first.split(0, 0, 0)                                    # edad_i <= 65
    first.value[left], at = -0.25, left + 1
    below = first.split(at, 2, 1)                                  # riesgo_social_i <= 1.5
    first.value[below], first.value[below + 1] = 0.2, 0.75
    left = second.split(0, 3, 1)                                   # servicio_clinico_o <= 1.5
    second.value[left + 1], at = -0.125, left
    below = second.split(at, 1, 0)                                 # fecha_estimada_de_alta_i <= 6.5
    second.value[below], second.value[below + 1] = 0.5, 0.1
    return [first, second]


def _frozen(levels):
    prep = TR.Preparation("gbt", {"servicio_clinico": "Desconocido"}, {}, MEDIANS, {"servicio_clinico": levels})
    return prep, B.Boosted(prep.inputs(), [[65.0], [6.5], [0.5, 1.5], [-0.5, 1.5]], BASE, _trees())


def ordinal_codes(spark, sf):
    """M7 on a column with nearly a level per row; levels learned on the older orders."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.concat("o_orderstatus", F.lit("-"), F.col("o_custkey").cast("string")).alias("nivel"))
    old = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return LV.ordinal_code(o, "nivel", LV.ordinal_levels(old, "nivel"), "codigo").select("o_orderkey", "nivel", "codigo")


def score_new_patients(spark, sf):
    """M20 over one table of records."""
    records = scoring_input(spark, sf)
    levels = LV.ordinal_levels(records.where(F.col("c_custkey") % 3 == 0), "servicio_clinico")
    out = SC.score_new_patients(_frozen(levels), records, keep=["c_custkey"])
    return out.select("c_custkey", "sexo", "servicio_clinico", F.round("probabilidad_sobre_estadia", ROUND).alias("p"), "riesgo_categoria")


def score_two_tables(spark, sf):
    """M21 over a clinical and a survey table."""
    grd, survey = clinical_and_survey(spark, sf)
    levels = LV.ordinal_levels(grd.where(F.col("edad_en_anos") < 60), "servicio_ingreso_descripcion_")
    out = TR.score_tables(_frozen(levels), grd.drop("fecha_ingreso_completa", "estancia_del_episodio"), survey)
    return out.select("episodio", F.round("p", ROUND).alias("p"), "riesgo_categoria")


QUERIES = {f.__name__: f for f in (ordinal_codes, score_new_patients, score_two_tables)}


def _margin(edad, norma, social, code):
    return (f"{BASE} + CASE WHEN {edad} <= 65 THEN -0.25 WHEN {social} <= 1.5 THEN 0.2 ELSE 0.75 END"
            f" + CASE WHEN {code} > 1.5 THEN -0.125 WHEN {norma} <= 6.5 THEN 0.5 ELSE 0.1 END")


_GAPS = [f"coalesce({c}, {m})" for c, m in MEDIANS.items()]
ORACLE = {
    "ordinal_codes": """
WITH o AS (SELECT o_orderkey, o_orderdate, o_orderstatus || '-' || o_custkey AS nivel FROM orders),
l AS (SELECT nivel, row_number() OVER (ORDER BY nivel) - 1 AS codigo FROM (SELECT DISTINCT nivel FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01' AND nivel IS NOT NULL))
SELECT o.o_orderkey, o.nivel, CAST(coalesce(l.codigo, -1) AS BIGINT) AS codigo FROM o LEFT JOIN l USING (nivel)""",
    "score_new_patients": f"""
WITH {INPUT_SQL},
lev AS (SELECT servicio_clinico, row_number() OVER (ORDER BY servicio_clinico) - 1 AS code
        FROM (SELECT DISTINCT servicio_clinico FROM raw WHERE c_custkey % 3 = 0 AND servicio_clinico IS NOT NULL)),
med AS (SELECT median(fecha_estimada_de_alta) AS md, median(edad) AS me FROM feat),
m AS (SELECT f.* EXCLUDE (p), 1 / (1 + exp(-({_margin(_GAPS[0], _GAPS[1], _GAPS[2], 'coalesce(lev.code, -1)')}))) AS p
      FROM feat f LEFT JOIN lev USING (servicio_clinico)),
s AS (SELECT c_custkey, sexo, servicio_clinico, {'{boost}'} AS p FROM m, med)
SELECT c_custkey, sexo, servicio_clinico, round(p, 6) AS p, {_TIER_V} AS riesgo_categoria FROM s""".replace("{boost}", f"least(greatest({_BOOST}, 0.0), 1.0)"),
    "score_two_tables": f"""
WITH {_CLINICAL},
lev AS (SELECT servicio_clinico, row_number() OVER (ORDER BY servicio_clinico) - 1 AS code
        FROM (SELECT DISTINCT servicio_clinico FROM base WHERE edad < 60 AND servicio_clinico <> 'Desconocido')),
f AS (SELECT episodio, edad, norma, coalesce(lev.code, -1) AS code,
        CASE WHEN total IS NULL OR q33 IS NULL THEN 1.0 WHEN total <= q33 THEN 0.0 WHEN total <= q66 THEN 1.0 ELSE 2.0 END AS social
      FROM base LEFT JOIN lev USING (servicio_clinico), q2),
s AS (SELECT episodio, 1 / (1 + exp(-({_margin('edad', 'norma', 'social', 'code')}))) AS p FROM f)
SELECT episodio, round(p, 6) AS p, {_TIER_V} AS riesgo_categoria FROM s""",
}
