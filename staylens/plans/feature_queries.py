"""Labels, weights, survey codes, splits, imputation, rare levels, sampling
(X18-X22, A9, M2, F8, M4-M6, T5, A13) on lineitem / part /
customer / orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import features as FE
from ..operators import sampling as SA
from ..session import read_table

ROUND = 6
CATEGORIES = ["soporte_financiero", "coordinacion_familiar", "otra", None, " Intervencion_Psicosocial "]


def excess_label_weight(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    j = li.join(part, "l_partkey", "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    X.excess_label(F.col("l_quantity"), F.col("p_size")).alias("excede_norma"),
                    F.round(X.sample_weight(F.col("l_quantity"), F.col("p_size")), ROUND).alias("peso"))


def tercile_code(spark, sf):
    c = read_table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cat = F.element_at(F.array(*[F.lit(v).cast("string") for v in CATEGORIES]), (k % 5 + 1).cast("int"))
    base = c.select("c_custkey", "c_acctbal",
                    F.when(n % 6 == 5, F.lit(None)).otherwise(n % 6).alias("salud_mental"),
                    F.when(k % 3 == 0, F.lit("Si ")).when(k % 3 == 1, F.lit("no")).alias("gestion"),
                    cat.alias("categoria"))
    coded = FE.with_tercile_code(base, "c_acctbal", "riesgo_social")
    return coded.select("c_custkey", "riesgo_social",
                        X.clinical_code(F.col("salud_mental")).alias("riesgo_clinico"),
                        X.admin_code(F.col("gestion"), F.col("categoria")).alias("riesgo_administrativo"))


def time_split(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("fecha"))
    train, test = FE.time_split(o, "fecha")
    return (train.select("o_orderkey", F.lit("train").alias("lado"))
            .unionByName(test.select("o_orderkey", F.lit("test").alias("lado"))))


def _part_with_gaps(spark, sf):
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey",
                    F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("precio"),
                    F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("marca"),
                    F.when(F.col("p_size") <= 45, F.col("p_brand")).otherwise(F.col("p_type")).alias("nivel"))


def median_impute(spark, sf):
    out = FE.impute_median(_part_with_gaps(spark, sf), ["precio"])
    return out.select("p_partkey", F.round("precio", ROUND).alias("precio"))


def mode_impute(spark, sf):
    return FE.impute_mode(_part_with_gaps(spark, sf), ["marca"]).select("p_partkey", "marca")


def rare_levels(spark, sf):
    return FE.pool_rare_levels(_part_with_gaps(spark, sf), "nivel", 0.01).select("p_partkey", "nivel")


def sample_hash(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    n = SA.sample_size(o.count())
    return SA.hash_sample(o, "o_orderkey", n, seed=42)


PROFILED = ("l_partkey", "l_suppkey", "l_linenumber")


def profile_generated(spark, sf):
    """Min, max and distinct count of columns of a stored table."""
    from ..operators.stats import profile
    g = read_table(spark, sf, "lineitem")
    parts = [profile(g.select(F.col(c).cast("bigint").alias(c)), c).select(F.lit(c).alias("columna"), "*")
             for c in PROFILED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "profile_generated": profile_generated,
    "excess_label_weight": excess_label_weight,
    "tercile_code": tercile_code,
    "time_split": time_split,
    "median_impute": median_impute,
    "mode_impute": mode_impute,
    "rare_levels": rare_levels,
    "sample_hash": sample_hash,
}


_GAPS = """
pg AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS precio,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS marca,
         CASE WHEN p_size <= 45 THEN p_brand ELSE p_type END AS nivel
  FROM part)"""

ORACLE = {
    "excess_label_weight": """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  coalesce(CAST(l.l_quantity > p.p_size AS INTEGER), 0) AS excede_norma,
  round(least(greatest(1.0 + 0.05 * coalesce(CASE WHEN l.l_quantity - p.p_size < 0 THEN 0.0
                                                  ELSE l.l_quantity - p.p_size END, 0.0), 1.0), 3.0), 6) AS peso
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "tercile_code": """
WITH b AS (
  SELECT c_custkey, c_acctbal,
    CASE WHEN c_nationkey % 6 = 5 THEN NULL ELSE c_nationkey % 6 END AS salud_mental,
    CASE WHEN c_custkey % 3 = 0 THEN 'Si ' WHEN c_custkey % 3 = 1 THEN 'no' END AS gestion,
    (['soporte_financiero', 'coordinacion_familiar', 'otra', NULL, ' Intervencion_Psicosocial '])[c_custkey % 5 + 1]
      AS categoria
  FROM customer),
q AS (SELECT quantile_cont(c_acctbal, 0.33) AS q33, quantile_cont(c_acctbal, 0.66) AS q66 FROM b),
q2 AS (SELECT q33, CASE WHEN q66 <= q33 THEN q33 + 1e-6 ELSE q66 END AS q66 FROM q)
SELECT c_custkey,
  CAST(CASE WHEN c_acctbal IS NULL OR q33 IS NULL THEN 1.0 WHEN c_acctbal <= q33 THEN 0.0
       WHEN c_acctbal <= q66 THEN 1.0 ELSE 2.0 END AS DOUBLE) AS riesgo_social,
  coalesce(CASE WHEN salud_mental IS NULL THEN NULL
                ELSE least(greatest(CAST(salud_mental AS DOUBLE) - 1.0, 0.0), 2.0) END, 1.0) AS riesgo_clinico,
  CAST(greatest(CASE WHEN lower(trim(gestion)) = 'si' THEN 1.0 ELSE 0.0 END,
           coalesce(CASE lower(trim(categoria))
                      WHEN 'coordinacion_familiar' THEN 1.0 WHEN 'coordinacion_interinstitucional' THEN 1.0
                      WHEN 'soporte_financiero' THEN 2.0 WHEN 'intervencion_psicosocial' THEN 2.0
                      WHEN 'derivacion_apoyo_psicosocial' THEN 2.0 END, 0.0)) AS DOUBLE) AS riesgo_administrativo
FROM b, q2""",
    "time_split": """
WITH e AS (SELECT o_orderkey, epoch(o_orderdate) AS s FROM orders),
c AS (SELECT quantile_cont(s, 0.8) AS cut FROM e)
SELECT o_orderkey, CASE WHEN s <= cut THEN 'train' ELSE 'test' END AS lado
FROM e, c WHERE s IS NOT NULL""",
    "median_impute": f"""
WITH {_GAPS}
SELECT p_partkey, round(coalesce(precio, (SELECT median(precio) FROM pg)), 6) AS precio FROM pg""",
    "mode_impute": f"""
WITH {_GAPS},
m AS (SELECT marca FROM pg WHERE marca IS NOT NULL GROUP BY marca ORDER BY count(*) DESC, marca LIMIT 1)
SELECT p_partkey, coalesce(pg.marca, (SELECT marca FROM m)) AS marca FROM pg""",
    "rare_levels": f"""
WITH {_GAPS},
f AS (SELECT nivel, count(*) AS c FROM pg GROUP BY nivel)
SELECT p_partkey, CASE WHEN f.c < (SELECT count(*) FROM pg) * 0.01 THEN '__infrequent__' ELSE pg.nivel END AS nivel
FROM pg LEFT JOIN f ON pg.nivel IS NOT DISTINCT FROM f.nivel""",
    "sample_hash": """
SELECT o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#42'), o_orderkey)
        <= (SELECT least(5000, CAST(floor(count(*) * 0.15) AS BIGINT)) FROM orders)""",
}


ORACLE["profile_generated"] = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, CAST(min({c}) AS BIGINT) AS minimo, CAST(max({c}) AS BIGINT) AS maximo, "
    f"count(DISTINCT {c}) AS distintos FROM lineitem" for c in PROFILED)
