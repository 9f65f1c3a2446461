"""Scoring features, adjustment, tiers and reports (P17, X12-X17, X26, J7,
A5-A8, A10, T2, X23) on a scoring input derived from ``customer``, and
evaluation metrics (M14-M19) on ``labels`` joined to ``documents``.

Every input column is derived row by row from the table, so the work grows
with it; the derivations only manufacture the messy text the scoring path
has to cope with (labels, blanks, dates in a number column, out-of-range
codes, probabilities on the tier boundaries).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import scoring as SC
from ..operators.stats import summary_stats
from ..session import read_table

ROUND = 6

SEX_TEXT = ["m", "Masculino", " H ", "hombre", "F", "femenino", "MUJER", "x", None, ""]
SOCIAL_TEXT = ["bajo", "Media", "ALTO", "2", "x", None]
CLINICAL_TEXT = ["0", "1", "2", "3", "-1", "alta", "media"]
ADMIN_TEXT = ["medio", None, "1", "baja"]


def _pick(values, k):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (k % len(values) + 1).cast("int"))


def scoring_input(spark, sf):
    """New-patient records (FIXTURES §5 layout) derived from customer rows."""
    c = read_table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        "c_custkey",
        ((k % 111).cast("double") / F.lit(100.0)).alias("p"),
        F.col("c_mktsegment"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise((F.lit(31) + k % 69).cast("string")).alias("edad"),
        _pick(SEX_TEXT, k).alias("sexo"),
        F.when(n == 7, F.lit(None)).otherwise(
            F.concat(F.col("c_mktsegment"), F.when(n % 5 == 0, F.lit(" UCI")).otherwise(F.lit("")))
        ).alias("servicio_clinico"),
        F.when(n % 2 == 0, F.lit("FONASA A")).otherwise(F.lit("Isapre")).alias("prevision"),
        F.when(n == 24, F.lit(None)).when(n == 23, F.lit("2024-03-15"))
         .otherwise((n - 3).cast("string")).alias("fecha_estimada_de_alta"),
        _pick(SOCIAL_TEXT, k).alias("riesgo_social"),
        _pick(CLINICAL_TEXT, k).alias("riesgo_clinico"),
        _pick(ADMIN_TEXT, k).alias("riesgo_administrativo"),
        (F.lit(51401) + k % 50).cast("string").alias("codigo_grd"),
    )


def _scored_patients(spark, sf):
    raw = scoring_input(spark, sf)
    return SC.scoring_features(raw, keep=["c_custkey", "p", "c_mktsegment"])


def risk_boost(spark, sf):
    feats = _scored_patients(spark, sf)
    adj = SC.adjust_scores(feats, "p", out="p_ajustada")
    return adj.select("c_custkey", F.round("p_ajustada", ROUND).alias("p_ajustada"))


def tiers_vector(spark, sf):
    s = scoring_input(spark, sf)
    return s.select("c_custkey", F.round("p", ROUND).alias("p"),
                    X.tier_vector(F.col("p")).alias("riesgo_categoria"))


def tiers_scalar(spark, sf):
    s = scoring_input(spark, sf)
    return s.select("c_custkey", F.round("p", ROUND).alias("p"),
                    X.tier_scalar(F.col("p")).alias("riesgo_categoria"))


def _rounded(df):
    return df.select(*[F.round(c, ROUND).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def score_stats(spark, sf):
    return _rounded(summary_stats(scoring_input(spark, sf), "p"))


def tier_distribution(spark, sf):
    s = scoring_input(spark, sf).withColumn("riesgo_categoria", X.tier_vector(F.col("p")))
    return _rounded(R.category_distribution(s, "riesgo_categoria", X.TIER_LABELS))


def mean_by_key(spark, sf):
    s = scoring_input(spark, sf).withColumnRenamed("c_mktsegment", "servicio")
    return _rounded(R.mean_by_key(s, "servicio", "p"))


def age_bands(spark, sf):
    feats = _scored_patients(spark, sf)
    return _rounded(R.mean_by_age_band(feats, "edad", "p"))


def topk(spark, sf):
    s = scoring_input(spark, sf)
    return _rounded(R.top_k(s.select("c_custkey", "p"), "p", 10, "c_custkey"))


def scored_documents(spark, sf):
    """Outcome = labels.quality; score = a monotone function of document length."""
    lab = read_table(spark, sf, "labels").where(F.col("quality").isNotNull())
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    p = F.floor(F.col("n_chars") * 1000 / (F.col("n_chars") + 2000)) / F.lit(1000.0)
    return lab.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"))


def decile_lift(spark, sf):
    return _rounded(R.decile_lift(scored_documents(spark, sf), "y", "p"))


def roc_auc(spark, sf):
    return _rounded(M.roc_auc(scored_documents(spark, sf), "y", "p"))


def avg_precision(spark, sf):
    return _rounded(M.average_precision(scored_documents(spark, sf), "y", "p"))


def brier(spark, sf):
    return _rounded(M.brier(scored_documents(spark, sf), "y", "p"))


def roc_points(spark, sf):
    return _rounded(M.roc_points(scored_documents(spark, sf), "y", "p"))


def pr_points(spark, sf):
    return _rounded(M.pr_points(scored_documents(spark, sf), "y", "p"))


def calibration_curve(spark, sf):
    return _rounded(M.calibration_curve(scored_documents(spark, sf), "y", "p"))


def tier_counts(spark, sf):
    return R.tier_counts(scoring_input(spark, sf), "p")


def high_risk(spark, sf):
    s = scoring_input(spark, sf).withColumn("riesgo_categoria", X.tier_vector(F.col("p")))
    hr = R.high_risk(s.select("c_custkey", "p", "riesgo_categoria"), "riesgo_categoria", "p", "c_custkey", 10)
    return _rounded(hr)


def preview(spark, sf):
    """T4: the first 200 scored rows by key, with score and outcome."""
    s = scored_documents(spark, sf)
    return s.orderBy("doc_id").limit(200).select("doc_id", F.round("p", ROUND).alias("p_excede_norma"),
                                                  F.col("y").alias("y_real"))


QUERIES = {
    "tier_counts": tier_counts,
    "high_risk": high_risk,
    "preview": preview,
    "risk_boost": risk_boost,
    "tiers_vector": tiers_vector,
    "tiers_scalar": tiers_scalar,
    "score_stats": score_stats,
    "tier_distribution": tier_distribution,
    "mean_by_key": mean_by_key,
    "age_bands": age_bands,
    "topk": topk,
    "decile_lift": decile_lift,
    "roc_auc": roc_auc,
    "avg_precision": avg_precision,
    "brier": brier,
    "roc_points": roc_points,
    "pr_points": pr_points,
    "calibration_curve": calibration_curve,
}


# --- SQL twins ---------------------------------------------------------------
def _lst(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


def _clip(x, lo=None, hi=None):
    out = x
    if lo is not None:
        out = f"CASE WHEN {out} < {lo} THEN {lo} ELSE {out} END"
    if hi is not None:
        out = f"CASE WHEN {out} > {hi} THEN {hi} ELSE {out} END"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {out} END)"


def _risk(x):
    words = "CASE lower(trim({x})) WHEN 'bajo' THEN 0.0 WHEN 'baja' THEN 0.0 WHEN 'medio' THEN 1.0 " \
            "WHEN 'media' THEN 1.0 WHEN 'alto' THEN 2.0 WHEN 'alta' THEN 2.0 END".format(x=x)
    v = f"coalesce(TRY_CAST(trim({x}) AS DOUBLE), {words})"
    return _clip(v, "0.0", "2.0")


INPUT_SQL = f"""
raw AS (
  SELECT c_custkey, CAST(c_custkey % 111 AS DOUBLE) / 100.0 AS p, c_mktsegment,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(31 + c_custkey % 69 AS VARCHAR) END AS edad,
    ({_lst(SEX_TEXT)})[c_custkey % 10 + 1] AS sexo,
    CASE WHEN c_nationkey = 7 THEN NULL
         ELSE c_mktsegment || CASE WHEN c_nationkey % 5 = 0 THEN ' UCI' ELSE '' END END AS servicio_clinico,
    CASE WHEN c_nationkey % 2 = 0 THEN 'FONASA A' ELSE 'Isapre' END AS prevision,
    CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey = 23 THEN '2024-03-15'
         ELSE CAST(c_nationkey - 3 AS VARCHAR) END AS fecha_estimada_de_alta,
    ({_lst(SOCIAL_TEXT)})[c_custkey % 6 + 1] AS riesgo_social,
    ({_lst(CLINICAL_TEXT)})[c_custkey % 7 + 1] AS riesgo_clinico,
    ({_lst(ADMIN_TEXT)})[c_custkey % 4 + 1] AS riesgo_administrativo,
    CAST(51401 + c_custkey % 50 AS VARCHAR) AS codigo_grd
  FROM customer),
feat AS (
  SELECT c_custkey, p, c_mktsegment,
    TRY_CAST(trim(edad) AS DOUBLE) AS edad,
    CASE WHEN sexo IS NULL THEN 'Desconocido'
         WHEN lower(trim(sexo)) IN ('m', 'masculino', 'h', 'hombre') THEN 'Hombre'
         WHEN lower(trim(sexo)) IN ('f', 'femenino', 'mujer') THEN 'Mujer' ELSE sexo END AS sexo,
    coalesce(servicio_clinico, 'Desconocido') AS servicio_clinico,
    coalesce(prevision, 'Desconocido') AS prevision,
    coalesce(TRY_CAST(trim(fecha_estimada_de_alta) AS DOUBLE),
             CAST(day(TRY_CAST(fecha_estimada_de_alta AS DATE)) AS DOUBLE)) AS fecha_estimada_de_alta,
    {_risk('riesgo_social')} AS riesgo_social,
    {_risk('riesgo_clinico')} AS riesgo_clinico,
    {_risk('riesgo_administrativo')} AS riesgo_administrativo,
    TRY_CAST(codigo_grd AS DOUBLE) AS codigo_grd
  FROM raw)"""

_DIAS = f"coalesce({_clip('fecha_estimada_de_alta', '0.0')}, md)"
_BOOST = (
    "p + ((coalesce(riesgo_social, 1.0) + coalesce(riesgo_clinico, 1.0) + coalesce(riesgo_administrativo, 1.0))"
    " / 6.0 - 0.5) * 0.2"
    f" + {_clip(f'(5.0 - {_DIAS}) / 10.0', '-0.5', '0.5')} * 0.2"
    " + CASE WHEN contains(lower(coalesce(servicio_clinico, '')), 'uci') THEN 0.08 ELSE 0.0 END"
    " + CASE WHEN contains(lower(coalesce(prevision, '')), 'fonasa') THEN 0.03 ELSE 0.0 END"
    f" + {_clip('(coalesce(edad, me) - 70.0) / 50.0', '0.0', '0.08')}"
)

SCORED_SQL = """
s AS (
  SELECT l.doc_id, l.quality AS y,
         floor(d.n_chars * 1000 / (d.n_chars + 2000)) / 1000.0 AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  WHERE l.quality IS NOT NULL),
d AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
      FROM s WHERE p IS NOT NULL GROUP BY p),
c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p) AS cpos, sum(neg) OVER (ORDER BY p) AS cneg FROM d),
t AS (SELECT sum(pos) AS tot_pos, sum(neg) AS tot_neg FROM d),
a AS (SELECT c.*, t.tot_pos, t.tot_neg, t.tot_pos - c.cpos + c.pos AS tp,
             t.tot_neg - c.cneg + c.neg AS fp FROM c, t)"""

_TIER_V = ("CASE WHEN p >= 0 AND p <= 0.33 THEN 'Baja' WHEN p > 0.33 AND p <= 0.66 THEN 'Media' "
           "WHEN p > 0.66 AND p <= 1 THEN 'Alta' END")
_CAL = " + ".join(f"CASE WHEN {repr(i * 0.1)} < p THEN 1 ELSE 0 END" for i in range(1, 10))

ORACLE = {
    "tier_counts": f"""WITH {INPUT_SQL}
SELECT count(*) FILTER (WHERE p > 0.66) AS alto, count(*) FILTER (WHERE p >= 0.33 AND p <= 0.66) AS medio,
       count(*) FILTER (WHERE p < 0.33) AS bajo FROM raw""",
    "high_risk": f"""WITH {INPUT_SQL}
SELECT c_custkey, round(p, 6) AS p, riesgo_categoria FROM (SELECT c_custkey, p, {_TIER_V} AS riesgo_categoria FROM raw) t
WHERE riesgo_categoria = 'Alta' ORDER BY p DESC, c_custkey LIMIT 10""",
    "preview": f"""WITH {SCORED_SQL}
SELECT doc_id, round(p, 6) AS p_excede_norma, y AS y_real FROM s ORDER BY doc_id LIMIT 200""",
    "risk_boost": f"""
WITH {INPUT_SQL},
med AS (SELECT median(fecha_estimada_de_alta) AS md, median(edad) AS me FROM feat)
SELECT c_custkey, round({_clip(_BOOST, '0.0', '1.0')}, 6) AS p_ajustada FROM feat, med""",
    "tiers_vector": f"WITH {INPUT_SQL}\nSELECT c_custkey, round(p, 6) AS p, {_TIER_V} AS riesgo_categoria FROM raw",
    "tiers_scalar": f"""WITH {INPUT_SQL}
SELECT c_custkey, round(p, 6) AS p,
       CASE WHEN p IS NULL THEN 'Desconocido' WHEN p < 0.33 THEN 'Baja' WHEN p <= 0.66 THEN 'Media'
            ELSE 'Alta' END AS riesgo_categoria FROM raw""",
    "score_stats": f"""WITH {INPUT_SQL}
SELECT count(p) AS n, round(avg(p), 6) AS media, round(median(p), 6) AS mediana,
       round(max(p), 6) AS maximo, round(min(p), 6) AS minimo, round(stddev_samp(p), 6) AS desviacion
FROM raw""",
    "tier_distribution": f"""WITH {INPUT_SQL},
tv AS (SELECT {_TIER_V} AS riesgo_categoria FROM raw),
cnt AS (SELECT riesgo_categoria, count(*) AS n FROM tv WHERE riesgo_categoria IS NOT NULL GROUP BY 1),
labels_t(riesgo_categoria) AS (VALUES ('Baja'), ('Media'), ('Alta'))
SELECT l.riesgo_categoria, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) * 100.0 / (SELECT count(*) FROM raw), 6) AS pct
FROM labels_t l LEFT JOIN cnt c ON l.riesgo_categoria = c.riesgo_categoria""",
    "mean_by_key": f"""WITH {INPUT_SQL}
SELECT c_mktsegment AS servicio, round(avg(p), 6) AS mean_p, count(p) AS n
FROM raw WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
    "age_bands": f"""WITH {INPUT_SQL},
b AS (SELECT p, CASE WHEN edad > 0 AND edad <= 30 THEN '<30' WHEN edad > 30 AND edad <= 50 THEN '30-50'
                     WHEN edad > 50 AND edad <= 70 THEN '50-70' WHEN edad > 70 AND edad <= 100 THEN '70+'
                END AS grupo_edad FROM feat),
g AS (SELECT grupo_edad, avg(p) AS mean_p, count(p) AS n FROM b WHERE grupo_edad IS NOT NULL GROUP BY 1),
bands(grupo_edad) AS (VALUES ('<30'), ('30-50'), ('50-70'), ('70+'))
SELECT bands.grupo_edad, round(g.mean_p, 6) AS mean_p, coalesce(g.n, 0) AS n
FROM bands LEFT JOIN g ON bands.grupo_edad = g.grupo_edad""",
    "topk": f"""WITH {INPUT_SQL}
SELECT c_custkey, round(p, 6) AS p FROM raw ORDER BY p DESC, c_custkey LIMIT 10""",
    "decile_lift": f"""WITH {SCORED_SQL},
e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))
             AS edges FROM s),
b AS (SELECT s.y, CAST(len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < s.p)) AS INTEGER) AS decile
      FROM s, e WHERE s.p IS NOT NULL)
SELECT decile, round(avg(CAST(y AS DOUBLE)), 6) AS tasa_exceso, count(*) AS n FROM b GROUP BY decile""",
    "roc_auc": f"""WITH {SCORED_SQL}
SELECT round(sum(pos * ((cneg - neg) + 0.5 * neg)) / (max(tot_pos) * max(tot_neg)), 6) AS roc_auc FROM a""",
    "avg_precision": f"""WITH {SCORED_SQL}
SELECT round(sum(pos / tot_pos * (tp / (tp + fp))), 6) AS avg_precision FROM a""",
    "brier": f"""WITH {SCORED_SQL}
SELECT round(avg(pow(p - CAST(y AS DOUBLE), 2)), 6) AS brier FROM s""",
    "roc_points": f"""WITH {SCORED_SQL}
SELECT round(p, 6) AS threshold, round(fp / tot_neg, 6) AS fpr, round(tp / tot_pos, 6) AS tpr FROM a""",
    "pr_points": f"""WITH {SCORED_SQL}
SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / tot_pos, 6) AS recall FROM a""",
    "calibration_curve": f"""WITH {SCORED_SQL}
SELECT {_CAL} AS bin, round(avg(p), 6) AS prob_pred, round(avg(CAST(y AS DOUBLE)), 6) AS prob_true,
       count(*) AS n
FROM s WHERE p IS NOT NULL GROUP BY 1""",
}
