"""Scoring: feature frame for new patients (P17, X12-X14, X26), the
batch-dependent score adjustment (X15 with J7 medians), tiers (X16/X17) and
the scoring jobs (M13, M20-M22).

The adjustment needs two batch medians. They are one global aggregate
(one row) attached to every row by a broadcast of that single row; in a
stream ``reference_medians`` freezes them instead of using the micro-batch.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .joins import with_scalars

FEATURES = ["edad", "sexo", "servicio_clinico", "prevision", "fecha_estimada_de_alta",
            "riesgo_social", "riesgo_clinico", "riesgo_administrativo", "codigo_grd"]
NUMERIC_FEATURES = ["edad", "fecha_estimada_de_alta", "riesgo_social", "riesgo_clinico",
                    "riesgo_administrativo", "codigo_grd"]
CATEGORICAL_FEATURES = ["sexo", "servicio_clinico", "prevision"]
REQUIRED_INPUT = FEATURES

# FIXED VALUES: score adjustment constants.
RISK_DEFAULT = 1.0
RISK_SPAN, RISK_CENTER, RISK_WEIGHT = 6.0, 0.5, 0.2
DAYS_PIVOT, DAYS_SCALE, DAYS_CLIP, DAYS_WEIGHT = 5.0, 10.0, 0.5, 0.2
ICU_WORD, ICU_BOOST = "uci", 0.08
PUBLIC_WORD, PUBLIC_BOOST = "fonasa", 0.03
AGE_PIVOT, AGE_SCALE, AGE_MAX_BOOST = 70.0, 50.0, 0.08


def scoring_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The nine model features in fixed order (plus ``keep`` columns)."""
    missing = [c for c in REQUIRED_INPUT if c not in df.columns]
    if missing:                                       # P5, before any action
        raise ValueError(f"missing input columns: {missing}")
    return df.select(
        *[F.col(c) for c in keep],
        X.nan_to_null(X.lenient_float(F.col("edad"))).alias("edad"),
        *X.category_features(),
        X.allowed_stay_days(F.col("fecha_estimada_de_alta")).alias("fecha_estimada_de_alta"),
        X.encode_risk(F.col("riesgo_social")).alias("riesgo_social"),
        X.encode_risk(F.col("riesgo_clinico")).alias("riesgo_clinico"),
        X.encode_risk(F.col("riesgo_administrativo")).alias("riesgo_administrativo"),
        X.lenient_float(F.col("codigo_grd")).alias("codigo_grd"),
    )


def batch_medians(features: DataFrame) -> DataFrame:
    """The two batch medians the adjustment falls back to (one row)."""
    from .stats import quantiles_of
    return quantiles_of(features, [("fecha_estimada_de_alta", [0.5], ["_med_dias"]), ("edad", [0.5], ["_med_edad"])])


def _boost_terms(df: DataFrame, p_col: str) -> DataFrame:
    """X15, stage 1: the filled inputs, one projection (each used once below)."""
    rs = F.coalesce(F.col("riesgo_social"), F.lit(RISK_DEFAULT))
    rc = F.coalesce(F.col("riesgo_clinico"), F.lit(RISK_DEFAULT))
    ra = F.coalesce(F.col("riesgo_administrativo"), F.lit(RISK_DEFAULT))
    dias = F.coalesce(X.clip(F.col("fecha_estimada_de_alta"), 0.0), F.col("_med_dias"))
    edad = F.coalesce(F.col("edad"), F.col("_med_edad"))
    icu = F.when(F.lower(F.coalesce(F.col("servicio_clinico"), F.lit(""))).contains(ICU_WORD),
                 F.lit(ICU_BOOST)).otherwise(F.lit(0.0))
    public = F.when(F.lower(F.coalesce(F.col("prevision"), F.lit(""))).contains(PUBLIC_WORD),
                    F.lit(PUBLIC_BOOST)).otherwise(F.lit(0.0))
    return df.select("*", (rs + rc + ra).alias("_risk_sum"), dias.alias("_dias"), edad.alias("_edad"),
                     icu.alias("_icu"), public.alias("_public"))


def boost_expr(p: Column) -> Column:
    """X15, stage 2: over the columns of :func:`_boost_terms`."""
    risk_shift = (F.col("_risk_sum") / F.lit(RISK_SPAN) - F.lit(RISK_CENTER)) * F.lit(RISK_WEIGHT)
    days_shift = X.clip((F.lit(DAYS_PIVOT) - F.col("_dias")) / F.lit(DAYS_SCALE),
                        -DAYS_CLIP, DAYS_CLIP) * F.lit(DAYS_WEIGHT)
    age = X.clip((F.col("_edad") - F.lit(AGE_PIVOT)) / F.lit(AGE_SCALE), 0.0, AGE_MAX_BOOST)
    return p + risk_shift + days_shift + F.col("_icu") + F.col("_public") + age


def adjust_scores(features: DataFrame, p_col: str, out: str = "probabilidad_sobre_estadia",
                  reference_medians: Mapping[str, float] | None = None) -> DataFrame:
    """Adjusted probability; medians from the batch unless frozen."""
    if reference_medians is not None:
        df = features.withColumn("_med_dias", F.lit(reference_medians["dias"]).cast("double")) \
                     .withColumn("_med_edad", F.lit(reference_medians["edad"]).cast("double"))
    else:
        df = with_scalars(features, batch_medians(features))
    staged = _boost_terms(df, p_col)
    raw = staged.select(*features.columns, boost_expr(F.col(p_col)).alias("_adj"))
    return raw.select(*features.columns, X.clip(F.col("_adj"), 0.0, 1.0).alias(out))


def add_tiers(df: DataFrame, p_col: str, vector_out: str = "riesgo_categoria",
              scalar_out: str | None = None) -> DataFrame:
    """X16 (and optionally X17) tier labels."""
    df = df.withColumn(vector_out, X.tier_vector(F.col(p_col)))
    if scalar_out:
        df = df.withColumn(scalar_out, X.tier_scalar(F.col(p_col)))
    return df


def positive_probability(model, features: DataFrame, out: str = "p_modelo") -> DataFrame:
    """Probability of class 1 from a fitted MLlib pipeline (or a
    ``(preparation, model)`` pair as returned by ``training.fit``)."""
    from pyspark.ml.functions import vector_to_array
    if isinstance(model, tuple):
        from .training import margin
        return margin(model, features).withColumnRenamed("p_raw", out).drop("margin")
    scored = model.transform(features)
    return (scored.withColumn(out, vector_to_array(F.col("probability"))[1])
                  .drop("features", "rawPrediction", "probability", "prediction"))


def score_new_patients(model, records: DataFrame, keep: Sequence[str] = (),
                       reference_medians: Mapping[str, float] | None = None) -> DataFrame:
    """Features -> model probability -> adjustment -> tier, identity
    columns carried unchanged."""
    feats = scoring_features(records, keep)
    scored = positive_probability(model, feats, "_p_model")
    adjusted = adjust_scores(scored, "_p_model", reference_medians=reference_medians)
    keep_cols = list(keep) + FEATURES + ["probabilidad_sobre_estadia"]
    return add_tiers(adjusted.select(*keep_cols), "probabilidad_sobre_estadia")


# FIXED VALUES: the new-patient record layout.
RECORD_SCHEMA = ("edad int, sexo string, servicio_clinico string, prevision string, "
                 "fecha_estimada_de_alta string, riesgo_social string, riesgo_clinico string, "
                 "riesgo_administrativo string, codigo_grd bigint")


def records_frame(spark, records: Sequence[Mapping[str, object]], extra_schema: str = "") -> DataFrame:
    """A list of request records -> DataFrame with the fixed layout;
    identity columns named in ``extra_schema`` (e.g. ``"episodio string"``)
    are carried."""
    schema = RECORD_SCHEMA + (", " + extra_schema if extra_schema else "")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    rows = [tuple(r.get(n) for n in names) for r in records]
    return spark.createDataFrame(rows, schema)


def fill_template(df: DataFrame, template: Mapping[str, object]) -> DataFrame:
    """One projection that fills absent columns and NULL cells with the
    template's literals; other columns are carried."""
    cols = []
    for c, default in template.items():
        lit = F.lit(default)
        cols.append((F.coalesce(F.col(c), lit) if c in df.columns else lit).alias(c))
    extra = [F.col(c) for c in df.columns if c not in template]
    return df.select(*cols, *extra)
