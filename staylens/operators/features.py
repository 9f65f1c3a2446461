"""Training-set assembly (M1), splits (M2, M3), survey-derived codes
and the imputation / rare-level steps of the model pipeline (M4-M6, M8).

Whole-table quantiles, medians, modes and level frequencies are global
aggregates: one row, attached by a broadcast of that row. Level frequency
tables have one row per distinct level of a categorical column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import scalars as X
from .joins import left_join_suffixed, with_scalars
from .ranking import position_in_key
from .sampling import hash_order
from .stats import quantile_col, quantiles, quantiles_of

GRD_REQUIRED = ["edad_en_anos", "sexo_desc_", "servicio_ingreso_descripcion_", "prevision_desc_",
                "ir_grd_codigo_"]
SCORE_REQUIRED = ["total", "salud_mental", "gestion", "categorizacion_de_gestion"]
SCORE_KEY_CANDIDATES = ["episodio", "buscar_episodio_con_asignacion_encuesta"]
INFREQUENT = "__infrequent__"
TRAIN_SHARE = 0.8


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def with_tercile_code(df: DataFrame, value: str, out: str, exact: bool = True) -> DataFrame:
    """X20 using whole-table 0.33 / 0.66 quantiles (one broadcast row)."""
    q = quantiles(df, value, [0.33, 0.66], ["_q33", "_q66"], "rank" if exact else "approx")
    v = X.nan_to_null(F.col(value).cast("double"))
    return (with_scalars(df, q)
            .withColumn(out, X.tercile_code(v, F.col("_q33"), F.col("_q66")))
            .drop("_q33", "_q66"))


def make_dataset(grd: DataFrame, score: DataFrame, episode_grd: str = "episodio_cmbd",
                 fecha: str | None = "fecha_ingreso_completa", stay: str = "estancia_del_episodio",
                 norm: str = "estancia_norma_grd", exact_quantiles: bool = True) -> DataFrame:
    """M1: GRD x Score left join, label, weight and the nine features.

    Returns (episodio, features..., excede_norma, peso, fecha).
    """
    req = [c for c in [episode_grd, fecha, norm, stay, *GRD_REQUIRED] if c]
    H.require(grd.columns, req, "GRD")
    ep_score = H.first_existing(score.columns, SCORE_KEY_CANDIDATES)
    if ep_score is None:
        raise ValueError(f"Score: none of {SCORE_KEY_CANDIDATES}")
    H.require(score.columns, SCORE_REQUIRED, "Score")
    g = grd.select(*req)
    s = score.select(ep_score, *SCORE_REQUIRED)
    df = left_join_suffixed(g, s, episode_grd, ep_score, suffix="_score")
    df = df.select(
        "*",
        (X.excess_label(F.col(stay).cast("double"), F.col(norm).cast("double")) if stay
         else F.lit(None).cast("int")).alias("excede_norma"),
        (X.sample_weight(F.col(stay), F.col(norm)) if stay else F.lit(1.0)).alias("peso"),
        X.nan_to_null(F.col("total").cast("double")).alias("_total"))
    df = with_tercile_code(df, "_total", "riesgo_social", exact_quantiles)
    return df.select(
        F.col(episode_grd).cast("string").alias("episodio"),
        X.nan_to_null(F.col("edad_en_anos").cast("double")).alias("edad"),
        *X.category_features(sexo="sexo_desc_", servicio_clinico="servicio_ingreso_descripcion_", prevision="prevision_desc_"),
        X.nan_to_null(F.col(norm).cast("double")).alias("fecha_estimada_de_alta"),
        F.col("riesgo_social"),
        X.clinical_code(F.col("salud_mental")).alias("riesgo_clinico"),
        X.admin_code(F.col("gestion"), F.col("categorizacion_de_gestion")).alias("riesgo_administrativo"),
        X.nan_to_null(F.col("ir_grd_codigo_").cast("double")).alias("codigo_grd"),
        "excede_norma", "peso",
        (F.col(fecha).cast("timestamp_ntz") if fecha else F.lit(None).cast("timestamp_ntz")).alias("fecha"),
    )


def time_split(df: DataFrame, fecha: str = "fecha", q: float = TRAIN_SHARE, method: str = "rank"):
    """M2 / F8: cut at the q-quantile of the date; NULL dates fall in neither side.

    Timestamps are high-cardinality, so the exact cut uses ranks by default."""
    cut = quantiles(df.select(epoch_seconds(F.col(fecha)).alias("_e")), "_e", [q], ["_cut"], method)
    tagged = with_scalars(df, cut)
    train = tagged.where(epoch_seconds(F.col(fecha)) <= F.col("_cut")).drop("_cut")
    test = tagged.where(epoch_seconds(F.col(fecha)) > F.col("_cut")).drop("_cut")
    return train, test


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 42, share: float = TRAIN_SHARE):
    """M3: per-class split by hash order; the first round(share * n_class) rows
    of each class (in hash order) train. A class is ranked by slices of the hash,
    so it never has to fit in one task."""
    h = hash_order(id_col, seed)
    ranked = position_in_key(df.withColumn("_h", h), [label], ["_h", id_col], name="_r")     # sliced by two hash digits
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    tagged = ranked.join(sizes, ranked[label].eqNullSafe(sizes["_class"])).drop("_class")   # NULL is a class
    is_train = F.col("_r") < F.round(F.col("_n") * share)
    train = tagged.where(is_train).drop("_h", "_r", "_n")
    test = tagged.where(~is_train).drop("_h", "_r", "_n")
    return train, test


def impute_median(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """M4: NULL -> whole-column median (one row for all columns, found in the same aggregates)."""
    if not cols:
        return df
    if exact:
        medians = quantiles_of(df, [(c, [0.5], ["_med_" + c]) for c in cols])
    else:
        medians = df.agg(*[quantile_col(c, 0.5, exact=False).alias("_med_" + c) for c in cols])
    out = with_scalars(df, medians)
    return out.select(*[F.coalesce(X.nan_to_null(F.col(c)), F.col("_med_" + c)).alias(c) if c in cols
                        else F.col(c) for c in df.columns])


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M5: NULL -> most frequent value (ties: the smallest value)."""
    out = df
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_mode_" + c)).agg(F.count(F.lit(1)).alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_mode_" + c).alias("v")))       # combined map-side
        out = with_scalars(out, counts.agg(best["v"].alias("_mode_" + c)))
    return out.select(*[F.coalesce(F.col(c), F.col("_mode_" + c)).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def pool_rare_levels(df: DataFrame, col: str, min_frequency: float = 0.01,
                     label: str = INFREQUENT) -> DataFrame:
    """M6: levels seen in fewer than ``min_frequency`` of the rows become one level."""
    n = df.agg(F.count(F.lit(1)).alias("_rows"))
    freq = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    # at most 1 / min_frequency levels are kept: they are one scalar, no row moves (NULL is a level)
    kept = (with_scalars(freq, n).where(F.col("_cnt") >= F.col("_rows") * min_frequency)
            .agg(F.collect_list(F.struct(F.col(col).alias("l"))).alias("_kept")))
    out = with_scalars(df, kept)
    held = F.array_contains("_kept", F.struct(F.col(col).alias("l")))
    return out.select(*[F.when(held, F.col(c)).otherwise(F.lit(label)).alias(c) if c == col
                        else F.col(c) for c in df.columns])


def class_weights(df: DataFrame, label: str, base_weight: str | None = None, out: str = "w") -> DataFrame:
    """M8: balanced class weight n / (2 * n_class), times the sample weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    k = counts.agg(F.count(F.lit(1)).alias("_k"))
    cw = with_scalars(with_scalars(counts, total), k).select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("_cw"))
    base = F.col(base_weight) if base_weight else F.lit(1.0)
    cw = cw.withColumnRenamed(label, "_class")
    return df.join(cw, df[label].eqNullSafe(cw["_class"])).withColumn(out, F.col("_cw") * base).drop("_cw", "_class")


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def coerce_types(df: DataFrame, exclude: Sequence[str] = ()):
    """Split columns by schema into numeric (numbers and booleans, forced
    to DOUBLE with NaN -> NULL) and categorical (forced to STRING; NULL stays
    NULL). Returns (frame, numeric names, categorical names)."""
    num, cat, cols = [], [], []
    for name, typ in df.dtypes:
        if name in exclude:
            cols.append(F.col(name))
        elif typ in NUMERIC_TYPES or typ.startswith("decimal"):
            num.append(name)
            cols.append(X.nan_to_null(F.col(name).cast("double")).alias(name))
        else:
            cat.append(name)
            cols.append(F.col(name).cast("string").alias(name))
    return df.select(*cols), num, cat
