"""Prediction reports (A5-A8, A10, A11, T2, T6, M23): distributions, group
means, age bands, deciles and top-k, each a small aggregate over the scored
table. Label tables (tiers, age bands) are fixed dimension rows joined to the
aggregates so that empty categories are listed too."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import label_table
from .joins import with_scalars
from .stats import quantiles, summary_stats

DECILE_PROBS = [i / 10 for i in range(11)]


def _labels(spark, name: str, labels: Sequence[str]) -> DataFrame:
    return label_table(spark, name, labels)


def category_distribution(df: DataFrame, cat_col: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Count and percent of all rows per category (NULL category not
    listed but counted in the total); with ``labels`` zero-count categories
    are listed too."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    counts = df.where(F.col(cat_col).isNotNull()).groupBy(cat_col).agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        counts = _labels(df.sparkSession, cat_col, labels).join(counts, cat_col, "left") \
            .select(cat_col, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
    return (with_scalars(counts, total)
                  .select(cat_col, "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct")))


def mean_by_key(df: DataFrame, key: str, p_col: str) -> DataFrame:
    """Mean and count of the score per key; NULL keys are dropped."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.avg(p_col).alias("mean_p"), F.count(p_col).alias("n")))


def mean_by_age_band(df: DataFrame, age_col: str, p_col: str) -> DataFrame:
    """Mean and count per right-closed age band, empty bands included."""
    banded = (df.withColumn("grupo_edad", X.age_band(F.col(age_col)))
                .where(F.col("grupo_edad").isNotNull())
                .groupBy("grupo_edad").agg(F.avg(p_col).alias("mean_p"), F.count(p_col).alias("n")))
    bands = _labels(df.sparkSession, "grupo_edad", X.AGE_BAND_LABELS)
    return bands.join(banded, "grupo_edad", "left").select(
        "grupo_edad", "mean_p", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def decile_lift(df: DataFrame, y_col: str, p_col: str, method: str = "rank") -> DataFrame:
    """A10: excess rate and size per score decile.

    Edges are the exact 0, .1, ..., 1 quantiles with duplicates dropped; a row
    falls in bin = number of inner edges strictly below its score (right-closed
    bins, lowest value included), so tied scores give fewer than ten bins.
    """
    names = [f"_e{i}" for i in range(len(DECILE_PROBS))]
    q = quantiles(df, p_col, DECILE_PROBS, names, method)            # one row
    edges = q.select(F.array_distinct(F.array(*names)).alias("_edges"))
    binned = with_edges(df, edges).withColumn("decile", X.right_closed_bin(F.col(p_col), F.col("_edges")))
    return (binned.where(F.col(p_col).isNotNull()).groupBy("decile")
                  .agg(F.avg(F.col(y_col).cast("double")).alias("tasa_exceso"),
                       F.count(F.lit(1)).alias("n")))


def with_edges(df: DataFrame, edges: DataFrame) -> DataFrame:
    return with_scalars(df, edges)            # one-row aggregate -> scalar subquery


def tier_counts(df: DataFrame, p_col: str, low: float = X.LOW_RISK, high: float = X.HIGH_RISK) -> DataFrame:
    """One row of high / medium / low counts (scalar-form boundaries)."""
    p = F.col(p_col)
    return df.agg(F.count_if(p > high).alias("alto"),
                  F.count_if((p >= low) & (p <= high)).alias("medio"),
                  F.count_if(p < low).alias("bajo"))


def top_k(df: DataFrame, p_col: str, k: int, tiebreak: str) -> DataFrame:
    """The k highest scores (ties by ``tiebreak``); planned as a top-k."""
    return df.orderBy(F.col(p_col).desc(), F.col(tiebreak)).limit(k)


def high_risk(df: DataFrame, tier_col: str, p_col: str, tiebreak: str, k: int | None = 10) -> DataFrame:
    """Rows in the top tier, highest first (all, or the first k)."""
    hr = df.where(F.col(tier_col) == X.TIER_LABELS[-1])
    return top_k(hr, p_col, k, tiebreak) if k else hr


def analysis_report(df: DataFrame, p_col: str, age_col: str, key_col: str, id_col: str) -> dict:
    """The analysis bundle as a dict of DataFrames over one cached input."""
    base = df.withColumn("riesgo_categoria", X.tier_vector(F.col(p_col))).cache()
    return {
        "stats": summary_stats(base, p_col),
        "distribution": category_distribution(base, "riesgo_categoria", X.TIER_LABELS),
        "top10": top_k(base, p_col, 10, id_col),
        "by_age": mean_by_age_band(base, age_col, p_col),
        "by_service": mean_by_key(base, key_col, p_col),
        "tiers": tier_counts(base, p_col),
    }
