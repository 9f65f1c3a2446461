"""Whole-table statistics used as scalars: quantiles, medians, modes (A9,
M4, M5, A5, A13). Each is a global aggregate, i.e. one row: attaching it to
every row is a broadcast of a single row (J7)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null
from ..session import numeric_values_table


def quantile_col(c, probs: float | Sequence[float], exact: bool = True,
                 accuracy: int = 10000) -> Column:
    """Linear-interpolation quantile(s), equal to pandas/DuckDB
    ``quantile_cont``. ``exact=False`` switches to ``percentile_approx``
    (bounded memory per task for very high-cardinality columns)."""
    c = nan_to_null(F.col(c) if isinstance(c, str) else c)
    if exact:
        return F.percentile(c, list(probs) if isinstance(probs, (list, tuple)) else probs)
    return F.percentile_approx(c, list(probs) if isinstance(probs, (list, tuple)) else probs, accuracy)


def quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str],
              method: str = "exact") -> DataFrame:
    """One-row DataFrame with one column per requested quantile.

    ``method``: ``"exact"`` = ``percentile`` (one aggregate; memory grows with
    the number of distinct values, fine for ages, day counts, codes);
    ``"rank"`` = exact by radix selection (bounded memory, for
    high-cardinality columns such as scores and timestamps);
    ``"approx"`` = ``percentile_approx``.
    """
    if method == "rank":
        return quantiles_of(df, [(col, probs, names)])
    arr = df.agg(quantile_col(col, list(probs), method == "exact").alias("_q"))
    return arr.select(*[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def quantiles_of(df: DataFrame, wanted: Sequence[tuple]) -> DataFrame:
    """Exact quantiles of several columns in the same aggregates, as one row.
    ``wanted``: (column, probabilities, output names)."""
    from .selection import exact_quantiles
    found = exact_quantiles(df, [(c, probs) for c, probs, _ in wanted])
    row = tuple(v for values in found for v in values)
    return numeric_values_table(df.sparkSession, [row], [(n, "DOUBLE") for _, _, names in wanted for n in names])


def summary_stats(df: DataFrame, col: str, median_method: str = "rank") -> DataFrame:
    """A5: count, mean, median, max, min, sample standard deviation.

    Scores are high-cardinality, so the median uses exact ranks by default
    (``median_method="exact"`` keeps it inside the single aggregate)."""
    c = nan_to_null(F.col(col))
    if median_method == "exact":
        return df.agg(F.count(c).alias("n"), F.avg(c).alias("media"),
                      F.percentile(c, 0.5).alias("mediana"), F.max(c).alias("maximo"),
                      F.min(c).alias("minimo"), F.stddev_samp(c).alias("desviacion"))
    from .joins import with_scalars
    base = df.agg(F.count(c).alias("n"), F.avg(c).alias("media"), F.max(c).alias("maximo"),
                  F.min(c).alias("minimo"), F.stddev_samp(c).alias("desviacion"))
    med = quantiles(df, col, [0.5], ["mediana"], median_method)
    return with_scalars(base, med).select("n", "media", "mediana", "maximo", "minimo", "desviacion")


def profile(df: DataFrame, col: str) -> DataFrame:
    """Min, max and distinct count of a generated column."""
    return df.agg(F.min(col).alias("minimo"), F.max(col).alias("maximo"),
                  F.countDistinct(col).alias("distintos"))
