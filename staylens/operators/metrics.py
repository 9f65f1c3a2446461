"""Evaluation metrics as DataFrame plans.

Scores are first reduced to one row per distinct score (positives,
negatives) by a hash aggregate; cumulative counts in score order then come
from :func:`ranking.running_totals` (range partitioning + per-partition
offsets), never from an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import with_scalars
from .ranking import running_totals

CAL_BINS = 10


def score_table(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """Counts per distinct score with inclusive running sums in ascending
    score order, plus the class totals on every row."""
    d = (df.where(F.col(p_col).isNotNull())
           .groupBy(F.col(p_col).alias("p"))
           .agg(F.sum(F.col(y_col).cast("double")).alias("pos"),
                F.sum(1.0 - F.col(y_col).cast("double")).alias("neg")))
    cum = running_totals(d, ["p"], ["pos", "neg"])
    totals = d.agg(F.sum("pos").alias("tot_pos"), F.sum("neg").alias("tot_neg"))
    return with_scalars(cum, totals)             # one-row aggregate -> scalar subquery


def roc_auc(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties."""
    t = score_table(df, y_col, p_col)
    below = F.col("cum_neg") - F.col("neg")
    return t.agg((F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))) /
                  (F.first("tot_pos") * F.first("tot_neg"))).alias("roc_auc"))


def _at_or_above(t: DataFrame) -> DataFrame:
    return (t.withColumn("tp", F.col("tot_pos") - F.col("cum_pos") + F.col("pos"))
             .withColumn("fp", F.col("tot_neg") - F.col("cum_neg") + F.col("neg")))


def average_precision(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """Step-wise average precision, sum of recall increments times precision."""
    t = _at_or_above(score_table(df, y_col, p_col))
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.agg(F.sum(F.col("pos") / F.col("tot_pos") * prec).alias("avg_precision"))


def ranking_metrics(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """M14 and M15 from one score table."""
    t = _at_or_above(score_table(df, y_col, p_col))
    below = F.col("cum_neg") - F.col("neg")
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.agg((F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))) / (F.first("tot_pos") * F.first("tot_neg"))).alias("roc_auc"),
                 F.sum(F.col("pos") / F.col("tot_pos") * prec).alias("avg_precision"))


def brier(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """Mean squared difference between score and outcome."""
    return df.agg(F.avg(F.pow(F.col(p_col) - F.col(y_col).cast("double"), 2)).alias("brier"))


def roc_points(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    t = _at_or_above(score_table(df, y_col, p_col))
    return t.select(F.col("p").alias("threshold"), (F.col("fp") / F.col("tot_neg")).alias("fpr"),
                    (F.col("tp") / F.col("tot_pos")).alias("tpr"))


def pr_points(df: DataFrame, y_col: str, p_col: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    t = _at_or_above(score_table(df, y_col, p_col))
    return t.select(F.col("p").alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.col("tot_pos")).alias("recall"))


def calibration_curve(df: DataFrame, y_col: str, p_col: str, n_bins: int = CAL_BINS) -> DataFrame:
    """Uniform bins on [0, 1]; bin = number of inner edges strictly
    below the score; mean score and observed rate per non-empty bin."""
    p = F.col(p_col)
    b = F.lit(0)
    for i in range(1, n_bins):
        b = b + F.when(F.lit(i * (1.0 / n_bins)) < p, 1).otherwise(0)
    return (df.where(p.isNotNull()).withColumn("bin", b).groupBy("bin")
              .agg(F.avg(p).alias("prob_pred"), F.avg(F.col(y_col).cast("double")).alias("prob_true"),
                   F.count(F.lit(1)).alias("n")))
