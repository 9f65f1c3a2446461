"""Fixed-size sampling without replacement (T5) by hash order.

The sample is ``orderBy(hash).limit(n)``: Spark plans it as a top-k
(``TakeOrderedAndProject``: each partition keeps its n best, the driver
merges partition winners), deterministic for any partitioning. The
complement is an anti join on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAL_MAX, CAL_SHARE = 5000, 0.15


def hash_order(id_col: str, seed: int = 42) -> Column:
    """md5 of ``id#seed``: a text hash another engine can recompute."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))


def sample_size(n_rows: int, share: float = CAL_SHARE, cap: int = CAL_MAX) -> int:
    """min(cap, floor(share * n)); an error when that is 0, since nothing could be calibrated."""
    k = min(cap, int(n_rows * share))
    if k < 1:
        raise ValueError(f"{n_rows} rows are too few for a sample of share {share}")
    return k


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """T5: the n rows with the smallest hash."""
    return df.orderBy(hash_order(id_col, seed), F.col(id_col)).limit(n)


def split_sample(df: DataFrame, id_col: str, share: float = CAL_SHARE, cap: int = CAL_MAX,
                 seed: int = 42, hold=lambda sample: sample) -> tuple[DataFrame, DataFrame]:
    """T5 as used for calibration: (sample, rest). ``hold`` gets the sample, which each use of the rest reads too."""
    n = sample_size(df.count(), share, cap)
    sample = hold(hash_sample(df, id_col, n, seed))
    rest = df.join(sample.select(id_col), id_col, "left_anti")
    return sample, rest
