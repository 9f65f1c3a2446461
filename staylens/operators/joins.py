"""Join helpers: suffixing left join (J1) and one-row scalar attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_suffixed(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                       suffix: str = "_score") -> DataFrame:
    """Left equi-join on differently named keys; right-side names that
    clash with the left get ``suffix``. Duplicate right keys multiply rows.

    Keys of different types are compared as text. Strategy (sort-merge or
    broadcast) is chosen by the optimizer/AQE from measured sizes; AQE's
    skew-join splits a hot left key across tasks.
    """
    same_key = left_on == right_on
    renames = {c: (c + suffix if c in left.columns and c != right_on else c) for c in right.columns}
    if same_key:
        renames[right_on] = "_rk_" + right_on
    r = right.select(*[F.col(c).alias(n) for c, n in renames.items()])
    rk = renames[right_on]
    lk, rkc = left[left_on], r[rk]
    if dict(left.dtypes)[left_on] != dict(r.dtypes)[rk]:
        lk, rkc = lk.cast("string"), rkc.cast("string")
    out = left.join(r, lk == rkc, "left")
    return out.drop(rk) if same_key else out


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The aggregate becomes one scalar subquery (a struct of all its columns):
    Spark runs it once and substitutes the value, so no join of any kind is
    planned and nothing but the scalar values moves.
    """
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("_s")).scalar()
    out = df.withColumn("_scalars", packed)
    return out.select(*[F.col(c) for c in df.columns],
                      *[F.col("_scalars")[c].alias(c) for c in names])
