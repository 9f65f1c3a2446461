"""Level dictionaries as tables (M7): dense codes of a column's values without
holding them on the driver. A level's code is its place among all sorted levels,
from the distributed global order; values are coded by a join whose table has
each level once, so AQE can split a frequent level. Unknown and NULL are -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_position

UNKNOWN_CODE = -1


def ordinal_levels(df: DataFrame, col: str) -> DataFrame:
    """(level, code) of the distinct non-NULL values of ``col`` as text, codes from 0 in sorted order."""
    levels = df.select(F.col(col).cast("string").alias("level")).where(F.col("level").isNotNull()).distinct()
    return global_position(levels, ["level"], "code").select("level", F.col("code").cast("long").alias("code"))


def ordinal_code(df: DataFrame, col: str, levels: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of ``col``; -1 for NULL and for values that aren't in ``levels``."""
    coded = levels.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    joined = df.join(coded, F.col(col).cast("string") == F.col("_level"), "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(UNKNOWN_CODE))).drop("_level", "_code")
