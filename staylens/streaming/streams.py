"""Drop-folder feeds as Structured Streaming queries (S5 and the §2.13 re-aim
of both CSV feeds).

Files arriving in a folder are read by the file source with a fixed
all-text schema; every micro-batch runs the same batch transform in
``foreachBatch`` and appends to the keyed table, whose uniqueness is checked
against the *whole* stored table (W2 + J4), so replays and late files are
harmless. Exactly-once progress comes from the checkpoint location, which
must be on shared storage; processed inputs may optionally be deleted by
the source (``cleanSource``).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest as I
from ..operators import keyed as K
from ..operators import scoring as SC


DAY_COL = "dia"   # storage partition: day of the key timestamp


def text_stream(spark: SparkSession, folder: str, columns: Sequence[str], sep: str = ",",
                clean_source: str | None = None, quoted_newlines: bool = False) -> DataFrame:
    """Streaming CSV scan with every column as STRING (headers already known); files
    are split among tasks unless fields may hold line ends."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = (spark.readStream.schema(schema).option("header", True).option("sep", sep)
         .option("multiLine", quoted_newlines))
    if clean_source:
        r = r.option("cleanSource", clean_source)
    return (r.csv(folder)
            .withColumn("_file_name", F.col("_metadata.file_name"))
            .withColumn("_file_time", F.col("_metadata.file_modification_time")))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Process everything available now, batch by batch, then stop."""
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stays_handler(table_path: str, reports: list | None = None):
    """foreachBatch body: normalise stays, insert keys not yet stored, report."""
    order = ["_file_time", "_file_name", "_scan_id"]

    def handle(batch: DataFrame, epoch: int) -> None:
        # position inside the micro-batch scan (taken before any shuffle)
        batch = batch.withColumn("_scan_id", F.monotonically_increasing_id())
        stays = I.normalize_stays(batch)          # scan-order columns are carried through
        stays = stays.withColumn(DAY_COL, F.to_date("marca_temporal"))
        rep = K.append_new(stays, table_path, I.STAY_KEY, order, drop_cols=order, partition_by=[DAY_COL])
        if reports is not None:
            reports.append({"epoch": epoch, **rep})
    return handle


def scoring_handler(model, out_path: str, keep: Sequence[str] = (),
                    *, reference_medians: dict):
    """foreachBatch body for the scoring drop folder (S5 -> M20 -> S8).

    The medians are required: a score must not depend on which files share a
    micro-batch. Each epoch overwrites its own partition (``epoca``), so a
    replayed epoch adds no rows."""
    def handle(batch: DataFrame, epoch: int) -> None:
        scored = SC.score_new_patients(model, batch, keep, reference_medians)
        (scored.withColumns({"created_at": F.current_timestamp(), "epoca": F.lit(epoch).cast("long")}).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoca").parquet(out_path))
    return handle


def census_handler(table_path: str, reports: list | None = None):
    """foreachBatch body for the bed-census drop folder: normalise (synonyms,
    snapshot time incl. file-name fallback), then insert-if-absent on the
    census key chosen from the headers."""
    order = ["_file_time", "_file_name", "_scan_id"]

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("_scan_id", F.monotonically_increasing_id())
        rows, key = I.normalize_census(batch)
        rows = rows.withColumn(DAY_COL, F.to_date("snapshot_at"))
        rep = K.append_new(rows, table_path, key, order, drop_cols=order, partition_by=[DAY_COL])
        if reports is not None:
            reports.append({"epoch": epoch, **rep})
    return handle
