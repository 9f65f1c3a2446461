"""Session construction and cluster-wide settings.

Everything here is configuration: the engine itself is Spark SQL. The
settings aim at large clusters (AQE re-plans joins and partition counts
from measured shuffle sizes, skew-join splitting is on) and are sized down
only through environment variables for local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "staylens",
                  shuffle_partitions: int | None = None, extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    Cluster sizing comes from the environment: ``STAYLENS_SHUFFLE_PARTITIONS``
    (initial shuffle width; AQE coalesces it down to
    ``STAYLENS_ADVISORY_PARTITION`` sized partitions) and
    ``STAYLENS_MAX_PARTITION_BYTES`` (scan split size).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or int(os.environ.get("STAYLENS_SHUFFLE_PARTITIONS", "8"))
    conf = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes":
            os.environ.get("STAYLENS_ADVISORY_PARTITION", "128MB"),
        "spark.sql.files.maxPartitionBytes": os.environ.get("STAYLENS_MAX_PARTITION_BYTES", "128MB"),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Broadcasts are decided only at run time from measured shuffle
        # output (AQE); file-size estimates never trigger one. Above the
        # threshold the join stays sort-merge (with skew splitting).
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # Rank helpers checkpoint to the shared folder; drop files once unreferenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("STAYLENS_DRIVER_MEMORY", "8g"),
    }
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:        # Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when nothing is
    configured (local tests) a private scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:        # Spark Connect: the server's own configuration applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    local = tempfile.mkdtemp(prefix="staylens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """Scan one of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the parquet tables as temporary views for ``spark.sql``."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def numeric_values_table(spark: SparkSession, rows, columns) -> "DataFrame":
    """A small numeric table built as SQL ``VALUES`` on the JVM (no Python
    workers, no serialised driver data). ``columns`` = [(name, sql_type)]."""
    if not rows:
        cols = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in columns)
        return spark.sql(f"SELECT {cols} WHERE false")
    # doubles as text: infinities have no literal
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{float(v)!r}'" if t == "DOUBLE" else str(int(v))
                                       for v, (_, t) in zip(r, columns)) + ")" for r in rows)
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    cast = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(columns))
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({names})")


def label_table(spark: SparkSession, name: str, labels) -> "DataFrame":
    """A small label dimension (value + ordinal) from literals on the JVM."""
    from pyspark.sql import functions as F
    idx = (F.col("id") + 1).cast("int")
    arr = F.array(*[F.lit(v) for v in labels])
    return spark.range(len(labels)).select(F.element_at(arr, idx).alias(name), F.col("id").cast("int").alias("_ord"))
