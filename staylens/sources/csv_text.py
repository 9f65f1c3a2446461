"""CSV sources (S1, S2, S6) and table sinks.

S1 reads every column as text. Encoding, separator and header line are found
per file in one distributed pass over the lines; the rows are then read by
Spark's CSV parser with a fixed all-STRING schema, in parallel (files are split,
quoted line ends or not), with the file name / modification time
and a scan-order id kept for first-wins de-duplication (W2).
"""

from __future__ import annotations

import codecs
from typing import Callable, NamedTuple, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import headers as H
from ..operators.keyed import read_if_exists
from .csv_records import quoted_records

SEPARATORS = [";", ",", "\t", "|"]


class Layout(NamedTuple):
    """How the files of one header layout are read."""

    encoding: str
    sep: str
    names: tuple[str, ...]


def layouts(spark: SparkSession, path, sep: str | None = None, encoding: str | None = None) -> dict[Layout, list[str]]:
    """Layout -> its files. One distributed pass over the lines finds each file's
    first line and whether all of it is UTF-8 (else ISO-8859-1); the driver gets
    one row per file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("id"))
    files = lines.groupBy("file").agg(F.min_by(F.col("value").cast("binary"), F.struct("block", "id")).alias("first"),
                                      F.min(F.is_valid_utf8("value")).alias("utf8"))
    out: dict[Layout, list[str]] = {}
    for r in sorted(files.collect(), key=lambda r: r["file"]):
        enc = encoding or ("UTF-8" if r["utf8"] else "ISO-8859-1")
        line = bytes(r["first"]).removeprefix(codecs.BOM_UTF8).decode(enc, "replace")
        s = sep or (max(SEPARATORS, key=line.count) if line else ",")
        out.setdefault(Layout(enc, s, tuple(n.strip().strip('"') for n in line.split(s))), []).append(unquote(r["file"]))
    return out


def _names(raw_names: Sequence[str], rename: Callable[[str], str]) -> list[str]:
    names, seen = [], {}
    for n in raw_names:
        base = rename(n) or "col"
        k = seen.get(base, 0)
        seen[base] = k + 1
        names.append(base if k == 0 else f"{base}_{k}")
    return names


def _scan(spark: SparkSession, layout: Layout, files: list[str], names: list[str], quoted_newlines: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_line"]])
    options = {"sep": layout.sep, "escape": "\"", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}    # quotes are doubled
    if quoted_newlines:
        found = quoted_records(spark, files).where(F.octet_length("record") > 0)
        text = F.regexp_replace(F.regexp_replace(F.decode("record", layout.encoding), "\r$", ""), "^\uFEFF", "")
        # a file's first record is its header
        rows = found.where((F.col("block") > 0) | (F.col("line") > 0)).where(F.length(text) > 0)
        parsed = rows.select(F.from_csv(text, _ddl(schema), {**options, "multiLine": "true"}).alias("_row"),
                             F.col("name").alias("_file_name"), F.col("time").alias("_file_time"), (F.col("block") + F.col("line")).alias("_scan_id"))
        return parsed.select("_row.*", "_file_name", "_file_time", "_scan_id")
    reader = spark.read.schema(schema).option("header", True).option("encoding", layout.encoding)
    return (reader.options(**options).option("columnPruning", False)          # a pruned parse loses the record of a mismatched row
            .csv(files)
            .select("*", F.col("_metadata.file_name").alias("_file_name"),
                    F.col("_metadata.file_modification_time").alias("_file_time"),
                    F.monotonically_increasing_id().alias("_scan_id")))


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema)


def _overlong(layout: Layout, names: list[str]):
    """Rows with more fields than the header: ``_line`` (the record, kept when its
    fields don't match) has as many separators outside quotes as there are names."""
    bare = F.regexp_replace("_line", r'"([^"]|"")*"', "")
    return F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(layout.sep), F.lit(""))) >= len(names), F.lit(False))


def read_text_csv(spark: SparkSession, path, rename: Callable[[str], str] = H.slug, sep: str | None = None,
                  encoding: str | None = None, quoted_newlines: bool = False, rejects: bool = False):
    """All-text scan with slugged headers plus ``_file_name``, ``_file_time``
    and ``_scan_id`` (order inside the scan).

    Encoding, separator and header are resolved per file; files of one layout are
    read together and the layouts united by column name (absent columns are NULL).
    Files are split among tasks, also where ``quoted_newlines`` says that fields may
    hold line ends (:mod:`csv_records`). Rows with more fields than their header aren't guessed at:
    with ``rejects`` they come back as a second DataFrame (``_line``,
    ``_file_name``); without it such a row fails the query with its text."""
    rows = bad = None
    for layout, files in layouts(spark, path, sep, encoding).items():
        names = _names(layout.names, rename)
        df = _scan(spark, layout, files, names, quoted_newlines)
        long = _overlong(layout, names)
        if rejects:
            # a scan must not ask for the record alone, hence the first field (never used: _line is set)
            over = df.where(long).select(F.coalesce("_line", names[0]).alias("_line"), "_file_name")
            bad = over if bad is None else bad.unionByName(over)
            df = df.where(~long).drop("_line")
        else:
            check = F.when(long, F.raise_error(F.concat(F.lit("more fields than the header: "), F.col("_line"))).cast("string")).otherwise(F.col(names[0]))
            df = df.withColumn(names[0], check).drop("_line")
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    if rows is None:
        raise FileNotFoundError(f"no CSV file under {path}")
    return (rows, bad) if rejects else rows


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, rejects: bool = False):
    """CSV with standardised (P2) header names, typed by ``schema`` when given.

    The columns are those of the header, so a schema of another length is an error;
    a value that isn't of its type is NULL. Rows with more fields than the header are
    treated as by :func:`read_text_csv`."""
    found = layouts(spark, path)
    if len(found) != 1:
        raise ValueError(f"{path}: {len(found)} header layouts, one expected")
    names = next(iter(found)).names
    if schema is not None and len(schema) != len(names):
        raise ValueError(f"{path}: {len(names)} columns, {len(schema)} in the schema")
    read = read_text_csv(spark, path, H.standardize, rejects=rejects)
    rows, bad = read if rejects else (read, None)
    kinds = [(f.name, f.dataType) for f in schema] if schema is not None else [(n, T.StringType()) for n in _names(names, H.standardize)]
    typed = rows.select(*[F.col(old).try_cast(kind).alias(new) for old, (new, kind) in zip(rows.columns, kinds)])
    return (typed, bad) if rejects else typed


def first_wins_order() -> list:
    """W2 ordering of a scanned batch: file time, file name, position in the scan."""
    return ["_file_time", "_file_name", "_scan_id"]


# --- sinks ------------------------------------------------------------------
def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] | None = None) -> None:
    """Overwrite (or append) a result table."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_history(df: DataFrame, path: str, stamp_col: str | None = "created_at",
                   partition_by: Sequence[str] | None = None) -> int:
    """Append scored rows with a UTC audit stamp; the stored schema
    may grow (readers use ``mergeSchema``). Returns the rows stored before."""
    stored = read_if_exists(df.sparkSession, path)
    before = 0 if stored is None else stored.count()
    if stamp_col:
        df = df.withColumn(stamp_col, F.current_timestamp())
    write_table(df, path, mode="append", partition_by=partition_by)
    return before


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Read an appended history with all column versions merged (U1 semantics)."""
    return spark.read.option("mergeSchema", True).parquet(path)


def append_run(df: DataFrame, path: str, run_stamp: str, col: str = "fecha_prediccion") -> None:
    """Time-stamped run output, one partition per run."""
    write_table(df.withColumn(col, F.lit(run_stamp)), path, mode="append", partition_by=[col])


def latest_runs(spark: SparkSession, path: str, n: int = 5, col: str = "fecha_prediccion") -> DataFrame:
    """The newest ``n`` runs (distinct partition values; no data column is read)."""
    return spark.read.parquet(path).select(col).distinct().orderBy(F.col(col).desc()).limit(n)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row metrics document as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_bucketed_table(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int,
                         mode: str = "overwrite") -> DataFrame:
    """Store a keyed table bucketed and sorted by ``keys`` (external table at
    ``path``). Per-key aggregates (A1, A2, W2) and joins on the key against
    another table bucketed the same way then need no shuffle."""
    (df.write.mode(mode).format("parquet").option("path", path)
       .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)
