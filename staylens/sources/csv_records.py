"""CSV records whose fields hold line ends, read by many tasks.

Whether a line end lies inside quotes depends on the number of quotes before it in
the file, so a split can't tell alone. A first pass counts each split's quotes; the
driver folds one bit per split into the state in which every split starts. In the
second pass a split cuts its lines into records; a record that crosses a border comes
out in pieces, at most two a split, which are put together afterwards. The text is
never shuffled but for these pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, START, MIDDLE, END = 0, 1, 2, 3
_SCHEMA = "file string, name string, time timestamp, block long, line long, kind int, record binary"


def quoted_records(spark: SparkSession, files) -> DataFrame:
    """(file, name, time, block, line, record): the records of ``files`` as bytes, without
    their line end. ``block`` + ``line`` grows along a file. Quotes inside a field are
    doubled; a record left open at the end of its file runs to that end."""
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_name", "name"), ("file_modification_time", "time"), ("file_block_start", "block"))]
    lines = spark.read.option("lineSep", "\n").text(files).select(F.col("value").cast("binary").alias("value"), *meta)
    quotes = F.length(F.regexp_replace(F.decode("value", "ISO-8859-1"), '[^"]', ""))
    splits = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).cast("int").alias("odd")).collect()
    starts, last, odd = [], None, 0
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        odd = odd if r["file"] == last else 0
        starts.append((r["file"], r["block"], odd))
        last, odd = r["file"], odd ^ r["odd"]
    states = spark.createDataFrame(starts, "of string, at long, inside int")
    # one row per split
    known = lines.join(F.broadcast(states), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    pieces = known.select("value", "file", "name", "time", "block", "inside").mapInArrow(_cut, _SCHEMA)
    return pieces.where(F.col("kind") == WHOLE).drop("kind").unionByName(_joined(pieces.where(F.col("kind") != WHOLE)))


def _cut(batches):
    import pyarrow as pa

    state = None                                                        # of the split being read
    out = []

    def flush(kind):
        of, first, held = state["of"], state["first"], state["held"]
        out.append((*of, first, kind, b"\n".join(held)))
        state["held"] = []

    def close():
        """The split is over: what is open goes on in the next one."""
        if state and state["held"]:
            flush(MIDDLE if state["head"] else START)

    def batch():
        rows, kinds = list(zip(*out)), [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    for b in batches:
        for value, *of, inside in zip(*(c.to_pylist() for c in b.columns)):
            if state is None or state["of"] != of:
                close()
                state = {"of": of, "line": 0, "first": 0, "open": bool(inside), "head": bool(inside), "held": []}
            if not state["held"]:
                state["first"] = state["line"]
            state["held"].append(value)
            state["line"] += 1
            if value.count(b'"') % 2:
                state["open"] = not state["open"]
            if not state["open"]:
                flush(END if state["head"] else WHOLE)
                state["head"] = False
        if len(out) >= 1000:
            yield batch()
            out = []
    close()
    if out:
        yield batch()


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of records that cross splits, put together: a start and all that follows up to the next one."""
    along = Window.partitionBy("file").orderBy("block", "line")
    run = F.count(F.when(F.col("kind") == START, 1)).over(along)
    runs = pieces.withColumn("run", run).groupBy("file", "name", "time", "run").agg(
        F.min(F.struct("block", "line")).alias("first"), F.sort_array(F.collect_list(F.struct("block", "line", "record"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["record"])), "0A")
    return runs.select("file", "name", "time", "first.block", "first.line", F.unhex(text).alias("record"))
