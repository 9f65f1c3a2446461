"""Reading tasks grow with the archives."""

from pyspark.sql import functions as F

from staylens.llm import warc
from staylens.llm.common import scratch


def test_reading_tasks_grow_with_the_archives(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://e.example/"), "id").alias("url"),
                                    F.concat_ws(" ", F.sha2(F.col("id").cast("string").cast("binary"), 512), "id").alias("html")).repartition(3)
    folder = scratch(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, archive_bytes=2000)
    archives, tasks = manifest.count(), spark.sparkContext.defaultParallelism
    assert archives > 2 * tasks
    rows = warc.read_archives(manifest, folder)
    assert rows.rdd.getNumPartitions() == tasks and rows.count() == 400
    before, warc.READ_BYTES = warc.READ_BYTES, 1
    try:
        wide = warc.read_archives(manifest, folder)
    finally:
        warc.READ_BYTES = before
    assert wide.rdd.getNumPartitions() == archives and wide.select("page_id").distinct().count() == 400


def test_no_archive(spark):
    folder = scratch(spark, "warc-none")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, folder), folder).collect() == []
