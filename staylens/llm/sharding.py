"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` virtual slots; bytes and rows are
aggregated per slot; a small versioned table maps slots to shards. Version 1
deals the slots out in turn, a rebalancing edits the map (slots move, records
are never re-hashed) and stores the result as the next version.

Only the slot aggregate (at most ``SLOTS`` rows, whatever the input) reaches
the driver; the rows keep to DataFrame expressions.

Edge cases: a null text has no bytes (size 1), a null doc_id hashes like an
empty one, repeated rows are hashed with their number (so they spread over the
slots too), an empty table gives an empty result and a map without bytes. Extra
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch

SLOTS = 8192
SHARDS = 8
#: Repeated rows that one task writes out at a time.
RUN = 65_536


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and virtual slot of every row.

    The slot hashes doc_id and text together, so a doc_id that holds a large
    share of the rows is still spread over the slots. Equal rows are counted
    (map-side first) and written out again in runs of ``RUN`` that are dealt to
    tasks on their own; all but the first are hashed with their number."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32"]
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))
    runs = out.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).withColumn("run", first).repartition(*same, "run")
    out = runs.withColumn("copy", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("copies")) - 1)))
    number = F.when(F.col("copy") > 0, F.col("copy").cast("string"))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), number)
    return out.select(*same, (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % slots).alias("virtual_slot"))


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot (combined map-side)."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(current: list[int], totals: dict[int, int], shards: int) -> list[int]:
    """Edit a slot map so that shards hold nearly equal bytes.

    Slots are visited from the largest to the smallest (ties by number). A slot
    stays on its shard while that shard has room below the mean; otherwise it
    moves to the shard with the fewest bytes so far. A shard number at or above
    ``shards`` (a removed shard) always gives its slots away. Slots without
    bytes stay where they are."""
    total = sum(totals.values())
    load, out = [0] * shards, [s if s < shards else s % shards for s in current]
    for slot, size in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        home = current[slot]
        if home >= shards or (load[home] + size) * shards > total:
            home = min(range(shards), key=lambda k: (load[k], k))
        load[home] += size
        out[slot] = home
    return out


def store_map(spark: SparkSession, path: str, version: int, slot_map: list[int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Write one version of the map (virtual_slot, shard, bytes, n, first) and
    read it back; ``first`` is the position of the slot's first row in its shard."""
    place: dict[int, int] = {}
    rows = []
    for slot, shard in enumerate(slot_map):
        size, n = totals.get(slot, (0, 0))
        rows.append((slot, shard, size, n, place.get(shard, 0)))
        place[shard] = place.get(shard, 0) + n
    schema = "virtual_slot long, shard int, bytes long, n long, first long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/version={version}")
    return spark.read.schema(schema).parquet(f"{path}/version={version}")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Assign every document to a shard of nearly equal bytes.

    Returns doc_id, size, text_crc32, virtual_slot, shard and slot, the row's
    place in its shard (gapless from 0: slot by slot, then by doc_id)."""
    spark = docs.sparkSession
    path = path or scratch(spark, "slot-map")
    rows = records(docs, slots)
    totals = {r[0]: (r[1], r[2]) for r in slot_totals(rows).collect()}     # at most `slots` rows
    version1 = first_map(slots, shards)
    store_map(spark, path, 1, version1, totals)
    version2 = rebalance(version1, {s: t[0] for s, t in totals.items()}, shards)
    slot_map = store_map(spark, path, 2, version2, totals).select("virtual_slot", "shard", "first")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return (placed.join(F.broadcast(slot_map), "virtual_slot")               # `slots` rows, a constant
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("place")).alias("slot")))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


QUERIES = {"op5_virtual_slots": op5_virtual_slots}
_CRC_TABLE = "(SELECT list(c ORDER BY b) FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b)))"
ORACLE = {"op5_virtual_slots": f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
texts AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM texts),
slotted AS MATERIALIZED (
  SELECT doc_id, size, text_crc32,
    ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text_crc32::VARCHAR, CASE WHEN copy > 0 THEN copy::VARCHAR END)), 1, 8))::BIGINT % {SLOTS} AS virtual_slot
  FROM numbered),
totals AS MATERIALIZED (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n FROM slotted GROUP BY 1),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k, (SELECT sum(size) FROM slotted) AS total FROM totals),
fold AS (
  SELECT 0::BIGINT AS k, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS load, -1::BIGINT AS virtual_slot, -1::BIGINT AS shard
  UNION ALL
  SELECT k, list_transform(load, lambda x, i: CASE WHEN i = goes + 1 THEN x + bytes ELSE x END), virtual_slot, goes
  FROM (SELECT r.k, f.load, r.bytes, r.virtual_slot,
          CASE WHEN (f.load[r.virtual_slot % {SHARDS} + 1] + r.bytes) * {SHARDS} > r.total THEN list_position(f.load, list_min(f.load)) - 1
               ELSE r.virtual_slot % {SHARDS} END::BIGINT AS goes
        FROM fold f JOIN ranked r ON r.k = f.k + 1)),
firsts AS MATERIALIZED (
  SELECT f.virtual_slot, f.shard, coalesce(sum(t.n) OVER (PARTITION BY f.shard ORDER BY f.virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM fold f JOIN totals t USING (virtual_slot))
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32, 'bytes' AS law, f.shard::INTEGER AS shard,
  (f.first + row_number() OVER (PARTITION BY s.virtual_slot ORDER BY s.doc_id NULLS FIRST, s.text_crc32, s.size) - 1)::BIGINT AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, s.virtual_slot
FROM slotted s JOIN firsts f USING (virtual_slot)"""}
