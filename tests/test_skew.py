"""A key holding a third of all rows: results stay exact and the ordered
helpers spread that key over several partitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from staylens.operators import keyed as K
from staylens.operators import ranking as RK
from staylens.operators import summaries as S
from staylens.operators.stats import quantiles

SF = "/root/testdata/sf0.01"


def skewed_events(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    # every third event is re-assigned to user 0: one key holds a third of the table
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_hot_key_is_split_by_range_partitioning(spark):
    ev = skewed_events(spark)
    ranged = RK._ranged(ev.select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], 8)
    parts = ranged.where(F.col("user_id") == 0).select("_pid").distinct().count()
    assert parts >= 2


def test_positions_exact_under_skew(spark):
    ev = skewed_events(spark)
    mine = RK.position_in_key(ev.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "pos", 8)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ref = ev.select("event_id", (F.row_number().over(w) - 1).alias("pos"))
    assert mine.select("event_id", "pos").exceptAll(ref).count() == 0
    assert mine.where(F.col("user_id") == 0).agg(F.max("pos")).first()[0] == \
        ev.where(F.col("user_id") == 0).count() - 1


def test_latest_and_first_exact_under_skew(spark):
    ev = skewed_events(spark)
    latest = S.latest_per_key(ev, ["user_id"], ["ts", "event_id"], ["event_id"])
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    ref = ev.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id")
    assert latest.exceptAll(ref).count() == 0 and latest.count() == ref.count()
    first = K.first_per_key(ev, ["user_id"], ["ts", "event_id"], ["event_id"])
    w2 = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ref2 = ev.withColumn("rn", F.row_number().over(w2)).where("rn = 1").select("user_id", "event_id")
    assert first.exceptAll(ref2).count() == 0


def test_hot_value_is_one_row_of_the_quantile(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("v"))
    got = quantiles(df, "v", [0.0, 0.5, 0.9, 1.0], ["a", "b", "c", "d"], "rank").first()
    want = df.agg(*[F.percentile("v", p) for p in (0.0, 0.5, 0.9, 1.0)]).first()
    assert list(got) == list(want)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5), (None, 3)], "k string, v int")
    got = {(r["k"], r["v"]): r["pos"] for r in RK.position_in_key(df, ["k"], ["v"], "pos").collect()}
    day = df.withColumn("d", F.timestamp_seconds(F.col("v") * 50_000).cast("timestamp_ntz"))
    sliced = {(r["k"], r["v"]): r["pos"] for r in RK.position_in_key(day, ["k"], ["d"], "pos").collect()}
    assert got == sliced == {(None, 1): 0, (None, 2): 1, (None, 3): 2, ("a", 5): 0}
