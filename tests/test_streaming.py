from pyspark.sql import functions as F

from kilnwork.operators import limits
from kilnwork.streaming import events

SOURCE = "/root/testdata/sf0.001/events.parquet"


def folder(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet(SOURCE).orderBy("ts").coalesce(1).write.parquet(path)
    return path


def test_limit_is_the_batch_replay(spark, tmp_path):
    stream = events.limited(events.read(spark, folder(spark, tmp_path)), 3_600_000, 2)
    got = events.drain(stream, spark, "limited", str(tmp_path / "c"))
    batch = spark.read.parquet(SOURCE).withColumn("at", F.col("ts").cast("timestamp"))
    want = limits.admitted(batch, "user_id", F.unix_millis("at"), "event_id", 3_600_000, 2)
    key = lambda df: {(r.event_id, r.allowed) for r in df.collect()}
    assert key(got) == key(want) and got.count() > 0


def test_windows(spark, tmp_path):
    path = folder(spark, tmp_path)
    got = events.drain(events.tumbling(events.read(spark, path)), spark, "tumbled", str(tmp_path / "c"), "complete")
    n = spark.read.parquet(SOURCE).count()
    assert got.agg(F.sum("n")).first()[0] == n
    first = events.drain(events.first_of(events.read(spark, path), ["user_id"], "4000 days"), spark, "firsts", str(tmp_path / "d"))
    assert first.count() == spark.read.parquet(SOURCE).select("user_id").distinct().count()
    assert events.sessions(spark.read.parquet(SOURCE).withColumn("at", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == n
