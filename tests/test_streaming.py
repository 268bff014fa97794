from pyspark.sql import functions as F

from lorewell.plans.analytics import search_log, usage_log
from lorewell.operators import metrics, usage
from lorewell.streaming import feeds

DIR = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = feeds.event_time(search_log(feeds.read_folder(spark, str(tmp_path / "in"), events.schema, 10)))
    feeds.run_once(feeds.search_metrics(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    log = feeds.event_time(search_log(events)).withColumn("mode", metrics.mode_of(F.col("mode")))
    want = log.groupBy(F.window("ts", "1 day").alias("w"), "collection", "mode").agg(*metrics._sums()).select(F.col("w.start").alias("start"), "collection", "mode", "searches", "returned", "requested", "underfilled")
    closed = got.agg(F.max("start")).first()[0]  # the watermark keeps the last window open
    assert closed is not None
    assert sorted(got.collect()) == sorted(want.where(F.col("start") <= F.lit(closed)).collect())


def test_usage_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    log = usage_log(feeds.read_folder(spark, str(tmp_path / "in"), events.schema))
    q = feeds.usage_counts(log).writeStream.format("memory").queryName("usage_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("usage_counts").groupBy("item").agg(F.sum("shown").alias("shown"), F.sum("used").alias("used"))
    assert sorted(got.collect()) == sorted(usage.priors(usage_log(events)).select("item", "shown", "used").collect())


def test_latency_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    log = feeds.event_time(search_log(feeds.read_folder(spark, str(tmp_path / "in"), events.schema)))
    q = feeds.latency_histogram(log).writeStream.format("memory").queryName("latencies").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("latencies").groupBy("mode", "bucket").agg(F.sum("searches").alias("searches"))
    assert sorted(got.collect()) == sorted(metrics.latency_histogram(search_log(events)).collect())


def test_events_that_come_twice_count_once(spark, tmp_path):
    rows = [("q1", "2024-01-01 00:00:00"), ("q2", "2024-01-01 00:10:00"), ("q1", "2024-01-01 00:20:00"), ("q2", "2024-01-01 00:10:00")]
    table = spark.createDataFrame(rows, "query_id string, at string").select("query_id", F.col("at").cast("timestamp").alias("at"))
    table.write.parquet(str(tmp_path / "in"))
    stream = feeds.distinct_events(feeds.read_folder(spark, str(tmp_path / "in"), table.schema))
    feeds.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.query_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["q1", "q2"]
