"""The usage and search logs as streams.

Event times must be TIMESTAMP (a watermark takes no TIMESTAMP_NTZ); ``event_time``
casts under the session's zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.operators import metrics


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def read_folder(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def search_metrics(log: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(start, collection, mode, searches, returned, requested, underfilled) by tumbling window; rows later than ``late`` are dropped."""
    rows = log.withColumn("mode", metrics.mode_of(F.col("mode"))).withWatermark(time, late)
    out = rows.groupBy(F.window(time, window).alias("w"), "collection", "mode").agg(*metrics._sums())
    return out.select(F.col("w.start").alias("start"), "collection", "mode", "searches", "returned", "requested", "underfilled")


def latency_histogram(log: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    rows = log.where("latency_ms is not null").withWatermark(time, late)
    out = rows.groupBy(F.window(time, window).alias("w"), metrics.mode_of(F.col("mode")).alias("mode"), metrics.latency_bucket(F.col("latency_ms")).alias("bucket")).agg(F.count("*").alias("searches"))
    return out.select(F.col("w.start").alias("start"), "mode", "bucket", "searches")


def usage_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = "at") -> DataFrame:
    """(start, collection, item, shown, used) by window; sums over windows give what ``operators.usage.priors`` counts."""
    rows = events.withWatermark(time, late)
    shown = F.transform(F.coalesce("impressions", F.array().cast("array<string>")), lambda i: F.struct(i.alias("item"), F.lit(1).alias("shown"), F.lit(0).alias("used")))
    used = F.transform(F.coalesce("used", F.array().cast("array<string>")), lambda i: F.struct(i.alias("item"), F.lit(0).alias("shown"), F.lit(1).alias("used")))
    each = rows.select(time, F.coalesce(F.nullif("collection", F.lit("")), F.lit("default")).alias("collection"), F.explode(F.concat(shown, used)).alias("e"))
    out = each.groupBy(F.window(time, window).alias("w"), "collection", F.col("e.item").alias("item")).agg(F.sum("e.shown").alias("shown"), F.sum("e.used").alias("used"))
    return out.select(F.col("w.start").alias("start"), "collection", "item", "shown", "used")


def distinct_events(events: DataFrame, key: str = "query_id", late: str = "1 hour", time: str = "at") -> DataFrame:
    """Events that are delivered more than once count once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, then stop; the next call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
