"""What the usage log says about items: priors, affinities, boosts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from lorewell.functions import scores

EVENT = "query_id string, collection string, terms array<string>, impressions array<string>, used array<string>, at timestamp"
PER_TERM = 32


def priors(events: DataFrame) -> DataFrame:
    """(collection, item, shown, used, prior).  An empty collection is "default"."""
    where = F.when(F.coalesce("collection", F.lit("")) == "", "default").otherwise(F.col("collection")).alias("collection")
    shown = events.select(where, F.explode("impressions").alias("item"), F.lit(1).alias("shown"), F.lit(0).alias("used"))
    used = events.select(where, F.explode("used").alias("item"), F.lit(0).alias("shown"), F.lit(1).alias("used"))
    both = shown.unionByName(used).groupBy("collection", "item").agg(F.sum("shown").alias("shown"), F.sum("used").alias("used"))
    return both.withColumn("prior", F.round(scores.prior(F.col("used"), F.col("shown")), 6))


def affinities(events: DataFrame, per_term: int = PER_TERM) -> DataFrame:
    """(collection, term, item, weight): uses under each term, the ``per_term`` heaviest items of a term, ties by item."""
    where = F.when(F.coalesce("collection", F.lit("")) == "", "default").otherwise(F.col("collection")).alias("collection")
    each = events.select(where, F.explode("terms").alias("term"), "used").select("collection", "term", F.explode("used").alias("item"))
    counted = each.groupBy("collection", "term", "item").agg(F.count("*").cast("double").alias("weight"))
    rank = F.row_number().over(W.partitionBy("collection", "term").orderBy(F.desc("weight"), "item"))
    return counted.withColumn("__r", rank).where(F.col("__r") <= per_term).drop("__r")


def decayed_affinities(events: DataFrame, now: str, half_life_seconds: float) -> DataFrame:
    """Like ``affinities``, each use worth less with its age."""
    age = F.greatest(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("at"), F.lit(0))
    each = events.select("collection", F.explode("terms").alias("term"), "used", F.exp(-math.log(2.0) * age / half_life_seconds).alias("w"))
    return each.select("collection", "term", F.explode("used").alias("item"), "w").groupBy("collection", "term", "item").agg(F.sum("w").alias("weight"))


def affinity(table: DataFrame, terms: list[str]) -> DataFrame:
    """(item, affinity) for a query; repeated terms count repeatedly."""
    asked = table.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return table.join(F.broadcast(asked), "term").groupBy("item").agg(F.sum("weight").alias("affinity"))


def boosted(results: DataFrame, prior_table: DataFrame, affinity_table: DataFrame, enabled: bool = True) -> DataFrame:
    """``results`` (item, score) with ``boost``, at most half of the score; 0 if disabled or unknown."""
    joined = results.join(prior_table.select("item", "prior"), "item", "left").join(affinity_table.select("item", "affinity"), "item", "left")
    b = scores.boost(F.coalesce("prior", F.lit(0.0)), F.coalesce("affinity", F.lit(0.0)), F.col("score")) if enabled else F.lit(0.0)
    return joined.withColumn("boost", F.round(b, 6))


def purge(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("item").distinct(), "item", "left_anti")


def stats(events: DataFrame) -> DataFrame:
    """One row: events, items with a prior, term and item pairs."""
    a = events.agg(F.count("*").alias("events"))
    b = priors(events).agg(F.count("*").alias("items"))
    c = affinities(events).agg(F.count("*").alias("term_items"))
    return a.crossJoin(b).crossJoin(c)
