"""Search metrics: counts, fill rates, shares, latency, frequent terms.

A search log has (collection, mode, returned, requested, latency_ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorewell.operators.fulltext import token_stats

MODES = ("fts", "vector", "hybrid", "grep")
EDGES = (1, 5, 10, 25, 50, 100, 250, 500)


def mode_of(mode: Column) -> Column:
    """An unknown mode counts as hybrid."""
    return F.when(mode.isin(*MODES), mode).otherwise("hybrid")


def _sums() -> list[Column]:
    return [F.count("*").alias("searches"), F.sum("returned").cast("long").alias("returned"), F.sum("requested").cast("long").alias("requested"), F.count_if(F.col("returned") < F.col("requested")).alias("underfilled")]


def counts(log: DataFrame) -> DataFrame:
    return log.withColumn("mode", mode_of(F.col("mode"))).groupBy("collection", "mode").agg(*_sums())


def snapshot(log: DataFrame) -> DataFrame:
    """Counts and fill rate by collection and mode, by collection, and overall (null: all)."""
    out = log.withColumn("mode", mode_of(F.col("mode"))).rollup("collection", "mode").agg(*_sums())
    return out.withColumn("fill_rate", F.round(F.coalesce(F.try_divide(F.col("returned"), F.col("requested")), F.lit(0.0)), 6))


def fill_rate(log: DataFrame) -> DataFrame:
    return log.agg(F.round(F.coalesce(F.try_divide(F.sum("returned"), F.sum("requested")), F.lit(0.0)), 6).alias("fill_rate"))


def mode_share(log: DataFrame) -> DataFrame:
    """All four modes, 0 for one that never occurs."""
    have = log.select(mode_of(F.col("mode")).alias("mode")).groupBy("mode").agg(F.count("*").alias("searches"))
    dim = log.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    each = dim.join(have, "mode", "left").select("mode", F.coalesce("searches", F.lit(0)).alias("searches"))
    return each.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("searches"), F.sum("searches").over(W.partitionBy())), F.lit(0.0)), 6))


def latency_bucket(ms: Column) -> Column:
    """Label of the bucket; upper edges belong to it."""
    out = F.when(ms <= EDGES[0], f"<={EDGES[0]}")
    for e in EDGES[1:]:
        out = out.when(ms <= e, f"<={e}")
    return out.otherwise(f">{EDGES[-1]}")


def latency_histogram(log: DataFrame) -> DataFrame:
    """(mode, bucket, searches) of the buckets that occur."""
    return log.where("latency_ms is not null").groupBy(mode_of(F.col("mode")).alias("mode"), latency_bucket(F.col("latency_ms")).alias("bucket")).agg(F.count("*").alias("searches"))


def top_terms(terms: DataFrame, k: int = 10) -> DataFrame:
    """(term, n) of a table (term), exact, ties by term."""
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def decay(terms: DataFrame, factor: float, least: float = 0.01) -> DataFrame:
    """(term, n) after one decay step; what falls below ``least`` goes."""
    return terms.withColumn("n", F.col("n") * factor).where(F.col("n") >= least)


def structural(memories: DataFrame, triples: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: live memories, tombstones, collections, indexed documents and terms, triples."""
    a = memories.agg(F.count_if(~F.col("deleted")).alias("memories"), F.count_if("deleted").alias("tombstones"), F.countDistinct("collection").alias("collections"))
    b = token_stats(tokens).select(F.col("n_docs").alias("fts_docs"), F.col("n_terms").alias("fts_terms"))
    d = triples.select("s", "p", "o").distinct().agg(F.count("*").alias("triples"))
    return a.crossJoin(b).crossJoin(d)  # one row each
