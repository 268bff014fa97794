"""Ranked lanes and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorewell.functions import scores


def ranked(lane: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """(key, rank) of a lane that was cut to its best rows already (a few times top_k)."""
    return lane.select(F.col(key).alias("doc_id"), F.row_number().over(W.orderBy(F.desc(score), key)).alias("rank"))


def fuse(lanes: dict[str, DataFrame], top_k: int = 10, k: int = scores.RRF_K) -> DataFrame:
    """(doc_id, score, <lane>_rank ...): reciprocal rank fusion, ties by doc_id; the rank in a lane that lacks the document is 0."""
    top_k, k = top_k if top_k > 0 else 10, k if k > 0 else scores.RRF_K
    names = list(lanes)
    one = [ranked(lane).select("doc_id", *((F.col("rank") if other == name else F.lit(None).cast("int")).alias(f"{other}_rank") for other in names)) for name, lane in lanes.items()]
    # union and one aggregation instead of a chain of outer joins
    merged = reduce(DataFrame.unionByName, one).groupBy("doc_id").agg(*(F.max(f"{n}_rank").alias(f"{n}_rank") for n in names))
    total = reduce(lambda a, b: a + b, (scores.rrf(F.col(f"{n}_rank"), k) for n in names))
    out = merged.select("doc_id", F.round(total, 6).alias("score"), *(F.coalesce(f"{n}_rank", F.lit(0)).cast("long").alias(f"{n}_rank") for n in names))
    return out.orderBy(F.desc("score"), "doc_id").limit(top_k)


def weighted(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5, top_k: int = 10) -> DataFrame:
    """(doc_id, score): alpha of the min-max normalised lexical score and the rest of the similarity."""
    low, high = F.min("score").over(W.partitionBy()), F.max("score").over(W.partitionBy())
    lex = lexical.select("doc_id", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(1.0)).alias("lex"))
    both = lex.join(semantic.select("doc_id", F.col("score").alias("sem")), "doc_id", "full_outer")
    out = both.select("doc_id", F.round(alpha * F.coalesce("lex", F.lit(0.0)) + (1 - alpha) * F.coalesce("sem", F.lit(0.0)), 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(top_k)


def matches(type_: str | None = None, metadata: dict[str, str] | None = None, after: str | None = None, before: str | None = None, kind: str = "type", meta: str = "metadata", created: str = "created_at") -> Column:
    """Filter on type, metadata values and time, applied before ranking so that the scan can use it."""
    out = F.lit(True)
    if type_ is not None:
        out = out & (F.col(kind) == type_)
    for k, v in (metadata or {}).items():
        out = out & (F.get_json_object(F.col(meta), f"$.{k}") == v)
    if after is not None:
        out = out & (F.col(created) >= F.lit(after).cast("timestamp"))
    if before is not None:
        out = out & (F.col(created) < F.lit(before).cast("timestamp"))
    return out


def min_max(score: Column, over=None) -> Column:
    """To 0..1 over a query's candidates; 1 where all are equal."""
    w = over if over is not None else W.partitionBy()
    return F.coalesce(F.try_divide(score - F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)), F.lit(1.0))
