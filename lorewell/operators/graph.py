"""Triples (s, p, o, weight, source) and breadth-first expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorewell.shared import cut

KEY = ("s", "p", "o")
SCHEMA = "s string, p string, o string, weight float, source string"


def upsert(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """The last weight and source of each (s, p, o), by ``seq``."""
    last = F.max_by(F.struct("weight", "source"), seq).alias("last")
    return writes.groupBy(*KEY).agg(last).select(*KEY, "last.weight", "last.source")


def remove(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select(*KEY).distinct(), list(KEY), "left_anti")


def find(triples: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    """Triples with the given members, in the order of their key."""
    out = triples
    for name, value in (("s", subject), ("p", predicate), ("o", object_)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy(*KEY)


def find_prefix(triples: DataFrame, prefix: str, member: str = "s") -> DataFrame:
    return triples.where(F.col(member).startswith(prefix)).orderBy(*KEY)


def expand(triples: DataFrame, start: str | DataFrame, hops: int, multiplicity: bool = False) -> DataFrame:
    """Triples within ``hops`` of the start along edges in either direction, with the hop of the expansion that reached them.

    An entity is expanded once.  By default each triple comes once, with its
    smallest hop; with ``multiplicity`` once for each expanded end.  No hops give
    nothing.  ``start`` is one entity or a table of them (entity).  Frontier and
    visited entities are kept in the shared folder between hops.
    """
    spark = triples.sparkSession
    first = spark.createDataFrame([(start,)], "entity string") if isinstance(start, str) else start.select("entity").distinct()
    found = triples.select(*KEY, "weight", "source", F.lit(0).alias("hop")).where("false")
    frontier, seen = first, first
    for hop in range(1, hops + 1):
        out_ = triples.join(frontier, triples["s"] == frontier["entity"]).select(*KEY, "weight", "source", F.col("o").alias("next"))
        in_ = triples.join(frontier, triples["o"] == frontier["entity"]).select(*KEY, "weight", "source", F.col("s").alias("next"))
        met = cut(out_.unionByName(in_))
        found = found.unionByName(met.select(*KEY, "weight", "source", F.lit(hop).alias("hop")))
        if hop == hops:
            break
        frontier = cut(met.select(F.col("next").alias("entity")).distinct().join(seen, "entity", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if multiplicity:
        return found
    return found.groupBy(*KEY).agg(F.first("weight").alias("weight"), F.first("source").alias("source"), F.min("hop").alias("hop"))


def memories_near(triples: DataFrame, hits: DataFrame, hops: int = 1) -> DataFrame:
    """(doc_id, hop): memories that are the source of a triple within reach of the triples of the hits."""
    own = triples.join(hits.select(F.col("doc_id").cast("string").alias("source")), "source", "left_semi")
    start = own.select(F.explode(F.array("s", "o")).alias("entity")).distinct()
    near = expand(triples, start, hops).where("source is not null").groupBy(F.col("source").alias("doc_id")).agg(F.min("hop").alias("hop"))
    return near.join(hits.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_anti")
