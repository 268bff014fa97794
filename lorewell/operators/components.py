"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lorewell.shared import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Each round links all neighbours of a node to the smallest of them: first the
    larger ones (large star), then the smaller ones (small star); the number of
    rounds grows with the logarithm of the longest path.  Each round is
    checkpointed in the shared folder.  Edges with a null end are ignored, a loop
    makes a component of one, repeated edges count once, an empty table gives an
    empty result.  The minimum over a node's neighbours is a window, so that a
    node with very many neighbours spills instead of filling memory.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = both.where("u = v").select("u").distinct()
    now = cut(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # a star is its own fixed point: (number of edges, sum of hashes) tells it
    mark = None
    for _ in range(most_rounds):
        each = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(W.partitionBy("u")), F.col("u"))
        large = each.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = F.min("v").over(W.partitionBy("u"))
        small = large.withColumn("m", least).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(nodes.select("node"), "node", "left_anti")
    return nodes.union(roots).union(alone).distinct()
