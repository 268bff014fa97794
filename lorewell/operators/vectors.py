"""Exact vector search, in single precision or quantised."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.functions import vectors as V
from lorewell.shared import cut


def quantize_list(v: list[float]) -> tuple[list[int], float]:
    """The driver's copy of ``functions.vectors.quantize``, for a query's vector."""
    x = np.asarray(v, np.float32)
    by = np.float32(np.abs(x).max() / np.float32(127)) if len(x) else np.float32(0)
    if by == 0:
        return [0] * len(x), 0.0
    r = (x / by).astype(np.float64)
    return (np.sign(r) * np.floor(np.abs(r) + 0.5)).astype(int).tolist(), float(by)


def search(table: DataFrame, query: list[float], top_k: int = 10, metric: str = "cosine", quantized: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score), larger is better, equal scores (of six decimals) by key; rows of another length than the query are skipped."""
    v = F.col(vector)
    if quantized:
        q, by = quantize_list(query)
        own = V.quantize(v)
        dot = V.dot_with(own, q)
        if metric == "cosine":
            score = F.coalesce(F.try_divide(dot, F.sqrt(V.int_dot(own, own).cast("double")) * F.lit(math.sqrt(sum(x * x for x in q)))), F.lit(0.0))
        else:
            score = dot * V.scale(v).cast("double") * F.lit(by)
    else:
        score = V.cosine_with(v, query) if metric == "cosine" else V.dot_with(v, query)
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    fits = table.where(F.size(v) == len(query))
    found = fits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key)
    return found.limit(top_k) if top_k > 0 else found


def first_chunk_vector(chunks: DataFrame) -> DataFrame:
    """(memory_id, vector): the vector of the first chunk that has one."""
    return chunks.where("vector is not null").groupBy("memory_id").agg(F.min_by("vector", "ord").alias("vector"))


def similar_pairs(table: DataFrame, threshold: float = 0.85, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(a, b, similarity), a < b: all pairs whose quantised cosine is at least ``threshold``.

    Rows are hashed to blocks; each pair of blocks is compared by one task as a
    product of two matrices of whole numbers.  Work is quadratic, as the operator
    is; what a task holds is two blocks.  Null and zero vectors are like nothing.
    """
    threshold = threshold if threshold > 0 else 0.85
    rows = cut(table.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), V.quantize(F.col(vector)).alias("q")))
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    placed = rows.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "id", "q", (F.least("own", "o").cast("long") * blocks + F.greatest("own", "o")).alias("pair"), F.expr("cast(own > o as int)").alias("side")
    )

    def compare(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        lists = t["q"].combine_chunks()
        flat, length = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(pa.compute.list_value_length(lists))
        first = np.cumsum(length) - length
        for dim in np.unique(length).tolist():
            own = np.flatnonzero(length == dim)
            x = flat[first[own][:, None] + np.arange(dim)].astype(np.float64)
            size = np.sqrt((x * x).sum(axis=1))
            left = np.flatnonzero(side[own] == 0)
            right = np.flatnonzero(side[own] == 1) if side.any() else left
            if not len(left) or not len(right):
                continue
            for lo in range(0, len(left), 1024):
                r = left[lo : lo + 1024]
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (x[r] @ x[right].T) / (size[r][:, None] * size[right][None])
                i, j = np.nonzero(s >= threshold)
                a, b, sim = ids[own[r[i]]], ids[own[right[j]]], s[i, j]
                keep = a < b if not side.any() else a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(sim[keep])], names=["a", "b", "similarity"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if lo == hi:
                    continue
                if held and pair[lo] != now:
                    yield from compare(held)
                    held = []
                now = pair[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compare(held)

    return placed.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long, similarity double").distinct()
