"""Sequence packing by shortest-pack-first over the length histogram.

A document's length is its number of words (``bytetext``) plus one for the mark
that ends it.  A longer one than ``SEQUENCE`` is cut into full pieces and a rest;
every word of every document lands in exactly one pack.  Only the histogram of
piece lengths (at most SEQUENCE numbers, whatever the corpus) goes to the driver.
There, lengths are placed longest first: pieces go to the open packs with the
least filling that have room; packs of equal content are one pattern with a
count.  The patterns come back as intervals of ranks: the pieces of a length are
ranked, and a search among its intervals says which pack and which offset a piece has.
"""

from __future__ import annotations

from bisect import insort
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorewell.shared import cut

SEQUENCE = 2048
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(packs, lengths in each) patterns by shortest-pack-first: longest lengths first, each to the emptiest packs that have room.

    ``counts`` has a number of pieces for each length from 1 to ``size``.  Packs of
    a pattern are alike, so that a step moves as many as pieces allow.
    """
    filled: dict[int, dict[tuple[int, ...], int]] = {}
    fills: list[int] = []  # sorted sums of the open packs

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if total not in filled:
            filled[total] = {}
            insort(fills, total)
        filled[total][pattern] = filled[total].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if length < 1 or length > size:
            raise ValueError(f"length {length} is not in 1..{size}")
        while left:
            if fills and fills[0] + length <= size:
                total = fills[0]
                group = filled[total]
                pattern = min(group)
                n = min(left, group[pattern])
                group[pattern] -= n
                if not group[pattern]:
                    del group[pattern]
                    if not group:
                        del filled[total]
                        fills.pop(0)
                put(total + length, (*pattern, length), n)
            else:
                # none has room: a new pack is then the emptiest until it has no room either
                m = size // length
                if left >= m:
                    put(m * length, (length,) * m, left // m)
                if left % m:
                    put(left % m * length, (length,) * (left % m), 1)
                n = left
            left -= n
    return [(n, pattern) for total in sorted(filled, reverse=True) for pattern, n in sorted(filled[total].items())]


def intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, packs, first pack, first slot, first offset) for every run of equal lengths in every pattern, sorted.

    The pieces of a length with the ranks from the first on fill one slot of all the
    pattern's packs after the other.  A pattern is left behind by at most two steps of
    each length, and has fewer than 64 different lengths for packs of 2,048 (their sum
    bounds them), so that there are at most some 400,000 runs, whatever the corpus.
    """
    out, next_rank, pack = [], {}, 0
    for n, pattern in patterns:
        slot = offset = 0
        for length, run in groupby(pattern):
            times = sum(1 for _ in run)
            begin = next_rank.get(length, 0)
            out.append((length, begin, n, pack, slot, offset))
            next_rank[length] = begin + n * times
            slot += times
            offset += times * length
        pack += n
    return sorted(out)


def places(plan: list[tuple[int, int, int, int, int, int]], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pack, slot, offset) of the pieces with these lengths and ranks."""
    first = np.array([(x[0], x[1]) for x in plan], np.int64).reshape(-1, 2)
    n, pack, slot, offset = np.array([x[2:] for x in plan], np.int64).reshape(-1, 4).T
    # intervals of one length stand together; inside them the rank is searched for
    lo, hi = np.searchsorted(first[:, 0], length, side="left"), np.searchsorted(first[:, 0], length, side="right")
    while (open_ := hi - lo > 1).any():
        mid = (lo + hi) // 2
        up = open_ & (first[np.minimum(mid, len(first) - 1), 1] <= rank)
        lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
    turn, which = np.divmod(rank - first[lo, 1], n[lo])
    return pack[lo] + which, slot[lo] + turn, offset[lo] + turn * length


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def pack(docs: DataFrame, size: int = SEQUENCE, length: Column | None = None, bucket_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece, start, length, pack_id, slot, offset), one row for every piece of every document.

    ``start`` is the piece's first word in the document, ``slot`` its turn and
    ``offset`` its first position in the pack.  A null or empty text has length 1
    (its end mark).  A row with a null doc_id takes part like any other; rows
    that are repeated are packed each.  Of equal lengths, those with the smaller
    hash bucket, then doc_id, come first; rows alike in all of these are
    interchangeable.  Texts of any length are counted whole and cut into pieces.
    Other columns are ignored.  An empty table gives an empty result.

    Ranks are counted in hash buckets of doc_id: a window ranks the pieces of one
    length in one bucket, and the buckets' counts give what to add.  So the most
    frequent length (full pieces) is not sorted by one task.
    """
    spark = docs.sparkSession
    words = F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0)).cast("long") + 1
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("n"))
    pieces = sized.select("doc_id", F.posexplode(F.expr(f"sequence(0L, (n - 1) div {size})")).alias("piece", "k"), "n").select(
        "doc_id", "piece", (F.col("k") * size).alias("start"), F.least(F.lit(size).cast("long"), F.col("n") - F.col("k") * size).cast("int").alias("length")
    )
    pieces = cut(pieces)
    total = pieces.count()
    buckets = max(1, -(-total // bucket_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(buckets)).cast("int"))
    each = pieces.groupBy("length", "bucket").count()
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = intervals(pack_histogram(counts, size))
    shared = spark.sparkContext.broadcast(plan)  # bounded by the sequence's length, see ``intervals``
    before = each.select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1).join(before, ["length", "bucket"])

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            pack_id, slot, offset = places(shared.value, length.astype(np.int64), rank)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pack_id), pa.array(slot.astype(np.int32)), pa.array(offset.astype(np.int32))], names=["doc_id", "piece", "start", "length", "pack_id", "slot", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("r") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length int, pack_id long, slot int, offset int")
