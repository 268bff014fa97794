"""Benchmark decontamination by greedy string tiling.

Words are those of ``bytetext`` after ``lower``.  A document and a benchmark item
meet if they share a run of ``LEAST`` words (all words of a shorter item).  The
shared runs, found with a running Karp-Rabin hash, are joined to maximal
matches; the longest is marked as a tile, what it covers leaves the other
matches, and so on until no match of that length is unmarked.  The item leaks if
its tiles cover at least ``COVERAGE`` of its words: since tiles may stand in any
order and place, a passage is found also when its sentences are reordered or
spread.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.bytetext import Words, mix, shingles, slices, utf8
from lorewell.llm.simhash import numbered, without, without_rows
from lorewell.shared import cut

LEAST = 5
COVERAGE = 0.5
BROADCAST_BYTES = 64 << 20
FOUND = "doc_id long, item_id long, coverage double, tiles int"


def tile(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> tuple[int, int]:
    """(covered words of the item, tiles) from the places i in doc and j in item where equal runs of ``least`` words start."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(i))) + least - 1
    heap = [(-int(n), int(b), int(a)) for n, a, b in zip(length, i[start], j[start])]
    heapq.heapify(heap)
    in_doc, in_item, tiles = set(), np.zeros(len(item), bool), 0
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        if n < least:
            break
        free = [not in_item[b + k] and (a + k) not in in_doc for k in range(n)]
        if all(free):
            in_item[b : b + n] = True
            in_doc.update(range(a, a + n))
            tiles += 1
            continue
        k = 0
        while k < n:  # what is still unmarked of the match goes back
            m = k
            while m < n and free[m]:
                m += 1
            if m - k >= least:
                heapq.heappush(heap, (-(m - k), b + k, a + k))
            k = m + 1
    return int(in_item.sum()), tiles


class Items:
    """Words and seeds of the benchmark: ``seeds[n]`` has sorted hashes of runs of n words, their items and places."""

    def __init__(self, ids: np.ndarray, column: pa.Array, least: int = LEAST):
        words = Words(*utf8(column))
        self.ids, self.first, self.hash = ids, words.first, words.hash
        count = np.diff(words.first)
        self.seeds = {}
        for n in sorted({min(least, int(c)) for c in np.unique(count) if c}):
            h, at = shingles(words.hash, words.first, n)
            item = np.searchsorted(words.first, at, side="right") - 1
            own = np.minimum(count[item], least) == n
            h, at, item = h[own], at[own], item[own]
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << 18, bool)
            sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.seeds[n] = (h[order], item[order], (at - words.first[item])[order], sieve)


def _matches(words: Words, items: Items, threshold: float, only: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """(row, item's index, coverage, tiles) of the leaks in a batch; with ``only``, each row is held against one item."""
    out = []
    for n, (seeds, seed_item, seed_at, sieve) in items.seeds.items():
        h, at = shingles(words.hash, words.first, n)
        some = np.flatnonzero(sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        h, at = h[some], at[some]
        lo, hi = np.searchsorted(seeds, h, side="left"), np.searchsorted(seeds, h, side="right")
        hit = np.flatnonzero(hi > lo)
        lo, hi, at = lo[hit], hi[hit], at[hit]
        each = hi - lo
        if not len(each):
            continue
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        place = np.repeat(at, each)
        row = np.searchsorted(words.first, place, side="right") - 1
        item, j, i = seed_item[which], seed_at[which], place - words.first[row]
        if only is not None:
            own = only[row] == item
            row, item, i, j = row[own], item[own], i[own], j[own]
        order = np.lexsort((item, row))
        row, item, i, j = row[order], item[order], i[order], j[order]
        cut_at = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)]))
        for a, b in zip(cut_at, np.append(cut_at[1:], len(row))):
            r, m = int(row[a]), int(item[a])
            own = items.hash[items.first[m] : items.first[m + 1]]
            if np.count_nonzero(np.bincount(j[a:b])) + n - 1 < threshold * len(own) and (b - a) * n < threshold * len(own):
                continue  # all its seeds together cover too little
            covered, tiles = tile(words.hash[words.first[r] : words.first[r + 1]], own, i[a:b], j[a:b], n)
            if covered >= threshold * len(own):
                out.append((r, m, covered / len(own), tiles))
    return out


def _emit(doc_ids, found, items: Items) -> pa.RecordBatch:
    row = pa.array([f[0] for f in found], pa.int64())
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(row), pa.array(items.ids[[f[1] for f in found]] if found else [], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int32())],
        names=["doc_id", "item_id", "coverage", "tiles"],
    )


def _leaks_broadcast(docs: DataFrame, bench: DataFrame, threshold: float, least: int) -> DataFrame:
    table = bench.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((table["item_id"].to_numpy(), table["text"].combine_chunks(), least))

    def run(batches):
        items = Items(*shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*utf8(batch.column("text")))
                yield _emit(batch.column("doc_id"), _matches(words, items, threshold), items)

    return docs.mapInArrow(run, FOUND)


def _chosen_seeds(hashes: np.ndarray, frequency: np.ndarray, words: int, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct seeds that stand for an item, places of each in it, places that a leak has at least among them).

    Tiles that cover ``threshold`` of an item's words have at least one seed for each
    ``n`` words.  The item can do without its most frequent seeds as long as fewer
    places than that are lost.
    """
    distinct, first, places = np.unique(hashes, return_index=True, return_counts=True)
    need = max(1, -(-int(np.ceil(threshold * words - 1e-9)) // n))
    order = np.lexsort((distinct, -frequency[first]))
    lost = np.cumsum(places[order])
    kept = order[np.searchsorted(lost, need, side="left") :]  # those before lose fewer places than needed
    return distinct[kept], places[kept], need - int(places.sum() - places[kept].sum())


def _leaks_joined(docs: DataFrame, bench: DataFrame, threshold: float, least: int) -> DataFrame:
    """For a benchmark too large to send to every task: seeds of both sides are joined, then the texts of the pairs that share enough of them.

    The most frequent seeds of an item, which hot passages would make meet with
    nearly every document, are left out as far as that loses no leak.
    """

    def places_of_items(batches):
        for batch in batches:
            items = Items(batch.column("item_id").to_numpy(), batch.column("text"), least)
            count = np.diff(items.first)
            for n, (h, item, _, _) in items.seeds.items():
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(item)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(count[item])], names=["item", "seed", "n", "words"])

    numbered_items = cut(bench.repartition("item_id").withColumn("item", F.monotonically_increasing_id()))
    places = numbered_items.mapInArrow(places_of_items, "item long, seed long, n int, words long")
    often = places.select("item", "seed", "n").distinct().groupBy("seed", "n").agg(F.count("*").alias("often"))

    def chosen(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, words = table["n"][0].as_py(), table["words"][0].as_py()
        seeds, times, need = _chosen_seeds(table["seed"].to_numpy(), table["often"].to_numpy(), words, n, threshold)
        size = len(seeds)
        return pa.table({"item": pa.array([key[0].as_py()] * size, pa.int64()), "seed": seeds, "n": pa.array([n] * size, pa.int32()), "places": times, "need": pa.array([need] * size, pa.int64())})

    item_seeds = cut(places.join(often, ["seed", "n"]).groupBy("item").applyInArrow(chosen, "item long, seed long, n int, places long, need long"))
    sizes = [r.n for r in item_seeds.select("n").distinct().collect()]  # at most ``least`` numbers

    def seeds_of_docs(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*utf8(batch.column("text")))
                for n in sizes:
                    h, at = shingles(words.hash, words.first, n)
                    row = np.searchsorted(words.first, at, side="right") - 1
                    _, one = np.unique(h ^ mix(row.astype(np.uint64)), return_index=True)
                    ids = batch.column("doc_id").take(pa.array(row[one]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(h[one].view(np.int64)), pa.array(np.full(len(one), n, np.int32))], names=["doc_id", "seed", "n"])

    shared = docs.mapInArrow(seeds_of_docs, "doc_id long, seed long, n int").join(item_seeds, ["seed", "n"])
    pairs = shared.groupBy("doc_id", "item").agg(F.sum("places").alias("places"), F.max("need").alias("need")).where("places >= need").select("doc_id", "item")
    both = pairs.join(docs, "doc_id").join(numbered_items.withColumnRenamed("text", "item_text"), "item")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                items_at, first, only = np.unique(batch.column("item").to_numpy(), return_index=True, return_inverse=True)
                own = pa.array(first)
                items = Items(batch.column("item_id").take(own).to_numpy(), batch.column("item_text").take(own), least)
                yield _emit(batch.column("doc_id"), _matches(Words(*utf8(batch.column("text"))), items, threshold, only), items)

    return both.select("doc_id", "text", "item", "item_id", "item_text").mapInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of every document and benchmark item of which it holds at least ``threshold``.

    Null ids and null texts and items without words match nothing; an item of
    fewer than ``least`` words matches only as a whole.  Rows with the same
    doc_id and text, and the same item_id and text, count once; of different
    texts under one id, the one covered most, with the fewest tiles if several are
    covered alike.  Very long texts are read whole.  Other columns are ignored; empty
    tables give an empty result.
    """
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    found = (_leaks_broadcast if size <= broadcast_bytes else _leaks_joined)(own, bench, threshold, least)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", (-F.col("tiles")).alias("fewer"))).alias("best"))
    return best.select("doc_id", "item_id", "best.coverage", (-F.col("best.fewer")).alias("tiles"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that ``leaks`` lists; rows without doc_id or text stay."""
    return without(docs, leaks(docs, benchmark, threshold))


def drop_leaking_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their doc_ids: null and repeated ones count row by row."""
    rows, key = numbered(docs)
    found = leaks(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, threshold)
    return without_rows(rows, key, found).select(*docs.columns)
