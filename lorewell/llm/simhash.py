"""SimHash near-duplicates, compared bit-sliced.

A document's features are its distinct pairs of neighbouring words (the word
itself if it has only one); words are those of ``bytetext`` after ``lower``.
Each feature's 256 hash bits vote, the majority of each bit makes the signature.
Two documents are near-duplicates if their signatures differ in at most
``radius`` bits; a group is a connected component of such pairs.

Comparison happens inside blocks.  A document goes into one block for each of
``BLOCKINGS`` minima of its hashed runs of ``RUN`` words: documents within the
radius share most runs, so that they meet in at least one block (recall against
all pairs is tested).  Inside blocks the signatures are kept as bit planes, 64
documents a word; one query is compared with 64 documents at once by adding up
the differing planes in carry-save counters, and a word is abandoned as soon as
all of its 64 distances exceed the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.bytetext import Words, mix, shingles, slices, utf8
from lorewell.operators.components import connected_components
from lorewell.shared import cut, shared_path

BITS = 256
RADIUS = 64
RUN = 4
BLOCKINGS = 8
TILE = 4096
_HELD = 60_000
_LANES = BITS // 64
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64))
SIGNED = "doc_id long, s0 long, s1 long, s2 long, s3 long, keys array<long>"


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures (n, 4) of the feature hashes of n documents; zeros for a document without features."""
    n = len(first) - 1
    out = np.zeros((n, _LANES), np.uint64)
    count = np.diff(first)
    full = np.flatnonzero(count)
    for lane in range(_LANES):
        bits = hashes if lane == 0 else mix(hashes + _SEEDS[lane])
        begin = 0
        while begin < len(full):
            end = int(np.searchsorted(first[full], first[full[begin]] + 65536, side="right"))
            end = max(begin + 1, end)
            lo, hi = first[full[begin]], first[full[end - 1] + 1]
            ones = np.zeros((end - begin, 64), np.int64)
            for at in range(lo, hi, 1 << 18):  # a very long document comes in parts
                to = min(hi, at + (1 << 18))
                start = np.maximum(first[full[begin:end]], at) - at
                has = np.flatnonzero((start < to - at) & (first[full[begin:end] + 1] > at))
                plane = np.unpackbits(bits[at:to].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[has] += np.add.reduceat(plane, start[has], axis=0, dtype=np.int32)
            win = ones * 2 > count[full[begin:end]][:, None]
            out[full[begin:end], lane] = np.packbits(win, axis=1, bitorder="little").reshape(-1).view(np.uint64)
            begin = end
    return out


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of every document, and their n + 1 offsets."""
    n = len(words.first) - 1
    pairs, at = shingles(words.hash, words.first, 2)
    alone = np.flatnonzero(np.diff(words.first) == 1)
    doc = np.searchsorted(words.first, at, side="right") - 1
    hashes = np.concatenate([pairs, words.hash[words.first[alone]]])
    doc = np.concatenate([doc, alone])
    _, kept = np.unique(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    kept = kept[np.argsort(doc[kept], kind="stable")]
    return hashes[kept], np.searchsorted(doc[kept], np.arange(n + 1))


def block_keys(words: Words) -> np.ndarray:
    """(n, BLOCKINGS) minima over the hashed runs of RUN words (of all words, if there are fewer)."""
    n = len(words.first) - 1
    runs, at = shingles(words.hash, words.first, RUN)
    doc = np.searchsorted(words.first, at, side="right") - 1
    count = np.diff(words.first)
    few = np.flatnonzero((count > 0) & (count < RUN))
    if len(few):
        with np.errstate(over="ignore"):
            extra = np.array([mix(np.array([words.hash[words.first[d] : words.first[d + 1]].sum(dtype=np.uint64)]))[0] for d in few], dtype=np.uint64)
        order = np.argsort(np.concatenate([doc, few]), kind="stable")
        runs, doc = np.concatenate([runs, extra])[order], np.concatenate([doc, few])[order]
    out = np.zeros((n, BLOCKINGS), np.uint64)
    begin = np.searchsorted(doc, np.arange(n))
    has = np.flatnonzero(count)
    for j in range(BLOCKINGS):
        if len(has):
            least = np.minimum.reduceat(mix(runs ^ _SEEDS[8 + j]), begin[has])
            out[has, j] = mix(least + _SEEDS[32 + j])
    return out


def _sign(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(*utf8(batch.column("text")))
            full = np.flatnonzero(np.diff(words.first))
            sig = _votes(*features(words))[full].view(np.int64)
            keys = block_keys(words)[full].view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BLOCKINGS, dtype=np.int32), pa.array(keys.reshape(-1)))
            columns = [batch.column("doc_id").take(pa.array(full)), *(pa.array(sig[:, i]) for i in range(_LANES)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "s0", "s1", "s2", "s3", "keys"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, s0..s3, keys) of every document that has a doc_id and a word; others have no signature."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(_sign, SIGNED)


def _full_adder(a, b, c):
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (planes, lowest first) is over the radius."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            same &= counter[i]
        else:
            over |= same & counter[i]
            same &= ~counter[i]
    return over


def planes(sig: np.ndarray) -> np.ndarray:
    """(BITS, words) bit planes of (n, BITS / 64) signatures: bit i of a word belongs to row 64 * word + i."""
    n = len(sig)
    bits = np.unpackbits(sig.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    out[:, :n] = bits.T
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def within(sig: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int, chunk: int = 1 << 14):
    """Pairs (i, j), i < j, of rows at most ``radius`` bits apart, j from begin[i] to end[i] - 1: two arrays at a time, of at most 64 * ``chunk`` pairs."""
    n, every = len(sig), ~np.uint64(0)
    begin = np.maximum(begin, np.arange(n) + 1)
    if not n or not (end > begin).any():
        return
    plane = planes(sig)
    query = np.unpackbits(sig.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    some = np.flatnonzero(end > begin)
    low, high = begin[some] >> 6, (end[some] - 1) >> 6
    tasks = np.concatenate([[0], np.cumsum(high - low + 1)])
    for start in range(0, int(tasks[-1]), chunk):
        t = np.arange(start, min(start + chunk, int(tasks[-1])))
        row = np.searchsorted(tasks, t, side="right") - 1
        q, w = some[row], low[row] + t - tasks[row]
        left = np.maximum(begin[q] - w * 64, 0).astype(np.uint64)
        right = np.minimum(end[q] - w * 64, 64).astype(np.uint64)
        lanes = (every << left) & (every >> (np.uint64(64) - right))
        counter = [np.zeros(len(t), np.uint64) for _ in range(BITS.bit_length())]
        for b in range(0, BITS, 8):
            x = [plane[b + k][w] ^ (np.uint64(0) - query[b + k][q].astype(np.uint64)) for k in range(8)]
            s0, c0 = _full_adder(x[0], x[1], x[2])
            s1, c1 = _full_adder(x[3], x[4], x[5])
            s2, c2 = _full_adder(s0, s1, x[6])
            one, c3 = s2 ^ x[7], s2 & x[7]
            t0, d0 = _full_adder(c0, c1, c2)
            two, d1 = t0 ^ c3, t0 & c3
            four, eight = d0 ^ d1, d0 & d1
            carry = np.zeros_like(one)
            for i, add in enumerate((one, two, four, eight)):
                counter[i], carry = _full_adder(counter[i], add, carry)
            for i in range(4, len(counter)):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            if b + 8 > radius:
                lanes &= ~_exceeds(counter, radius)
                if b % 16 == 8:
                    alive = np.flatnonzero(lanes)
                    if len(alive) < 0.75 * len(lanes):
                        q, w, lanes, counter = q[alive], w[alive], lanes[alive], [c[alive] for c in counter]
                        if not len(alive):
                            break
        if len(lanes):
            hit = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(hit)
            yield q[at], w[at] * 64 + bit


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its component) after the pairs (i, j) are joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _match(radius: int):
    """Rows come sorted by block; a row of side 0 is compared with the later rows of its block, or with side 1 only in a block of two tiles."""

    def run(batches):
        def close(rows: dict[str, np.ndarray], keys: np.ndarray):
            key = np.stack([rows["key"], rows["tile"]])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            first, last = np.concatenate([[0], change]), np.concatenate([change, [len(rows["key"])]])
            size = last - first
            end = np.repeat(last, size)
            ones = np.add.reduceat(rows["side"].astype(np.int64), first)
            begin = np.where(ones > 0, last - ones, first)  # the rows of side 1 stand last
            begin = np.repeat(begin, size)
            end = np.where((rows["side"] == 1), 0, end)
            sig = np.stack([rows[f"s{k}"] for k in range(_LANES)], axis=1).view(np.uint64)
            rep, n, turn = rows["rep"], rows["n"].astype(np.float64), rows["turn"]
            label, links = np.arange(len(rep)), np.zeros(len(rep))
            for i, j in within(np.ascontiguousarray(sig), begin, end, radius):
                label = _merge(label, i, j)
                new = rep[i] != rep[j]  # a pair counts in the first of its blocks only
                for k in range(keys.shape[1] - 1):
                    new &= (keys[i, k] != keys[j, k]) | (k >= turn[i])
                i, j = i[new], j[new]
                links += np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
            linked, some = np.flatnonzero(label != np.arange(len(rep))), np.flatnonzero(links)
            a = np.concatenate([rep[linked], rep[some]])
            b = pa.concat_arrays([pa.array(rep[label[linked]]), pa.nulls(len(some), pa.int64())])
            count = np.concatenate([np.zeros(len(linked)), links[some]]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(count)], names=["a", "b", "links"])

        def columns(table: pa.Table):
            keys = table["keys"].combine_chunks()
            keys = keys.flatten().to_numpy().reshape(len(table), -1)
            return {c: table[c].to_numpy() for c in table.column_names if c != "keys"}, keys

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < _HELD:
                continue
            table = pa.Table.from_batches(held)
            rows, keys = columns(table)
            same = (rows["key"] == rows["key"][-1]) & (rows["tile"] == rows["tile"][-1])
            cutoff = int(np.argmax(same))  # the last block may go on
            if cutoff:
                yield close({c: v[:cutoff] for c, v in rows.items()}, keys[:cutoff])
                rest = table.slice(cutoff).combine_chunks().to_batches()
                held, count = list(rest), len(same) - cutoff
        if held:
            yield close(*columns(pa.Table.from_batches(held)))

    return run


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, class_id, links): every document that has a near-duplicate, its class and how many near-duplicates it has.

    A link is a pair of documents whose signatures are at most ``radius`` bits apart
    and that share a block; a class is a connected component of links, named by its
    smallest doc_id.  A document without links is a class by itself and has no row.
    Documents with a null doc_id, a null or empty text or no word have no signature
    and are in no class.  A doc_id on several rows counts as one document, whose
    texts are in one class and whose links add up.  Very long texts are read whole.
    An empty table gives an empty result; other columns are ignored.

    Documents of equal signature and equal blocks are compared as one, so that
    thousands of copies cost one comparison; their links count nevertheless.  A
    block of more than ``TILE`` of these is split into tiles that are compared
    pairwise in separate tasks: nothing is left out, and no task holds a whole hot
    block.  Pairs are counted where they are found, and leave a task only as sums
    and as a forest.
    """
    signed = cut(signatures(docs).distinct())
    sig = [f"s{k}" for k in range(_LANES)]
    groups = signed.groupBy(*sig, "keys").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    rows = groups.withColumn("keys", F.concat("keys", F.array(F.xxhash64(*sig))))
    rows = rows.select("rep", "n", *sig, "keys", F.posexplode("keys").alias("turn", "key"))
    sizes = rows.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep", *sig), F.col("tiles")).cast("int"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    # tile = smaller * tiles + larger; side 1: the larger of two different tiles
    placed = rows.withColumn("o", F.explode(other)).select(
        "rep", "n", "turn", *sig, "keys", "key", (F.least("own", "o").cast("long") * F.col("tiles") + F.greatest("own", "o")).alias("tile"), F.expr("cast(own > o as int)").alias("side")
    )
    sorted_rows = placed.repartition("key", "tile").sortWithinPartitions("key", "tile", "side", "rep")
    found = cut(sorted_rows.mapInArrow(_match(radius), "a long, b long, links long"))
    members = cut(signed.join(groups, [*sig, "keys"]).select("doc_id", "rep", "n"))
    edges = found.where("b is not null and a <> b").select("a", "b").union(members.where("doc_id <> rep").select("rep", "doc_id"))
    classes = connected_components(edges.distinct())
    outer = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    links = members.join(outer, "rep", "left").groupBy("doc_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"))
    return classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")).join(links, "doc_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``gone``; a null doc_id stays."""
    mark = "__gone"
    while mark in docs.columns:
        mark += "_"
    ids = gone.select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(mark), "left_anti")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each class, that of smallest doc_id; rows without signature or doc_id stay."""
    return without(docs, near_duplicates(docs, radius).where("doc_id <> class_id"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, and the key's name; written once and read again, since numbers made anew could differ."""
    key = "__row"
    while key in docs.columns:
        key += "_"
    path = shared_path(docs.sparkSession, "numbered")
    docs.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path), key


def without_rows(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` whose key isn't a doc_id of ``gone``, without the key."""
    own = rows.withColumnRenamed("doc_id", key + "id").withColumnRenamed(key, "doc_id")
    return without(own, gone).drop("doc_id").withColumnRenamed(key + "id", "doc_id")


def drop_near_duplicate_rows(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, whatever their doc_ids: null and repeated ones count row by row.

    The row of smallest doc_id stays, one without doc_id only if the group has no
    other.  Rows without a word are in no group and stay.
    """
    rows, key = numbered(docs)
    found = cut(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), radius))
    group = found.select(F.col("doc_id").alias("row"), F.col("class_id").alias("group"))
    named = group.join(rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id")), "row")
    stays = named.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("first")).select("first.row")
    return without_rows(rows, key, group.join(stays, "row", "left_anti").select(F.col("row").alias("doc_id"))).select(*docs.columns)
