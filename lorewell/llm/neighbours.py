"""Approximate nearest neighbours with learned partitions.

A sample of the vectors gets its exact neighbour graph.  The graph is partitioned
into parts of about equal size that cut few edges: recursive bisection gives a
start, then vertices move to the part that most of their neighbours are in while it
has room.  A small network (one hidden layer) learns, from a vector, the share of
its neighbours in each part.  Every vector is stored in the part it most probably
belongs to.  A sample can only tell so many parts apart, so that parts which are
still too large are partitioned once more, each by a graph and a network of its
own: the number of parts grows with the data, and the parts make a tree.

Parts that follow one another make a shard, which one task holds.  A vector moves
once, to the shard of its part; a query moves once to each shard that has a part it
asks, however many of its parts that is.  There it goes down the tree to every part
whose probability (the product along the path) is at least a cutoff, and what is
found is ranked by exact cosine.
The cutoff is set on held-out queries whose exact neighbours among all vectors are
known: the largest one that still reaches ``RECALL`` of these neighbours.  So the
routing says by itself how far it can be trusted on the given vectors, at any size.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorewell.shared import cut

K, PART_ROWS, SAMPLE, HELD_OUT, RECALL = 10, 256, 20_000, 200, 0.96
HIDDEN, STEPS, BATCH, GRAPH_K, TILE = 64, 800, 256, 16, 16_384
SHARD_BYTES = 128 << 20  # of vectors that a task of the search holds
LARGE = 8  # times PART_ROWS: a part of so many rows is partitioned itself
FAN = 1024  # a node's children are node * FAN and the following; the root is 1
FOUND = "id long, neighbour long, similarity double"
PLACED = "id long, v array<float>, node long, lp double, goal long"
SENT = "id long, v array<float>, shard int, kind int, node long, h long, router binary"
_HEAD, _STORED, _QUERY = 0, 1, 2  # kinds of rows, in the order in which a shard's task reads them


def normalised(column: pa.Array) -> np.ndarray:
    """(n, dim) unit vectors of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(queries: np.ndarray, ids: np.ndarray | None, x: np.ndarray, other: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) neighbours and similarities of the queries among x, most similar first, ties by id; with ``ids`` a vector is no neighbour of its own id.

    Places that nothing fills have id -1 and similarity -inf.
    """
    n, m = len(queries), len(x)
    near, sim = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    by_id = np.argsort(other, kind="stable")
    first, last = (np.searchsorted(other[by_id], ids, side=side) for side in ("left", "right")) if ids is not None else np.zeros((2, n), np.int64)
    for lo in range(0, n, block):
        s = queries[lo : lo + block] @ x.T
        f, times = first[lo : lo + block], (last - first)[lo : lo + block]
        own = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - f, times)
        s[np.repeat(np.arange(len(f)), times), by_id[own]] = -np.inf
        if m > k:
            least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(s >= least[:, None])  # all that tie with the k-th
        else:
            row, col = np.nonzero(s > -np.inf)
        value = s[row, col]
        order = np.lexsort((other[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (rank < k) & (value > -np.inf)
        near[lo + row[keep], rank[keep]] = other[col[keep]]
        sim[lo + row[keep], rank[keep]] = value[keep]
    return near, sim


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each vertex of the neighbour graph ((n, k) places, -1 for none); no part has more than ``slack`` of its share."""
    n = len(x)
    part = np.zeros(n, np.int64)
    stack = [(np.arange(n), 0, parts)]
    while stack:
        rows, base, count = stack.pop()
        if count == 1 or not len(rows):
            part[rows] = base
            continue
        half = count // 2
        y = x[rows] - x[rows].mean(axis=0)
        way = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(8):  # the direction in which the vectors spread most
            way = y.T @ (y @ way)
            way /= np.linalg.norm(way) + 1e-12
        order = np.argsort(y @ way, kind="stable")
        at = len(rows) * half // count
        stack += [(rows[order[:at]], base, half), (rows[order[at:]], base + half, count - half)]
    room = int(np.ceil(slack * n / parts))
    edge, to = np.nonzero(graph >= 0)
    ends = graph[edge, to]
    both, back = np.concatenate([edge, ends]), np.concatenate([ends, edge])
    for _ in range(rounds):
        votes = np.bincount(both * parts + part[back], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        size, moved = np.bincount(part, minlength=parts), 0
        for v in movers.tolist():
            b = best[v]
            if size[b] < room:
                size[part[v]] -= 1
                size[b] += 1
                part[v] = b
                moved += 1
        if moved < n // 1000 + 1:
            break
    return part


@dataclass
class Router:
    """The classifier: probabilities of all parts for unit vectors; ``rows`` has about how many vectors each part gets."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    rows: np.ndarray | None = None

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Router:
        with np.load(io.BytesIO(raw)) as f:
            return Router(**f)


def fit_router(x: np.ndarray, share: np.ndarray, steps: int = STEPS, seed: int = 3) -> Router:
    """Cross-entropy against the shares of neighbours by part, with Adam; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1], share.shape[1]
    p = [rng.normal(0, 1.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
    p = [a.astype(np.float32) for a in p]
    m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), BATCH)
        h = np.maximum(x[some] @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - share[some]) / BATCH
        d_h = (d @ p[2].T) * (h > 0)
        for i, g in enumerate((x[some].T @ d_h, d_h.sum(axis=0), h.T @ d, d.sum(axis=0))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            rate = 0.01 * (1 - 0.9 * step / steps)
            p[i] = p[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    return Router(*p)


def _usable(vectors: DataFrame, id_col: str, vector: str, queries: Column | None) -> DataFrame:
    """(id, v, query): rows with an id and a finite vector that isn't zero."""
    v = F.col(vector).cast("array<float>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), norm.alias("norm"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("query"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))).select("id", "v", "query")


def _true_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Exact neighbours of a few queries among all rows: each task sends its best, k for each query."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches):
        own, q = shared.value
        for batch in batches:
            if batch.num_rows:
                near, sim = exact(q, own, normalised(batch.column("v")), batch.column("id").to_numpy(), k)
                r, c = np.nonzero(near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(near[r, c]), pa.array(sim[r, c].astype(np.float64))], names=["id", "neighbour", "similarity"])

    best = _best(rows.mapInArrow(run, FOUND), k).toArrow()  # HELD_OUT * k rows
    at = {int(i): r for r, i in enumerate(ids)}
    out = np.full((len(ids), k), -1, np.int64)
    for i, n, r in zip(best["id"].to_pylist(), best["neighbour"].to_pylist(), best["rank"].to_pylist()):
        out[at[i], r - 1] = n
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k most similar distinct neighbours of each id."""
    each = found.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))  # which moves them once
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def fit_node(x: np.ndarray, rows: int, part_rows: int) -> Router | None:
    """A router for a node of ``rows`` vectors, from a sample of them; None if it cannot be partitioned, being too small or all alike."""
    every, x = x, np.unique(x, axis=0)
    parts = min(round(rows / part_rows), len(x) // 32, FAN)
    if parts < 2:
        return None
    place = np.arange(len(x))
    graph, _ = exact(x, place, x, place, GRAPH_K)
    part = balanced_parts(x, graph, parts)
    share = np.zeros((len(x), parts), np.float32)
    r, c = np.nonzero(graph >= 0)
    np.add.at(share, (r, part[graph[r, c]]), 1)
    share[place, part] += 1
    share /= share.sum(axis=1, keepdims=True)
    router = fit_router(x, share)
    home = router.log_probabilities(every).argmax(axis=1)
    router.rows = np.bincount(home, minlength=parts) * (rows / len(every))
    return router


def fit_subtree(node: int, x: np.ndarray, rows: int, part_rows: int, sample: int) -> Iterator[tuple[int, Router]]:
    """Routers of a node of ``rows`` vectors and of those below it that are still too large, from vectors of the node in random order; each is fitted to the first ``sample`` of its own."""
    router = fit_node(x[:sample], rows, part_rows)
    if not router:
        return
    yield node, router
    if (node + 1) * FAN >= 1 << 52:
        return
    home = router.log_probabilities(x).argmax(axis=1)
    size = np.bincount(home, minlength=len(router.rows)) * (rows / len(x))
    for part in np.flatnonzero(size >= LARGE * part_rows).tolist():
        own = x[home == part]
        if len(own) < len(x):
            yield from fit_subtree(node * FAN + part, own, round(size[part]), part_rows, sample)


def _train(part_rows: int, sample: int, most: int, below: bool):
    """Rows (node, n, v) come sorted by node, copies of a vector together; ``most`` different vectors of a node are held at most.  With ``below`` the nodes below are trained, too."""

    def run(batches):
        now, size, held, count, last = None, 0, [], 0, None

        def made():
            x = np.concatenate(held)
            each = fit_subtree(now, x, size, part_rows, sample) if below else ((now, r) for r in [fit_node(x, size, part_rows)] if r)
            for node, router in each:
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([router.to_bytes()], pa.binary())], names=["node", "router"])

        for batch in batches:
            node, n = (batch.column(c).to_numpy() for c in ("node", "n"))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if a == b:
                    continue
                if node[a] != now:
                    if held:
                        yield from made()
                    now, size, held, count, last = int(node[a]), int(n[a]), [], 0, None
                if count < most:
                    x = normalised(batch.column("v").slice(a, b - a))
                    new = np.ones(len(x), bool)
                    new[1:] = (x[1:] != x[:-1]).any(axis=1)
                    new[0] = last is None or (x[0] != last).any()
                    last = x[-1]
                    held.append(x[new][: most - count])
                    count += len(held[-1])
        if held:
            yield from made()

    return run


def _move(batch: pa.RecordBatch, at: np.ndarray, node: np.ndarray, lp: np.ndarray) -> pa.RecordBatch:
    take = pa.array(at)
    columns = [batch.column("id").take(take), batch.column("v").take(take), pa.array(node), pa.array(lp.astype(np.float64)), batch.column("goal").take(take)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "v", "node", "lp", "goal"])


def _home(router: Router, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each vector goes to its most probable part."""
    home = router.log_probabilities(normalised(batch.column("v"))).argmax(axis=1)
    return _move(batch, np.arange(len(home)), batch.column("node").to_numpy() * FAN + home, batch.column("lp").to_numpy())


def asked_parts(p: np.ndarray, rows: np.ndarray, cutoff: float, least: int) -> np.ndarray:
    """Whether a query asks a part: all that are probable enough, and the most probable ones until they have ``least`` rows."""
    asked = p >= cutoff
    few = np.flatnonzero(asked @ rows < least)
    if len(few):
        order = np.argsort(-p[few], axis=1, kind="stable")
        before = np.cumsum(rows[order], axis=1) - rows[order]
        more = np.zeros((len(few), p.shape[1]), bool)
        np.put_along_axis(more, order, before < least, axis=1)
        asked[few] |= more
    return asked


def _follow(level: int):
    """Each query goes the way that its goal went."""

    def run(router: Router, batch: pa.RecordBatch) -> pa.RecordBatch:
        goal = batch.column("goal").to_numpy()
        depth = np.floor(np.log2(goal) / np.log2(FAN) + 1e-9).astype(np.int64)
        child = goal // FAN ** (depth - level - 1)
        p = router.log_probabilities(normalised(batch.column("v")))[np.arange(len(goal)), child % FAN]
        return _move(batch, np.arange(len(goal)), child, batch.column("lp").to_numpy() + p)

    return run


def _pieces(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    return (batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows))


def _down(rows: DataFrame, level: int, routers: DataFrame, step: Callable[[Router, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``rows`` (PLACED) one level deeper; those whose node has no router stay.

    The root's router, of bounded size, goes to all tasks.  Deeper ones meet their
    rows in a shuffle; a node of many rows is met in several tasks, and its router
    goes to each of them.
    """
    if level == 0:
        root = Router.from_bytes(routers.first()["router"])

        def run(batches):
            for batch in batches:
                for some in _pieces(batch):
                    yield step(root, some)

        return rows.mapInArrow(run, PLACED)
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).join(routers, "node")
    routed = rows.join(sizes.select("node", "tiles"), "node").withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.col("tiles")).cast("int"))
    with_rows = routed.select(*[c.split()[0] for c in PLACED.split(", ")], "tile", F.lit(None).cast("binary").alias("router"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("v", "array<float>"))]
    heads = sizes.select(*nothing, "node", F.lit(0.0).alias("lp"), F.lit(None).cast("long").alias("goal"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "router")

    def run_sorted(batches):
        router = None
        for batch in batches:
            raw = batch.column("router")
            heads_at = np.flatnonzero(np.asarray(raw.is_valid()))
            edge = np.concatenate([[0], heads_at, [batch.num_rows]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if a in heads_at:
                    router, a = Router.from_bytes(raw[a].as_py()), a + 1
                for some in _pieces(batch.slice(a, b - a)):
                    yield step(router, some)

    both = with_rows.union(heads).repartition("node", "tile").sortWithinPartitions("node", "tile", F.col("router").isNull())
    return both.mapInArrow(run_sorted, PLACED).union(rows.join(routers.select("node"), "node", "left_anti").select(*[c.split()[0] for c in PLACED.split(", ")]))


@dataclass
class Tree:
    """The root's router and the sizes of its parts; ``levels`` has the routers (node, router) of each level."""

    levels: list[DataFrame]
    root: Router | None
    rows: np.ndarray  # of each part of the root
    different: np.ndarray


def _part_of(root: Router | None):
    """(node, h) of each vector, h being its hash."""

    def run(batches):
        for batch in batches:
            for some in _pieces(batch):
                x = normalised(some.column("v"))
                node = FAN + root.log_probabilities(x).argmax(axis=1) if root else np.ones(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("v"), pa.array(node), some.column("h")], names=["id", "v", "node", "h"])

    return run


def fit_tree(rows: DataFrame, total: int, held: list[int], part_rows: int, sample: int) -> Tree:
    """The tree over ``rows`` (id, v), some ``total`` different vectors; those of the ids in ``held`` train nothing."""
    hashed = rows.select("id", "v", F.xxhash64("v").alias("h"))
    dim = rows.select(F.size("v")).first()[0]

    def trained(some: DataFrame, below: bool) -> DataFrame:
        hold = max(sample, SHARD_BYTES // (4 * dim)) if below else sample
        some = some.where((F.pmod("h", F.col("n")) < hold) & ~F.col("id").isin(held)).select("node", "n", "v", "h")
        return cut(some.repartition("node").sortWithinPartitions("node", "h").mapInArrow(_train(part_rows, sample, 2 * hold, below), "node long, router binary"))

    def sizes(root: Router | None) -> dict[int, tuple[int, int]]:
        placed = hashed.mapInArrow(_part_of(root), "id long, v array<float>, node long, h long")
        found = placed.groupBy("node").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).collect()  # FAN rows at most
        return {r["node"]: (r["n"], r["d"]) for r in found}

    first = trained(hashed.select("*", F.lit(1).cast("long").alias("node"), F.lit(total).cast("long").alias("n")), False).first() if total >= 1.5 * part_rows else None
    if not first:
        n, d = sizes(None)[1]
        return Tree([], None, np.array([n]), np.array([d]))
    root = Router.from_bytes(first["router"])
    of = sizes(root)
    n, d = (np.array([of.get(FAN + p, (0, 0))[i] for p in range(len(root.rows))]) for i in (0, 1))
    levels = [rows.sparkSession.createDataFrame([(1, first["router"])], "node long, router binary")]
    large = [(FAN + int(p), int(d[p])) for p in np.flatnonzero(d >= LARGE * part_rows)]
    if large:
        own = F.broadcast(rows.sparkSession.createDataFrame(large, "node long, n long"))  # FAN rows at most
        deeper = trained(hashed.mapInArrow(_part_of(root), "id long, v array<float>, node long, h long").join(own, "node"), True)
        while not (level := deeper.where((F.col("node") >= FAN ** len(levels)) & (F.col("node") < FAN ** (len(levels) + 1)))).isEmpty():
            levels.append(level)
    return Tree(levels, root, n, d)


def _start(rows: DataFrame) -> DataFrame:
    return rows.select("id", "v", F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("lp"), F.lit(None).cast("long").alias("goal"))


def place(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``rows`` with their leaves."""
    placed = _start(rows)
    for level, routers in enumerate(levels):
        placed = cut(_down(placed, level, routers, _home))
    return placed


def build(rows: DataFrame, total: int, held: list[int], part_rows: int, sample: int) -> tuple[DataFrame, list[DataFrame]]:
    """(``rows`` with their leaves, the routers (node, router) of each level of the tree)."""
    tree = fit_tree(rows, total, held, part_rows, sample)
    return place(rows, tree.levels), tree.levels


def cutoff_of(rows: DataFrame, levels: list[DataFrame], ids: np.ndarray, x: np.ndarray, k: int, recall: float) -> float:
    """The largest log-probability that still lets the held-out queries reach ``recall`` of their exact neighbours."""
    true = _true_neighbours(rows, ids, x, k)
    q, _ = np.nonzero(true >= 0)
    pairs = [(n, int(t)) for n, t in enumerate(true[true >= 0].tolist())]  # at most HELD_OUT * k
    spark = rows.sparkSession
    vectors = spark.createDataFrame([(n, x[q[n]].tolist(), t) for n, t in pairs], "id long, v array<float>, t long")
    near = rows.where(F.col("id").isin([t for _, t in pairs])).select("id", "v").distinct()
    homes = place(near, levels).select(F.col("id").alias("t"), F.col("node").alias("goal")).distinct()
    asked = vectors.join(homes, "t").select("id", "v", F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("lp"), "goal")
    for level, routers in enumerate(levels):
        asked = cut(_down(asked, level, routers, _follow(level)))
    best = sorted((r["lp"] for r in asked.groupBy("id").agg(F.max("lp").alias("lp")).collect()), reverse=True)
    return best[int(np.ceil(recall * len(best))) - 1] - 1e-6 if best else 0.0


@dataclass
class Shards:
    """Which shards have the rows of the root's parts: part p is in ``tiles[p]`` of them, from ``first[p]`` on."""

    first: np.ndarray
    tiles: np.ndarray
    count: int

    @staticmethod
    def of(rows: np.ndarray, most: int) -> Shards:
        """Parts that follow one another share a shard while they have ``most`` rows at most; a larger part is split."""
        first, tiles, at, held = np.zeros(len(rows), np.int64), -(-rows // most), 0, 0
        for p, n in enumerate(rows.tolist()):
            if held and held + n > most:
                at, held = at + 1, 0
            first[p] = at
            if n > most:
                at, held = at + int(tiles[p]), 0
            else:
                held += n
        return Shards(first, tiles, at + (held > 0))


def _shard_rows(root: Router | None, shards: Shards):
    """Vectors go to the shards of their parts."""

    def run(batches):
        for batch in _part_of(root)(batches):
            node = batch.column("node").to_numpy()
            part = node - FAN if root else np.zeros(len(node), np.int64)
            ids = batch.column("id").to_numpy().astype(np.uint64)
            tile = ((ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.maximum(shards.tiles[part], 1).astype(np.uint64)).astype(np.int64)
            yield _sent(batch.column("id"), batch.column("v"), shards.first[part] + tile, _STORED, batch.column("node"), batch.column("h"))

    return run


def _sent(ids: pa.Array, v: pa.Array, shard: np.ndarray, kind: int, node: pa.Array, h: pa.Array) -> pa.RecordBatch:
    n = len(shard)
    return pa.RecordBatch.from_arrays([ids, v, pa.array(shard.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), node, h, pa.nulls(n, pa.binary())], names=[c.split()[0] for c in SENT.split(", ")])


def _shard_queries(root: Router | None, shards: Shards, cutoff: float, least: int):
    """A query goes once to each shard that has rows of a part it asks."""

    def run(batches):
        for batch in batches:
            dim = len(batch.column("v")[0]) if batch.num_rows else 1
            for some in _pieces(batch, max(1, min(4096, (8 << 20) // (shards.count * dim)))):
                x = normalised(some.column("v"))
                asked = asked_parts(root.log_probabilities(x), root.rows, cutoff, least) if root else np.ones((len(x), 1), bool)
                to = np.zeros((len(x), shards.count), bool)
                for p in range(asked.shape[1]):
                    to[:, shards.first[p] : shards.first[p] + shards.tiles[p]] |= asked[:, p : p + 1]
                row, shard = np.nonzero(to)
                take, none = pa.array(row), pa.nulls(len(row), pa.int64())
                yield _sent(some.column("id").take(take), some.column("v").take(take), shard, _QUERY, none, none)

    return run


class Held:
    """What a shard's task holds: vectors by leaf, and the routers of the leaves' nodes."""

    def __init__(self, root: Router | None, k: int):
        self.root, self.k = root, k
        self.routers: dict[int, Router] = {}
        self.leaves: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.above: set[int] = set()
        self.last: tuple | None = None

    def add(self, node: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows come sorted by node, hash and id: of copies that follow one another the first k of different ids stay."""
        n = len(x)
        same = np.zeros(n, bool)
        same[1:] = (node[1:] == node[:-1]) & (x[1:] == x[:-1]).all(axis=1)
        again = np.zeros(n, bool)
        again[1:] = same[1:] & (ids[1:] == ids[:-1])
        before = 0
        if self.last is not None and self.last[0] == node[0] and (self.last[2] == x[0]).all():
            same[0], again[0], before = True, self.last[1] == ids[0], self.last[3]
        new = np.cumsum(~again)
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        among = new - new[start] + 1  # which of its copies, from 1
        if same[0]:
            head = start == 0
            head &= np.cumsum(~same) == 0
            among[head] = before + np.cumsum(~again)[head]
        self.last = (node[-1], ids[-1], x[-1], int(among[-1]))
        keep = ~again & (among <= self.k)
        node, ids, x = node[keep], ids[keep], x[keep]
        for part in np.unique(node).tolist():
            own = node == part
            self.parts.setdefault(part, []).append((ids[own], x[own]))

    def _settle(self, node: int, ids: np.ndarray, x: np.ndarray) -> None:
        router = self.routers.get(node)
        if router is None:
            self.leaves[node] = (ids, x)
            return
        home = router.log_probabilities(x).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        part, at = np.unique(home[order], return_index=True)
        for p, rows in zip(part.tolist(), np.split(order, at[1:])):
            self._settle(node * FAN + p, ids[rows], x[rows])
        self.above.add(node)

    def settle(self) -> None:
        """All vectors are there: they go down to their leaves."""
        while self.parts:
            node, held = self.parts.popitem()
            self._settle(node, *(np.concatenate(c) for c in zip(*held)))
        every = np.concatenate([ids for ids, _ in self.leaves.values()]) if self.leaves else np.zeros(0, np.int64)
        self.once = len(np.unique(every)) == len(every)

    def search(self, x: np.ndarray, cutoff: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour, similarity): the k best of each query among the leaves that it asks."""
        best = Best(len(x), self.k, self.once)

        def down(node: int, router: Router, at: np.ndarray, lp: np.ndarray) -> None:
            p = router.log_probabilities(x[at]) + lp[:, None]
            asked = asked_parts(p, router.rows, cutoff, least)
            for part in range(p.shape[1]):
                child = node * FAN + part
                if (child in self.leaves or child in self.above) and len(own := np.flatnonzero(asked[:, part])):
                    if child in self.above:
                        down(child, self.routers[child], at[own], p[own, part])
                    else:
                        best.scan(at[own], x[at[own]], *self.leaves[child])

        every = np.arange(len(x))
        if self.root:
            down(1, self.root, every, np.zeros(len(x)))
        else:
            for leaf in self.leaves.values():
                best.scan(every, x, *leaf)
        return best.all()


class Best:
    """The k best of each query so far: equal similarities by id, a neighbour once.  ``once``: no id has several vectors."""

    def __init__(self, n: int, k: int, once: bool):
        self.k, self.once = k, once
        self.least = np.full(n, -np.inf, np.float32)  # what a k-th has at least
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending, self.most = 0, max(4096, 2 * n * k)

    def scan(self, at: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, block: int = 1024) -> None:
        for lo in range(0, len(x), block):
            own = ids[lo : lo + block]
            s = q @ x[lo : lo + block].T
            bound = self.least[at]
            if self.once and len(own) > self.k and (new := np.flatnonzero(bound == -np.inf)).size:
                bound[new] = -np.partition(-s[new], self.k - 1, axis=1)[:, self.k - 1]
                self.least[at] = bound
            found = np.flatnonzero(s >= bound[:, None])
            row, col = found // len(own), found % len(own)
            self.held.append((at[row], own[col], s.reshape(-1)[found]))
            self.pending += len(found)
            if self.pending > self.most:
                self.merge()

    def merge(self) -> None:
        row, near, sim = (np.concatenate(c) for c in zip(*self.held))
        if not self.once:
            order = np.lexsort((-sim, near, row))
            row, near, sim = row[order], near[order], sim[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
            row, near, sim = row[new], near[new], sim[new]
        order = np.lexsort((near, -sim, row))
        row, near, sim = row[order], near[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep, kth = rank < self.k, rank == self.k - 1
        self.least[row[kth]] = np.maximum(self.least[row[kth]], sim[kth])
        self.held, self.pending = [(row[keep], near[keep], sim[keep])], 0

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.merge()
        return self.held[0]


def _search(root: Router | None, k: int, cutoff: float, least: int):
    """Rows come sorted by (shard, kind): routers, vectors, queries; queries go by batch, only a shard's vectors are held."""

    def run(batches):
        shard, held, settled = None, None, False
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "kind")])
            edge = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if a == b:
                    continue
                if keys[0, a] != shard:
                    shard, held, settled = keys[0, a], Held(root, k), False
                some = batch.slice(a, b - a)
                if keys[1, a] == _HEAD:
                    held.routers |= {n: Router.from_bytes(r) for n, r in zip(some.column("node").to_pylist(), some.column("router").to_pylist())}
                elif keys[1, a] == _STORED:
                    held.add(some.column("node").to_numpy(), some.column("id").to_numpy(), normalised(some.column("v")))
                else:
                    if not settled:
                        held.settle()
                        settled = True
                    for piece in _pieces(some):
                        row, near, sim = held.search(normalised(piece.column("v")), cutoff, least)
                        own = piece.column("id").to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(near), pa.array(sim.astype(np.float64))], names=["id", "neighbour", "similarity"])

    return run


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding", queries: Column | None = None, part_rows: int = PART_ROWS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(id, neighbour, rank, similarity): the ``k`` vectors of largest cosine found for every query, ranks from 1.

    ``queries`` is a condition on the rows; without one every row is a query.  All
    rows are searched.  A row needs an id and a finite vector that isn't zero; other
    rows neither have nor are neighbours.  Vectors are compared with those of their
    own length, which have a tree of their own.  Equal similarities are ordered by
    id.  Of several rows under one id each is a candidate and, if it meets the
    condition, a query; the pair keeps the largest similarity, and an id is no
    neighbour of itself.  With fewer than k other ids in the parts that are asked,
    fewer are returned; an empty table gives an empty result; other columns are
    ignored.

    Of copies of one vector, however many, the k + 1 of smallest id are candidates,
    for no other can be among a query's k best; copies that are queries are searched
    for once, and each leaves itself out of what is found.  A shard has at most
    ``SHARD_BYTES`` of vectors, so that queries times shards, not queries times parts,
    are moved; a part with more of them is in several shards.
    """
    spark = vectors.sparkSession
    rows = cut(_usable(vectors, id_col, vector, queries))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()  # a row a length
    if not lengths:
        return spark.createDataFrame([], "id long, neighbour long, rank int, similarity double")
    numbers = cut(rows.where("query").select("v").distinct().withColumn("first", F.monotonically_increasing_id()))  # of the different queries
    each = [_found(*(t.where(F.size("v") == n["n"]) for t in (rows, numbers)), n["n"], k, part_rows, sample, recall) for n in lengths]
    found = _best(reduce(DataFrame.union, each), k + 1).drop("rank").withColumnRenamed("id", "first")
    # every query has what its vector has, but for itself
    asked = rows.where("query").select("id", "v").distinct().join(numbers, "v").select("id", "first")
    mine = asked.join(found, "first").where("id <> neighbour").drop("first")
    return _best(mine, k).select("id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


def _found(rows: DataFrame, numbers: DataFrame, dim: int, k: int, part_rows: int, sample: int, recall: float) -> DataFrame:
    """(number of the query, neighbour, similarity) that the search finds in ``rows`` (id, v), all of ``dim`` numbers, for the queries of ``numbers`` (v, first)."""
    total = rows.agg(F.approx_count_distinct(F.xxhash64("v"))).first()[0]
    few = rows.where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(total)) < 2 * HELD_OUT) if total > 10 * HELD_OUT else rows
    one = few.groupBy("v").agg(F.min("id").alias("id"))  # of copies, one is enough
    held = one.orderBy(F.xxhash64("id", F.lit(1)), "id", "v").limit(min(HELD_OUT, max(1, total // 5))).toArrow()
    ids, first = np.unique(held["id"].to_numpy(), return_index=True)
    tree = fit_tree(rows, total, ids.tolist(), part_rows, sample)
    least, cutoff = 8 * (k + 1), 0.0
    if tree.root:
        cutoff = cutoff_of(rows, tree.levels, ids, normalised(held["v"].combine_chunks())[first], k, recall)
    stays = np.minimum(tree.rows, tree.different * (k + 1))
    wide = -(-int(stays.sum()) // (2 * rows.sparkSession.sparkContext.defaultParallelism))  # enough shards for all cores
    shards = Shards.of(stays, max(1, min(max(TILE, wide), SHARD_BYTES // (4 * dim))))
    stored = rows.select("id", "v", F.xxhash64("v").alias("h")).mapInArrow(_shard_rows(tree.root, shards), SENT)
    asked = numbers.select(F.col("first").alias("id"), "v").mapInArrow(_shard_queries(tree.root, shards, cutoff, least), SENT)
    both = stored.union(asked)
    if len(tree.levels) > 1:
        at = rows.sparkSession.createDataFrame([(FAN + p, int(f) + t) for p, (f, n) in enumerate(zip(shards.first, shards.tiles)) for t in range(int(n))], "part long, shard int")
        nothing = {"id": "long", "v": "array<float>", "h": "long"}
        for level, routers in enumerate(tree.levels[1:]):
            heads = routers.withColumn("part", F.shiftright("node", level * (FAN.bit_length() - 1))).join(F.broadcast(at), "part")
            both = both.unionByName(heads.select("node", "router", "shard", F.lit(_HEAD).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()]))
    sent = both.repartitionById(shards.count, "shard").sortWithinPartitions("shard", "kind", "node", "h", "id")
    return sent.mapInArrow(_search(tree.root, k + 1, cutoff, least), FOUND)
