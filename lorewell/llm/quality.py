"""Quality classifier: a byte-level convolutional network in numpy.

Every byte is embedded in ``EMBED`` numbers; ``FILTERS`` learned filters of
``WIDTH`` bytes run over the whole document in overlapping chunks (``CHUNK``
window starts each, so that neighbours share WIDTH - 1 bytes).  Each filter is
max-pooled in every chunk; a document has the maximum and the mean of its chunks'
maxima, and a logistic layer combines them into one probability that the
document is good.

Most filters start from byte windows that toxic or poor documents of the sample
have and others lack; the rest start at random (their maxima are low where a text
keeps repeating itself).  All are then trained, with embedding and logistic
layer, by gradient descent on at most ``SAMPLE`` labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm.bytetext import mix, utf8

EMBED, WIDTH, FILTERS, CHUNK = 8, 8, 48, 256
FROM_TOXIC, FROM_POOR = 24, 12  # filters that start from windows of such texts; the others start at random
SAMPLE, SAMPLE_BYTES, STEPS, BATCH, THRESHOLD = 4000, 16384, 600, 64, 0.5


@dataclass
class Net:
    emb: np.ndarray  # (256, EMBED)
    w: np.ndarray  # (WIDTH * EMBED, FILTERS)
    b: np.ndarray  # (FILTERS,)
    v: np.ndarray  # (2 * FILTERS + 1,)
    c: float


def lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side in whole chunks, each with WIDTH - 1 zero bytes before it, so that no window sees two texts; and the chunk offsets of the texts."""
    size = np.diff(offsets)
    chunks = -(-(size + WIDTH - 1) // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    out = np.zeros(int(first[-1]) * CHUNK + WIDTH, np.uint8)
    shift = first[:-1] * CHUNK - offsets[:-1] + WIDTH - 1
    if len(data):
        out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, first


def chunk_maxima(net: Net, laid: np.ndarray, n_chunks: int, where: bool = False, part: int = 512):
    """(chunks, FILTERS) maxima before bias, and the window starts that give them if asked."""
    best = np.empty((n_chunks, FILTERS), np.float32)
    place = np.empty((n_chunks, FILTERS), np.int64) if where else None
    step = CHUNK // WIDTH
    for at in range(0, n_chunks, part):
        m = min(part, n_chunks - at)
        e = net.emb[laid[at * CHUNK : (at + m) * CHUNK + WIDTH]]
        top = None
        for phase in range(WIDTH):  # windows that start at phase, phase + WIDTH, ... need no copy
            y = (e[phase : phase + m * CHUNK].reshape(-1, WIDTH * EMBED) @ net.w).reshape(m, step, FILTERS)
            if where:
                k = y.argmax(axis=1)
                value = np.take_along_axis(y, k[:, None], axis=1)[:, 0]
                k = k * WIDTH + phase
                if top is None:
                    top, pos = value, k
                else:
                    pos = np.where(value > top, k, pos)
                    top = np.maximum(top, value)
            else:
                half = step
                while half > 1:  # halving keeps the maxima in long contiguous rows
                    half //= 2
                    y = np.maximum(y[:, :half], y[:, half : 2 * half])
                y = y[:, 0]
                top = y if top is None else np.maximum(top, y, out=top)
        best[at : at + m] = top
        if where:
            place[at : at + m] = pos + (at + np.arange(m))[:, None] * CHUNK
    return best, place


def _fill(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight of each chunk in its text's mean: its share of the text's bytes."""
    doc = np.repeat(np.arange(len(size)), np.diff(first))
    begin = (np.arange(int(first[-1])) - first[doc]) * CHUNK - WIDTH + 1
    own = np.clip(np.minimum(size[doc], begin + CHUNK) - np.maximum(begin, 0), 0, CHUNK)
    own = np.where(size[doc] == 0, CHUNK, own)
    return (own / np.maximum(size[doc], np.where(size[doc] == 0, CHUNK, 1))).astype(np.float32)


def _pool(act: np.ndarray, first: np.ndarray, size: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Maxima, means, and how far (in powers of two) the text falls short of a whole chunk, which lowers maxima."""
    short = np.maximum(0, 8 - np.log2(size + 1))[:, None].astype(np.float32)
    return np.concatenate([np.maximum.reduceat(act, first[:-1], axis=0), np.add.reduceat(act * fill[:, None], first[:-1], axis=0), short], axis=1)


def score(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each text; every byte takes part.  An empty text is one chunk of filling."""
    if len(offsets) < 2:
        return np.zeros(0)
    laid, first = lay_out(data, offsets)
    best, _ = chunk_maxima(net, laid, int(first[-1]))
    size = np.diff(offsets)
    z = _pool(np.maximum(best + net.b, 0), first, size, _fill(size, first)) @ net.v + net.c
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _templates(laid: np.ndarray, first: np.ndarray, bad: np.ndarray, n: int) -> list[np.ndarray]:
    """n windows of 5 bytes that many bad and few good texts have, each picked for the texts that the earlier ones explain least."""
    k, found, slots = 5, [], 1 << 24

    def windows(d: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of a text's windows, each once, and a place of each."""
        own = laid[first[d] * CHUNK : first[d + 1] * CHUNK].astype(np.uint64)
        h = np.zeros(len(own) - k, np.uint64)
        for i in range(k):
            h = h << np.uint64(8) | own[i : len(own) - k + i]
        return np.unique((mix(h) >> np.uint64(40)).astype(np.int64), return_index=True)

    n_bad, n_good = np.zeros(slots, np.int16), np.zeros(slots, np.int16)
    for d in range(len(bad)):
        (n_bad if bad[d] else n_good)[windows(d)[0]] += 1
    some = np.flatnonzero(n_bad >= min(4, max(1, bad.sum() // 8)))
    gain = n_bad[some] / max(1, bad.sum()) - 3 * n_good[some] / max(1, (~bad).sum())
    top = some[np.argsort(-gain, kind="stable")[:2500]]
    top = np.sort(top[gain[np.searchsorted(some, top)] > 0])
    rows, at = np.zeros((len(top), len(bad)), np.float32), np.zeros(len(top), np.int64)
    for d in range(len(bad) if len(top) else 0):
        slot, place = windows(d)
        row = np.minimum(np.searchsorted(top, slot), len(top) - 1)
        hit = top[row] == slot
        rows[row[hit], d] = 1
        if bad[d]:
            at[row[hit]] = place[hit] + first[d] * CHUNK
    weight = np.ones(len(bad), np.float32)
    good = -3 * max(1, bad.sum()) / max(1, (~bad).sum())
    while len(found) < n and len(top):
        value = rows @ np.where(bad, weight, good)
        r = int(value.argmax())
        if value[r] <= 0:
            break
        found.append(laid[at[r] : at[r] + k])
        weight[rows[r] > 0] *= 0.5
        overlap = rows @ rows[r] > 0.6 * rows.sum(axis=1)
        rows[overlap] *= 0.7
        rows[r] = 0
    return found


def fit(texts: list[bytes], good: np.ndarray, toxic: np.ndarray | None = None, steps: int = STEPS, seed: int = 5) -> Net:
    """Train on whole texts; the same input gives the same network.  Without both classes the probability is the share of good ones (1 without labels)."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1, (256, EMBED)).astype(np.float32)
    emb /= np.linalg.norm(emb, axis=1, keepdims=True)
    emb[0] = 0
    net = Net(emb, rng.normal(0, 0.35, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1, np.float32), 0.0)
    good = np.asarray(good, bool)
    share = good.mean() if len(good) else 1.0
    net.c = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
    if not len(good) or good.all() or not good.any():
        return net
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    laid, first = lay_out(data, offsets)
    toxic = np.zeros(len(good), bool) if toxic is None else np.asarray(toxic, bool)
    starts = _templates(laid, first, toxic, FROM_TOXIC) + _templates(laid, first, ~good & ~toxic, FROM_POOR)
    for f, t in enumerate(starts):
        net.w[:, f] = 0
        net.w[: len(t) * EMBED, f] = emb[t].reshape(-1)
        net.b[f], net.v[f] = -0.75 * len(t), -3.0
    net.v[:FILTERS] += rng.normal(0, 0.02, FILTERS)
    loose = np.arange(len(starts), FILTERS)
    net.v[FILTERS + loose] = 0.5
    net.v[-1] = 1.0
    size = np.diff(offsets)
    fill = _fill(size, first)
    usual = _pool(np.maximum(chunk_maxima(net, laid, int(first[-1]))[0] + net.b, 0), first, size, fill)
    net.c -= float(np.median(usual[good][:, FILTERS + loose] @ net.v[FILTERS + loose]))
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in "emb w b v".split()} | {"c": (np.zeros(()), np.zeros(()))}
    n, step = len(texts), 0
    while step < steps:
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            some = np.sort(order[lo : lo + BATCH])
            own = np.concatenate([np.arange(first[d], first[d + 1]) for d in some])
            sub = np.concatenate([[0], np.cumsum(first[some + 1] - first[some])])
            block = np.concatenate([laid[: -WIDTH].reshape(-1, CHUNK)[own].reshape(-1), np.zeros(WIDTH, np.uint8)])
            best, place = chunk_maxima(net, block, len(own), where=True)
            act = np.maximum(best + net.b, 0)
            pooled = _pool(act, sub, size[some], fill[own])
            z = pooled @ net.v + net.c
            d_z = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - good[some]) / len(some)
            grads = {"v": pooled.T @ d_z + 1e-4 * net.v, "c": np.array(d_z.sum())}
            d_pool = d_z[:, None] * net.v
            doc = np.repeat(np.arange(len(some)), np.diff(sub))
            d_act = d_pool[doc, FILTERS:-1] * fill[own][:, None] + d_pool[doc, :FILTERS] * (act >= pooled[doc, :FILTERS])
            d_act = (d_act * (act > 0)).astype(np.float32)
            grads["b"] = d_act.sum(axis=0)
            grads["w"], d_emb = np.zeros_like(net.w), np.zeros_like(net.emb)
            c, f = np.nonzero(d_act)
            windows = block[place[c, f][:, None] + np.arange(WIDTH)]
            g = d_act[c, f]
            x = net.emb[windows].reshape(len(c), -1) * g[:, None]
            begin = np.argsort(f, kind="stable")
            has, cut = np.unique(f[begin], return_index=True)
            if len(has):
                grads["w"][:, has] = np.add.reduceat(x[begin], cut, axis=0).T
                back = (net.w.T[f] * g[:, None]).reshape(-1, EMBED)
                for e in range(EMBED):
                    d_emb[:, e] = np.bincount(windows.reshape(-1), back[:, e], 256)
            d_emb[0] = 0
            grads["emb"] = d_emb
            step += 1
            for k, gr in grads.items():
                m1, m2 = state[k]
                m1 = 0.9 * m1 + 0.1 * gr
                m2 = 0.99 * m2 + 0.01 * gr * gr
                state[k] = (m1, m2)
                rate = {"v": 0.05, "c": 0.05}.get(k, 0.005) * max(0.1, 1 - 0.9 * step / steps)
                new = getattr(net, k) - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
                setattr(net, k, float(new) if k == "c" else new.astype(np.float32))
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, steps: int = STEPS) -> Net:
    """Network from the labelled documents; good means quality 1 and not toxic.

    The sample is bounded: the documents of the ``most`` labels of smallest hashed
    doc_id, but for those of more than ``most_bytes`` bytes.  Rows with a null doc_id,
    text or quality don't count, a null toxic counts as 0; of repeated rows, each
    counts.
    """
    marked = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").cast("long").alias("i"), (F.col("quality") == 1).alias("fine"), (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"))
        .orderBy(F.xxhash64("i"), "i", "fine", "toxic")
        .limit(most)
    )
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).select(F.col("doc_id").cast("long").alias("i"), "text")
    # at most ``most`` short rows are broadcast, so that the documents are read once and not shuffled
    chosen = texts.join(F.broadcast(marked), "i").toPandas().sort_values(["i", "text", "fine", "toxic"], ignore_index=True)
    toxic = chosen["toxic"].to_numpy(bool)
    return fit([t.encode("utf-8") for t in chosen["text"]], chosen["fine"].to_numpy(bool) & ~toxic, toxic, steps)


def probability(net: Net, text: Column) -> Column:
    """Probability that the text is good; a null text counts as empty."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        out, begin = [], 0
        while begin < len(offsets) - 1:  # about 2 MB at a time
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + (2 << 20), side="right")) - 1)
            out.append(score(net, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]))
            begin = end
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, probability_as: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose probability is at least ``threshold``, with their columns as they are (and the probability, if named).

    Rows are judged one by one, so that copies share their fate; null and empty
    texts get the network's value for an empty text; texts of any length are judged
    whole.  Without labels all stay, with labels of one kind all are of that kind
    (``fit``).  An empty table gives an empty result.
    """
    net = train(docs, labels)
    mark = probability_as or "__probability"
    while probability_as is None and mark in docs.columns:
        mark += "_"
    scored = docs.withColumn(mark, probability(net, F.col("text"))).where(F.col(mark) >= threshold)
    return scored if probability_as else scored.drop(mark)
