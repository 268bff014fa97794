"""Gradient-boosted trees in numpy: logistic loss, histograms of quantile bins, complete trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``cut`` (trees, 2**depth - 1), ``leaf`` (trees, 2**depth): log-odds are ``base`` plus one leaf of each tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray, part: int = 1 << 15) -> np.ndarray:
        out = np.full(len(x), self.base, np.float64)
        depth = int(np.log2(self.leaf.shape[1]))
        for lo in range(0, len(x), part):
            rows = np.ascontiguousarray(x[lo : lo + part])
            flat, width, n = rows.reshape(-1), rows.shape[1], len(rows)
            at = np.arange(n) * width
            for f, c, leaf in zip(self.feature, self.cut, self.leaf):
                node = np.zeros(n, np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat[at + f[node]] > c[node])
                out[lo : lo + n] += leaf[node - (leaf.size - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Forest:
    """Fit 0/1 labels; the same input gives the same forest."""
    n, width = x.shape
    y = y.astype(np.float64)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x > edges[b - 1]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, start = 1 << level, (1 << level) - 1
            best = np.full(count, 1e-9)
            pick, place = np.zeros(count, np.int64), np.full(count, -1)
            for f in range(width):
                key = (node - start) * bins + code[:, f]
                sg = np.cumsum(np.bincount(key, g, count * bins).reshape(count, bins), axis=1)
                sh = np.cumsum(np.bincount(key, h, count * bins).reshape(count, bins), axis=1)
                left, right = sg[:, :-1], sg[:, -1:] - sg[:, :-1]
                hl, hr = sh[:, :-1], sh[:, -1:] - sh[:, :-1]
                gain = left**2 / (hl + 1) + right**2 / (hr + 1) - sg[:, -1:] ** 2 / (sh[:, -1:] + 1)
                gain[(hl < least) | (hr < least)] = 0
                gain[:, len(edges[f]) :] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(count), b]
                better = top > best
                best[better], pick[better], place[better] = top[better], f, b[better]
            for k in range(count):
                feature[t, start + k] = pick[k]
                if place[k] >= 0:
                    cut[t, start + k] = edges[pick[k]][place[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        own = node - inner
        leaf[t] = -rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + 1)
        z += leaf[t, own]
    return Forest(feature, cut, leaf, base)
