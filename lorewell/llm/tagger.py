"""Character-level bidirectional LSTM with a CRF on top, in numpy, over the bytes of UTF-8.

Gates use piecewise linear activations (``clip(x, 0, 1)`` and ``clip(x, -1, 1)``),
which cost a tenth of exponentials.  Arrays lie gate by gate, (units, texts), so
that each step works on contiguous rows.  CRF transitions from a label to itself
are 0 and the others are at most 0, which lets ``decode`` tell the places where the
best path of a whole text is certain to be 0.
"""

from __future__ import annotations

import numpy as np

from lorewell.llm.spans import KINDS, sample

HIDDEN, EMBED, LABELS = 12, 8, len(KINDS)
WINDOW, CONTEXT = 384, 32


def init(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {"emb": rng.normal(0, 0.5, (EMBED, 256))}
    for way in "fb":
        w = rng.normal(0, 0.3, (4 * HIDDEN, HIDDEN + EMBED + 1))
        w[:, -1] = np.repeat([0.5, 0.9, 0.5, 0.0], HIDDEN)  # input, forget, output, candidate
        out["w" + way] = w
    out["out"] = rng.normal(0, 0.3, (LABELS, 2 * HIDDEN + 1))
    out["out"][:, -1] = 0
    out["out"][0, -1] = 1
    out["trans"] = np.full((LABELS, LABELS), -1.0) + np.eye(LABELS)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _run(w: np.ndarray, emb: np.ndarray, data: np.ndarray, keep: bool = False, states: np.ndarray | None = None, size: np.ndarray | None = None):
    """One direction over data (steps, texts): states (steps, HIDDEN, texts), and what backpropagation needs.

    ``size``, for the way back, has the ascending lengths of the texts, which begin
    after their filling: a text starts with the state of one that stands alone.
    """
    steps, n = data.shape
    H = HIDDEN
    states = np.empty((steps, H, n), np.float32) if states is None else states
    x = np.ones((H + EMBED + 1, n), np.float32)
    x[:H] = 0
    c = np.zeros((H, n), np.float32)
    z = np.empty((4 * H, n), np.float32)
    kept = []
    g = np.empty_like(z)
    tmp = np.empty_like(c)
    for t in range(steps):
        if size is not None:
            a, b = np.searchsorted(size, [steps - t, steps - t + 1])
            x[:H, a:b] = c[:, a:b] = 0
        np.take(emb, data[t], axis=1, out=x[H : H + EMBED], mode="clip")
        np.matmul(w, x, out=z)
        np.clip(z[: 3 * H], 0, 1, out=g[: 3 * H])
        np.clip(z[3 * H :], -1, 1, out=g[3 * H :])
        if keep:
            before = c.copy()
        np.multiply(g[H : 2 * H], c, out=c)
        np.multiply(g[:H], g[3 * H :], out=tmp)
        c += tmp
        np.clip(c, -1, 1, out=tmp)
        np.multiply(g[2 * H : 3 * H], tmp, out=states[t])
        if keep:
            kept.append((x.copy(), z.copy(), g.copy(), before, c.copy(), tmp.copy()))
        x[:H] = states[t]
    return states, kept


def _back(w, kept, data, d_states, d_emb):
    H, n = HIDDEN, data.shape[1]
    d_w, d_h, d_c = np.zeros_like(w), np.zeros((H, n), np.float32), np.zeros((H, n), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        x, z, g, before, c, th = kept[t]
        d_h += d_states[t]
        d_c += d_h * g[2 * H : 3 * H] * (np.abs(c) < 1)
        d_z = np.empty_like(z)
        d_z[:H] = d_c * g[3 * H :]
        d_z[H : 2 * H] = d_c * before
        d_z[2 * H : 3 * H] = d_h * th
        d_z[3 * H :] = d_c * g[:H]
        # a saturated gate passes a little gradient, lest it never opens again
        d_z[: 3 * H] *= np.where((z[: 3 * H] > 0) & (z[: 3 * H] < 1), 1, 0.05)
        d_z[3 * H :] *= np.where(np.abs(z[3 * H :]) < 1, 1, 0.05)
        d_w += d_z @ x.T
        d_x = w.T @ d_z
        for e in range(EMBED):
            d_emb[e] += np.bincount(data[t], d_x[H + e], 256)
        d_c = d_c * g[H : 2 * H]
        d_h = d_x[:H]
    return d_w


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def loss_and_gradient(p, data, label):
    """Mean negative log-likelihood a text, and gradients; data and label (steps, texts)."""
    steps, n = data.shape
    H = HIDDEN
    fw, kf = _run(p["wf"], p["emb"], data, True)
    bw, kb = _run(p["wb"], p["emb"], data[::-1], True)
    both = np.concatenate([fw, bw[::-1], np.ones((steps, 1, n), np.float32)], axis=1)
    e = np.einsum("lh,thn->tln", p["out"], both)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    tr = p["trans"][:, :, None]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, None] + tr, 0) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(tr + (e[t + 1] + beta[t + 1])[None], 1)
    total = _lse(alpha[-1], 0)
    at = np.arange(n)
    gold = sum(e[t, label[t], at] for t in range(steps)) + sum(p["trans"][label[t - 1], label[t]] for t in range(1, steps))
    d_e = np.exp(alpha + beta - total)
    d_trans = np.zeros_like(p["trans"])
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, None] + tr + (e[t] + beta[t])[None] - total)
        d_trans += pair.sum(axis=2)
        np.add.at(d_trans, (label[t - 1], label[t]), -1)
    for t in range(steps):
        d_e[t, label[t], at] -= 1
    grad = {"trans": d_trans, "out": np.einsum("tln,thn->lh", d_e, both)}
    d_both = np.einsum("lh,tln->thn", p["out"], d_e)
    d_emb = np.zeros(p["emb"].shape)
    grad["wf"] = _back(p["wf"], kf, data, d_both[:, :H], d_emb)
    grad["wb"] = _back(p["wb"], kb, data[::-1], d_both[::-1, H : 2 * H], d_emb)
    grad["emb"] = d_emb
    return float((total - gold).mean()), {k: (v / n).astype(np.float32) for k, v in grad.items()}


def train(steps: int = 4500, texts: int = 96, length: int = 128, pool: int = 8000, seed: int = 7, rate: float = 0.012, log=None) -> dict[str, np.ndarray]:
    """Adam on random pieces of made-up texts; the same seed gives the same weights."""
    rng, p = np.random.default_rng(seed), init(seed)
    whole = [np.frombuffer(a + b, np.uint8).reshape(2, -1) for a, b in sample(rng, pool, 6 * length)]
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        made = np.stack([whole[k][:, at : at + length] for k, at in zip(rng.integers(0, pool, texts), rng.integers(0, 5 * length, texts))], axis=2)
        data, label = made[0], made[1].astype(np.int64)
        loss, grad = loss_and_gradient(p, data, label)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grad.values())))
        now = rate * min(1, step / 50) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for k, g in grad.items():
            g = g * min(1, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p[k] -= (now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        np.minimum(p["trans"], 0, out=p["trans"])
        np.fill_diagonal(p["trans"], 0)
        if log and step % 50 == 0:
            log(step, loss)
    return p


def emissions(p, data: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Scores (steps, LABELS, texts) of data (steps, texts), in which a text may be shorter (``size``, ascending) and filled up."""
    steps, n = data.shape
    both = np.ones((steps, 2 * HIDDEN + 1, n), np.float32)
    _run(p["wf"], p["emb"], data, states=both[:, :HIDDEN])
    _run(p["wb"], p["emb"], data[::-1], states=both[::-1, HIDDEN : 2 * HIDDEN], size=size)
    return np.matmul(p["out"], both)


def viterbi(p, e: np.ndarray) -> np.ndarray:
    """Best labels (steps, texts)."""
    steps, _, n = e.shape
    score, back = e[0].copy(), np.empty((steps, LABELS, n), np.uint8)
    for t in range(1, steps):
        to = score[:, None] + p["trans"][:, :, None]
        back[t] = to.argmax(axis=0)
        score = to.max(axis=0) + e[t]
    out, at = np.empty((steps, n), np.uint8), np.arange(n)
    out[-1] = score.argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, out[t], at]
    return out


def _doubtful(p, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which the best path of a text may have another label than 0; e (LABELS, bytes).

    A run of other labels gains at most the sum of its best emissions over those of
    label 0, and pays to begin and to end inside the text.  Where no run that
    covers a place can gain more than it pays, the best path has 0.
    """
    gain = (e[1:].max(axis=0) - e[0]).astype(np.float64)
    begin, end = float(p["trans"][0, 1:].max()), float(p["trans"][1:, 0].max())
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = np.unique(offsets[:-1][np.diff(offsets) > 0]), np.unique(offsets[1:][np.diff(offsets) > 0]) - 1
    c = np.concatenate([[0.0], np.cumsum(gain)])
    before = c[offsets[:-1]][own]  # sums count from the text's first byte
    after, c = c[1:] - before, c[:-1] - before
    apart = own * (np.abs(after).max() + np.abs(gain).max() + abs(begin) + abs(end) + 1) * 2
    left = begin - c
    left[first] -= begin
    left = np.maximum.accumulate(left + apart) - apart
    right = after + end
    right[last] -= end
    right = np.maximum.accumulate((right - apart)[::-1])[::-1] + apart
    return left + right > -0.01  # rounding errors make a place doubtful, not wrong


def decode(p, e: np.ndarray, offsets: np.ndarray, lanes: int = 8192) -> np.ndarray:
    """Labels of all bytes: for each text the best path over the whole of it; e (LABELS, bytes), texts end to end.

    Doubtful stretches are decoded by themselves, many at once: what stands beside
    them is label 0 for certain, which is what the whole path would have there.
    """
    out = np.zeros(e.shape[1], np.uint8)
    if not len(out):
        return out
    some = np.concatenate([[False], _doubtful(p, e, offsets), [False]])
    change = some[1:] != some[:-1]
    inner = offsets[1:-1]
    change[inner] |= some[1:][inner] & some[:-1][inner]  # a stretch ends with its text
    edge = np.flatnonzero(change)
    inside = some[1:][edge[:-1]]
    start, stop = edge[:-1][inside], edge[1:][inside]
    order = np.argsort(start - stop, kind="stable")  # the longest first
    at_start, at_end = np.zeros(len(out) + 1, bool), np.zeros(len(out) + 1, bool)
    at_start[offsets[:-1]] = at_end[offsets[1:]] = True
    trans = p["trans"]
    for lo in range(0, len(order), lanes):
        a, b = start[order[lo : lo + lanes]], stop[order[lo : lo + lanes]]
        size = b - a
        score = e[:, a] + np.where(at_start[a], 0, trans[0][:, None])
        final = np.where(at_end[b], 0, trans[:, 0][:, None])
        back = []
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
            to = score[:, None, :n] + trans[:, :, None]
            back.append(to.argmax(axis=0).astype(np.uint8))
            score[:, :n] = to.max(axis=0) + e[:, a[:n] + t]
        now = (score + final).argmax(axis=0).astype(np.uint8)
        out[b - 1] = now
        for t in range(len(back), 0, -1):
            n = back[t - 1].shape[1]
            now[:n] = back[t - 1][now[:n], np.arange(n)]
            out[a[:n] + t - 1] = now[:n]
    return out


if __name__ == "__main__":
    import os
    import sys

    out = sys.argv[1] if len(sys.argv) > 1 else os.path.join(os.path.dirname(__file__), "tagger.npz")
    np.savez(out, **train(log=print))
