"""Words of whole Arrow batches as numpy arrays, without a Python object a word.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters; everything else separates.  As a regular expression:
``[0-9A-Za-z\\x{80}-\\x{10FFFF}]+``.  Only ASCII letters are folded to lower
case here; callers that want more pass a text through ``lower`` first.

A word of n bytes b_0, b_1, ... has the hash ``mix(n + sum(b_i * 256**(i % 8) *
P**(i // 8 + 1)))`` modulo 2**64, which SQL with 128-bit integers can compute too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

P = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    IS_WORD[_lo:_hi] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, P, dtype=np.uint64), out=out[1:])
    return out


_POW = _powers(64)
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * M1
        x ^= x >> np.uint64(27)
        x *= M2
        x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``start``, ``end`` (byte positions), ``hash``, and ``first``: the n + 1 word offsets of the texts."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        np.take(IS_WORD, data, out=inside[:n])
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        # a text's first byte starts a word of its own, whatever stands before it
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        glued = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
        at = np.flatnonzero(edge)
        if len(glued):
            at = np.sort(np.concatenate([at, glued, glued]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(FOLD[data] if fold else data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """Each round takes in eight bytes of all the words that are that long."""
        length = self.end - self.start
        out = length.astype(np.uint64)
        if not len(out):
            return out
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
        at, start, left, k = slice(None), self.start, length, 1
        with np.errstate(over="ignore"):
            while len(start):
                block = eights[start].reshape(-1).view(np.uint64)
                block &= _LOW[np.minimum(left, 8)]
                out[at] += block * (_POW[k] if k < len(_POW) else np.uint64(pow(int(P), k, 1 << 64)))
                more = np.flatnonzero(left > 8)
                at = more if isinstance(at, slice) else at[more]
                start, left, k = start[more] + 8, left[more] - 8, k + 1
        return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside one text, and the index of its first word."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(total, np.uint64)
        for i in range(n):
            acc = acc * P + hashes[i : i + total]
    whole = np.ones(total, dtype=bool)
    for c in range(1, n):  # runs that start c words before a text's end
        bad = first[1:] - c
        whole[bad[(bad >= 0) & (bad < total) & (bad >= first[:-1])]] = False
    at = np.flatnonzero(whole)
    return mix(acc[at]), at


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of whole rows with about ``most`` bytes of text each; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64))
    begin, done = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(size[end - 1])
