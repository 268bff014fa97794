"""Personal data in texts, found by the tagger of ``tagger`` and replaced.

Every byte of every text goes through the network, in windows of ``WINDOW`` bytes
that overlap by 2 * ``CONTEXT``.  A byte's scores come from the window in which it
stands farther from the edge; over these scores the CRF decodes each text as a
whole, so that no window has labels of its own.  Runs of one label make a span,
which grows to the edges of the words that it cuts.  A span that is a list of whole
items of its kind is split into these; one that isn't stays whole, so that no part
of it is lost.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm import tagger
from lorewell.llm.bytetext import utf8
from lorewell.llm.spans import KINDS

STRIDE = tagger.WINDOW - 2 * tagger.CONTEXT
WEIGHTS = os.path.join(os.path.dirname(__file__), "tagger.npz")
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: What a piece of a list has at least.
_SHAPE = {
    1: re.compile(rb"[^@\s]+@[^@\s]+\.[^@\s]+"),
    2: re.compile(rb"(?:\D*\d){6}"),
    3: re.compile(rb"\d+\.\d+\.\d+\.\d+|(?:[0-9a-fA-F]*:){2}"),
    4: re.compile(rb"(?:\D*\d){13}"),
    5: re.compile(rb"\S{8}"),
    6: re.compile(rb"(?:\D*\d){6}"),
}
# one item of each kind, and what may stand between two of them
_ITEM = {
    1: rb"[\w.%+\-\x80-\xff]+@[\w.\-\x80-\xff]+\.[\w\-\x80-\xff]+",
    2: rb"\+?\d{1,3}[ .-]?\(\d{2,4}\) ?\d{3,4}[ .-]?\d{4}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\d{1,4}){2,5}|\+\d{2} \d{3} \d{7}|\+\d{11,14}|\d{3}([ .-])\d{3}[ .-]\d{4}|\d{7,15}|\d{3}[ .-]\d{4}",
    3: rb"\d+\.\d+\.\d+\.\d+|[0-9a-fA-F:]*:[0-9a-fA-F:]+",
    4: rb"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3\d{3}([ -]?)\d{6}\2\d{5}|\d{13,19}",
    5: rb"[\w\-+/.]{16,}",
    6: rb"\d{3}-\d{2}-\d{4}|[A-Z]{1,2}\d{6,10}|[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
}
_BETWEEN = {1: rb"[^\w.%+\-@\x80-\xff]{1,3}", 2: rb"[\s,;|/]{1,3}", 3: rb"[^\w.:]{1,3}", 4: rb"[\s,;|/]{1,3}", 5: rb"[\s,;|\"']{1,3}", 6: rb"[\s,;|/]{1,3}"}
_NEXT = {k: re.compile(rb"(?:" + x + rb")(?=" + _BETWEEN[k] + rb"|\Z)") for k, x in _ITEM.items()}
_GAP = {k: re.compile(x) for k, x in _BETWEEN.items()}
_LINE = re.compile(rb"[^\s,;|](?:[^\r\n,;|\t]*[^\s,;|])?")


def load() -> dict[str, np.ndarray]:
    """The trained weights that stand beside this file; ``tagger.train`` makes them anew."""
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def emissions(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, texts: int = 1024) -> np.ndarray:
    """Scores (LABELS, bytes) of every byte of texts that lie end to end."""
    out = np.zeros((tagger.LABELS, len(data)), np.float32)
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - 2 * tagger.CONTEXT) // STRIDE)) * (size > 0)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][doc] + k * STRIDE
    stop = np.minimum(start + tagger.WINDOW, offsets[1:][doc])
    own_start = np.where(k == 0, start, start + tagger.CONTEXT)
    own_stop = np.where(k == n[doc] - 1, stop, stop - tagger.CONTEXT)
    order = np.argsort(stop - start, kind="stable")  # windows of like length run together
    for lo in range(0, len(order), texts):
        some = order[lo : lo + texts]
        a, b = start[some], stop[some]
        at = a[None] + np.arange(int((b - a).max()))[:, None]
        block = np.where(at < b, data[np.minimum(at, len(data) - 1)], np.uint8(10))  # filled up with line ends
        e = tagger.emissions(p, block, b - a)
        for c, w in enumerate(some):
            out[:, own_start[w] : own_stop[w]] = e[own_start[w] - start[w] : own_stop[w] - start[w], :, c].T
    return out


def label(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A label for every byte of texts that lie end to end: for each text the best path over the whole of it."""
    return tagger.decode(p, emissions(p, data, offsets), offsets)


def items(kind: int, value: bytes) -> list[tuple[int, int]]:
    """(start, end) of the items that ``value`` is a list of; all of it if it isn't one."""
    shape = _SHAPE[kind]
    lines = [m.span() for m in _LINE.finditer(value)]
    if len(lines) > 1 and all(shape.search(value[i:j]) for i, j in lines):
        return [(i + k, i + m) for i, j in lines for k, m in items(kind, value[i:j])]
    found, at = [], 0
    while m := _NEXT[kind].match(value, at):
        found.append(m.span())
        gap = _GAP[kind].match(value, m.end())
        at = gap.end() if gap else m.end()
        if not gap or at == len(value):
            break
    whole = at == len(value) and len(found) > 1 and all(shape.search(value[i:j]) for i, j in found)
    return found if whole else [(0, len(value))]


def spans(labels: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in byte positions of ``data``, sorted and disjoint."""
    if not labels.any():
        return []
    padded = np.concatenate([[0], labels, [0]])
    change = padded[1:] != padded[:-1]
    change[offsets] = True  # no span crosses texts
    edge = np.flatnonzero(change)
    grown = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        kind = int(labels[a])
        d = int(np.searchsorted(offsets, a, side="right")) - 1
        if kind == 0:
            continue
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        while a > lo and _WORD[data[a - 1]] and _WORD[data[a]]:
            a -= 1
        while b < hi and _WORD[data[b]] and _WORD[data[b - 1]]:
            b += 1
        while b > a and data[b - 1] in b" \t\r\n.,;":
            b -= 1
        while a < b and data[a] in b" \t\r\n.,;":
            a += 1
        if b > a:
            grown.append((a, b, kind, d))
    merged: list[list[int]] = []
    for a, b, kind, d in sorted(grown):
        last = merged[-1] if merged else None
        near = last and last[3] == d and (a < last[1] or (kind == last[2] and a - last[1] <= 1))
        if near:
            if b - a > last[1] - last[0]:
                last[2] = kind
            last[1] = max(last[1], b)
        else:
            merged.append([a, b, kind, d])
    return [(a + i, a + j, kind) for a, b, kind, _ in merged for i, j in items(kind, data[a:b].tobytes())]


def find(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    return spans(label(p, data, offsets), data, offsets)


def _runs(column: pa.Array, most: int = 2 << 20):
    data, offsets = utf8(column)
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def redact(p: dict[str, np.ndarray], column: pa.Array) -> pa.Array:
    """Texts with [EMAIL], [PHONE], [IP], [CARD], [SECRET] or [ID] in place of each span; texts without any are untouched, null stays null."""
    out: list[bytes] = []
    for data, offsets in _runs(column):
        raw, found, i = data.tobytes(), find(p, data, offsets), 0
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            parts, at = [], a
            while i < len(found) and found[i][0] < b:
                s, e, kind = found[i]
                parts += [raw[at:s], b"[" + KINDS[kind].encode() + b"]"]
                at, i = e, i + 1
            out.append(b"".join(parts) + raw[at:b] if parts else raw[a:b])
    made = pa.array(out, pa.binary()).cast(pa.string())
    return pa.compute.if_else(pa.compute.is_valid(column), made, pa.scalar(None, pa.string())) if column.null_count else made


def redacted(text: Column) -> Column:
    p = load()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return redact(p, column)

    return run(text)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all rows and other columns stay as they are.

    ``n_chars``, where there is one, is counted anew in the rows whose text
    changed.  Null and empty texts stay; repeated rows are treated alike.
    """
    new = "__text"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, redacted(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new) != F.col("text"), F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).drop(new)


SPANS = "doc_id long, kind string, start int, stop int, value string"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, stop, value), a row for each span; start and stop count characters.

    Null doc_ids, and null and empty texts, give no rows; a repeated row gives
    its spans again, and a text the same spans whatever stands beside it.  Very long
    texts are read whole.  An empty table gives an empty result; other columns are
    ignored.
    """
    p = load()

    def run(batches):
        for batch in batches:
            row = 0
            rows, kinds, starts, stops, values = [], [], [], [], []
            for data, offsets in _runs(batch.column("text")):
                raw = data.tobytes()
                for s, e, kind in find(p, data, offsets):
                    d = int(np.searchsorted(offsets, s, side="right")) - 1
                    begin = len(raw[offsets[d] : s].decode())
                    value = raw[s:e].decode()
                    rows.append(row + d)
                    kinds.append(KINDS[kind])
                    starts.append(begin)
                    stops.append(begin + len(value))
                    values.append(value)
                row += len(offsets) - 1
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(values, pa.string())], names=["doc_id", "kind", "start", "stop", "value"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)
