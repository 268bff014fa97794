"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ncontent<|im_end|>\\n``; a conversation is its turns
end to end.  For a whole batch the lengths of all segments are computed first,
their cumulative sums are the offsets, and headers, contents and tails are then
scattered by index into one preallocated buffer, which becomes the Arrow column
as it is: no string is made for a turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell.llm.bytetext import utf8

OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARNED = "assistant"
FORMATTED = "conv_id long, text string, n_turns long, n_bytes long, loss_start array<long>, loss_stop array<long>"
_SCATTER = 1 << 22


def _fixed(out: np.ndarray, at: np.ndarray, piece: bytes) -> None:
    """``piece`` at every place of ``at``."""
    for k, byte in enumerate(piece):
        out[at + k] = byte


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Text i of (data, offsets) at ``at[i]``; indices for some megabytes at a time."""
    size = np.diff(offsets)
    shift = at - offsets[:-1]
    begin = 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + _SCATTER, side="right")) - 1)
        lo, hi = int(offsets[begin]), int(offsets[end])
        if end == begin + 1:
            out[lo + shift[begin] : hi + shift[begin]] = data[lo:hi]
        else:
            out[np.arange(lo, hi) + np.repeat(shift[begin:end], size[begin:end])] = data[lo:hi]
        begin = end


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray):
    """Bytes of all conversations end to end, their offsets, and (turn's conversation, start, stop) of the contents to learn.

    ``first`` has the n + 1 turn offsets of n conversations; starts and stops count
    bytes of their conversation, the end mark belongs to what is learned.
    """
    roles, role_at = utf8(role)
    texts, text_at = utf8(text)
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    size = n_role + n_text + len(OPEN) + len(MIDDLE) + len(CLOSE)
    turn = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(turn[-1]), np.uint8)
    at = turn[:-1]
    _fixed(out, at, OPEN)
    _scatter(out, at + len(OPEN), roles, role_at)
    body = at + len(OPEN) + n_role
    _fixed(out, body, MIDDLE)
    body = body + len(MIDDLE)
    _scatter(out, body, texts, text_at)
    _fixed(out, body + n_text, CLOSE)
    offsets = turn[first]
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mine = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.equal(role, LEARNED), False)))
    return out, offsets, (own[mine], body[mine] - offsets[own[mine]], turn[mine + 1] - 1 - offsets[own[mine]])


def _format(batches):
    """Rows come sorted by conversation; one that may go on in the next batch waits."""

    def give(table: pa.Table) -> pa.RecordBatch:
        conv = table["conv_id"].to_numpy()
        first = np.concatenate([np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])), [len(conv)]])
        role, text = (table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in ("role", "text"))
        out, offsets, (own, start, stop) = assemble(role, text, first)
        lists = np.searchsorted(own, np.arange(len(first))).astype(np.int32)
        made = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays(
            [pa.array(conv[first[:-1]]), made.cast(pa.string()), pa.array(np.diff(first)), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(lists, pa.array(start)), pa.ListArray.from_arrays(lists, pa.array(stop))],
            names=["conv_id", "text", "n_turns", "n_bytes", "loss_start", "loss_stop"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        last = int(np.searchsorted(conv, conv[-1]))  # the last conversation starts here
        if last or (held and held[-1].column("conv_id")[0].as_py() != conv[-1]):
            if done := [*held, batch.slice(0, last)] if last else held:
                yield give(pa.Table.from_batches(done))
            held = []
        held.append(batch.slice(last))
    if held:
        yield give(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, text, n_turns, n_bytes, loss_start, loss_stop), a row for each conversation.

    Turns stand in the order of ``turn``, those without one first; ties in the
    order of role, then text, nulls first; repeated rows are repeated turns.  A
    null role or text counts as empty.  Rows with a null conv_id belong to no
    conversation and are left out.  Contents are copied byte for byte.
    ``loss_start`` and ``loss_stop`` are the byte ranges of the assistant's contents
    with their end mark.  Other columns are ignored; an empty table gives an empty
    result.  Each conversation crosses the one shuffle once; nothing limits its
    length but that of a string (2 GB).
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)
