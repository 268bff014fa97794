"""Token ids as Parquet list columns: encodings, row groups and pages under control.

``encode`` turns texts into ids of a public byte-level BPE.  Such a tokenizer never
joins what a single space between two characters that are no white space separates,
so that a batch is cut there, each distinct piece is tokenized once, and the ids of
all texts are gathered by offset; texts with a space beside other white space are
tokenized whole.

``write`` lays a table out for selective reads: ids in a list column with dictionary
encoding (a page of ids costs the bits of the ids that it has) or delta encoding,
row groups of a chosen size, pages of a chosen number of rows with an index of
their least and largest doc_id.  Rows of a file are sorted by doc_id, so that a
reader who asks for some doc_ids opens few pages, and one who asks for metadata
(the documents' other columns stand beside the ids) opens no page of ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lorewell.llm.bytetext import slices
from lorewell.shared import shared_path

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 512
TOKENS = "doc_id long, n_tokens int, tokens array<int>"
_KEPT = 600_000
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(maxsize=2)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file, which every executor must find at this path."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class Pieces:
    """Ids of the pieces that this process has seen, up to a number of them; a piece stands after a space."""

    def __init__(self, ranks: str):
        coder = encoding(ranks)
        self.encode = coder.encode_ordinary
        self.bytes_of = np.zeros(coder.n_vocab, np.int64)
        for raw in coder.token_byte_values():
            self.bytes_of[coder.encode_single_token(raw)] = len(raw)
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.end = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, words: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin in them, how many) for distinct ``words``, none of which begins or ends with white space.

        New words that occur more than once (``times``) are kept for later batches.
        """
        number = np.asarray(pc.fill_null(pc.index_in(words, self.known), -1)).astype(np.int64)
        new = np.flatnonzero(number < 0)
        begin, n = self.end[number], self.end[number + 1] - self.end[number]
        if not len(new):
            return self.ids, begin, n
        added = words.take(pa.array(new))
        # the tokens of all of them at once: a token's bytes tell to which piece it belongs
        ids = np.array(self.encode(" " + " ".join(added.to_pylist())), np.int32)
        ends = np.cumsum(np.asarray(pc.binary_length(added)).astype(np.int64) + 1)
        cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        size = np.diff(cut, prepend=0)
        begin[new], n[new] = len(self.ids) + cut - size, size
        found = np.concatenate([self.ids, ids])
        often = times[new] > 1
        if len(self.known) + often.sum() > _KEPT:
            self.forget()
        self.ids = np.concatenate([self.ids, ids[np.repeat(often, size)]])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(size[often])])
        self.known = pa.concat_arrays([self.known, added.filter(pa.array(often))])
        return found, begin, n


@lru_cache(maxsize=2)
def pieces_of(ranks: str) -> Pieces:
    """One for a process, which outlives tasks."""
    return Pieces(ranks)


def encode(column: pa.Array, seen: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and their n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    spaced = pc.match_substring_regex(column, rf"\A | \z|{_WS} | {_WS}")
    lists = pc.split_pattern(pc.if_else(spaced, "", column), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    pieces = pc.list_flatten(lists)
    offsets = offsets - offsets[0]
    begins = np.zeros(len(pieces), bool)
    begins[offsets[:-1]] = True  # a text's first piece has no space before it; a text has at least one piece
    words = pieces.filter(pa.array(~begins)).dictionary_encode()
    which = np.asarray(words.indices)
    ids, begin, size = seen.look_up(words.dictionary, np.bincount(which, minlength=len(words.dictionary)))
    first = [seen.encode(t) for t in pc.if_else(spaced, column, pieces.take(pa.array(offsets[:-1]))).to_pylist()]
    n_first = np.fromiter(map(len, first), np.int64, len(first))
    n, source = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
    n[~begins], source[~begins] = size[which], begin[which]
    n[begins], source[begins] = n_first, len(ids) + np.cumsum(n_first) - n_first
    end = np.cumsum(n)
    all_ids = np.concatenate([ids, np.fromiter((t for x in first for t in x), np.int32, int(n_first.sum()))])
    out = all_ids[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(source - (end - n), n)]
    return out, np.concatenate([[0], end])[offsets]


def _with_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the columns that are written beside the ids."""
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_tokens", "tokens")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)


def tokenize(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, tokens, and the other columns of ``docs`` but text) of every row of ``docs``.

    A null or empty text has no tokens (an empty list); a null doc_id stays null;
    repeated rows are each tokenized; texts of any length are tokenized whole.
    Columns of ``docs`` named n_tokens or tokens are left out.  An empty table gives
    an empty result.  The ids are those that the tokenizer gives for the whole
    text, and decode to it byte for byte.
    """

    def run(batches):
        seen = pieces_of(ranks)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids, offsets = encode(batch.column("text"), seen)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                rest = batch.schema.names[2:]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int32)), lists, *(batch.column(c) for c in rest)], names=["doc_id", "n_tokens", "tokens", *rest])

    rows = _with_ids(docs)
    schema = StructType([*_parse(TOKENS), *rows.schema.fields[2:]])
    return rows.mapInArrow(run, schema)


def _parse(ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


def write(tokens: DataFrame, path: str, encoding_of_ids: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Parquet at ``path`` with page indexes; ``encoding_of_ids`` is "dictionary" or "delta" (which needs pages of version 2).

    Nothing is shuffled: rows keep their partition and are sorted by doc_id inside it.
    """
    if encoding_of_ids not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding_of_ids!r}")
    delta = encoding_of_ids == "delta"
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2" if delta else "v1")
        .option("parquet.enable.dictionary", "false" if delta else "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def write_documents(docs: DataFrame, path: str, ranks: str = RANKS, **layout) -> None:
    """Tokenize ``docs`` and write them at ``path``, each file sorted by doc_id (see ``tokenize`` and ``write``)."""
    write(tokenize(_with_ids(docs).sortWithinPartitions("doc_id"), ranks), path, **layout)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """Chosen columns of the documents from ``first`` to ``last`` (inclusive): the bounds reach the scan, which skips row groups and pages by their index."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out.select(*columns)


def token_output(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The written table (see ``tokenize``), read back from the shared folder."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_documents(docs, path, ranks)
    return read(spark, path)
