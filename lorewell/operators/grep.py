"""Pattern scans over texts.

One dialect throughout: expressions are checked, matched and located by the
JVM's engine, which knows Unicode classes (``\\p{L}``), ``\\z`` and the rest of what
a linear-time engine accepts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorewell.operators.running import running_sum

SPANS = "array<struct<start:long,stop:long>>"
_OPEN, _SHUT = "\ufdd0", "\ufdd1"  # code points that Unicode keeps out of texts


def _valid(pattern: str) -> bool:
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def condition(text: Column, pattern: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    """Whether a text matches; an empty pattern and an invalid expression match nothing."""
    if not pattern or (regex and not _valid(pattern)):
        return F.lit(False)
    if regex:
        return text.rlike(pattern if case_sensitive else f"(?iu){pattern}")
    return text.contains(pattern) if case_sensitive else F.lower(text).contains(pattern.lower())


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.octet_length(p))


def _literal_pieces(text: Column, pattern: str) -> Column:
    """Lengths in bytes of the pieces of a text that is cut where a match begins; matches may overlap."""
    quoted = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.quote(pattern)
    sizes = _lengths(F.split(text, f"(?={quoted})", -1))
    return F.when(text.startswith(pattern), F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes)  # no empty piece stands before a match at the start


def _regex_pieces(text: Column, pattern: str) -> Column:
    """Lengths in bytes of what stands, in turn, before a match and in it, and of the rest."""
    clean = F.translate(text, _OPEN + _SHUT, "\ufffd\ufffd")  # of as many bytes
    whole = r"(?![\x{DC00}-\x{DFFF}])"  # no empty match inside a character beyond 16 bits
    return _lengths(F.split(F.regexp_replace(clean, whole + pattern, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1))


def _span_lists(counts: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"]))


def _split(sizes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of lengths: how many each has, the end of each piece in its text, and its place in its list."""
    counts = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    first = np.cumsum(counts) - counts
    before = np.concatenate([[0], flat])[first]
    return counts, flat - np.repeat(before, counts), np.arange(len(flat)) - np.repeat(first, counts)


def literal_spans(sizes: pa.ListArray, width: int) -> pa.Array:
    """Byte offsets of matches of ``width`` bytes, which begin where all pieces but the last end."""
    counts, ends, place = _split(sizes)
    start = ends[place < np.repeat(counts, counts) - 1]
    return _span_lists(counts - 1, start, start + width)


def regex_spans(sizes: pa.ListArray) -> pa.Array:
    """Byte offsets of the pieces at odd places; an empty match right after another is none."""
    counts, ends, place = _split(sizes)
    at = np.flatnonzero(place % 2)
    start, stop = ends[at - 1], ends[at]
    kept = (stop > start) | (place[at] == 1) | (start > ends[at - 2])
    row = np.repeat(np.arange(len(counts)), counts)[at[kept]]
    return _span_lists(np.bincount(row, minlength=len(counts)), start[kept], stop[kept])


def grep(docs: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans) of the texts that match, as byte offsets: literal matches may overlap, those of an expression don't; a literal without regard to case counts in the lower-cased text.

    Filter, matches and lengths are expressions; no text travels to Python, which
    sums up the lengths between matches.
    """
    hits = docs.where(condition(F.col(text), pattern, regex, case_sensitive))
    if not pattern or (regex and not _valid(pattern)):
        return hits.select(F.col(key), F.array().cast(SPANS).alias("spans"))
    if regex:
        sizes = _regex_pieces(F.col(text), f"(?:{pattern})" if case_sensitive else f"(?iu)(?:{pattern})")
    else:
        pattern = pattern if case_sensitive else pattern.lower()
        sizes = _literal_pieces(F.col(text) if case_sensitive else F.lower(text), pattern)
    width = len(pattern.encode())

    @F.arrow_udf(SPANS)
    def run(sizes: pa.Array) -> pa.Array:
        return regex_spans(sizes) if regex else literal_spans(sizes, width)

    return hits.select(F.col(key), run(sizes).alias("spans"))


def within_budget(docs: DataFrame, most_bytes: int, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, Column]:
    """The texts, in the order of key, whose bytes together with all before them stay within the budget; with their running total as ``scanned``."""
    summed = running_sum(docs.where(F.col(text).isNotNull()), [key], F.octet_length(text).cast("long"), "scanned")
    return summed.where(F.col("scanned") <= most_bytes), F.col("scanned")
