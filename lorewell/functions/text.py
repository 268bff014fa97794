"""Text analysis as column expressions; Python runs only where no expression can."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

#: English words that carry no meaning of their own, in alphabetical order.
STOP_WORDS = tuple(
    """a after an and are as at be been before being both but by can could did do does during either for from
    had has have he her him his i in into is it its may me might my neither nor not of on or our shall she should
    so that the their them these they this those through to was we were will with would yet you your""".split()
)
#: Characters that NFKC leaves alone in any company of each other; a text of these needs no Python.
_STABLE = "\\x00-\\x7F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0391-\\u03A1\\u03A3-\\u03CE\\u0400-\\u045F\\u2013-\\u2016\\u2018-\\u201E\\u20AC\\u3001\\u3002\\u3041-\\u3096\\u30A1-\\u30FA\\u30FC\\u4E00-\\u9FA5"


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalize(text: Column, nfkc: bool = True) -> Column:
    """NFKC, then lower case.  Only texts with a character that NFKC may change travel to Python."""
    if nfkc:
        # bytes and characters are as many where all is ASCII; of other texts only what isn't ASCII is looked at
        doubtful = (F.octet_length(text) != F.char_length(text)) & F.regexp_replace(text, "[\\x00-\\x7F]+", "").rlike(f"[^{_STABLE}]")
        text = F.coalesce(_nfkc(F.when(doubtful, text)), text)
    return F.lower(text)


def split_words(text: Column) -> Column:
    """Maximal runs of letters and decimal digits."""
    return F.filter(F.split(text, "[^\\p{L}\\p{Nd}]+"), lambda w: w != "")


def tokens_en(text: Column, nfkc: bool = True) -> Column:
    """Words in lower case without stop words; repeated words stay."""
    # a list of literals becomes a hash set; the empty string goes with it
    return F.filter(F.split(normalize(text, nfkc), "[^\\p{L}\\p{Nd}]+"), lambda w: ~w.isin("", *STOP_WORDS))


def tokens_bigram(text: Column, nfkc: bool = True) -> Column:
    """Neighbouring pairs of characters, but for pairs with a space or line end; none for a text of fewer than two."""
    chars = F.regexp_extract_all(normalize(text, nfkc), F.lit("(?s)."), F.lit(0))
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.filter(pairs, lambda p: p.isNotNull() & ~p.contains(" ") & ~p.contains("\n"))


def tokens_ja(tokenizer: Callable[[str], list[str]] | None = None) -> Callable[[Column], Column]:
    """Analyzer from a morphological tokenizer (text to surface forms); without one, pairs of characters stand in."""
    if tokenizer is None:
        return tokens_bigram

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else tokenizer(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return lambda text: run(normalize(text))


ANALYZERS: dict[str, Callable[[Column], Column]] = {"en": tokens_en, "bigram": tokens_bigram, "ja": tokens_ja()}


def analyzer(name: str) -> Callable[[Column], Column]:
    if name not in ANALYZERS:
        raise ValueError(f"unknown analyzer {name!r}; known: {', '.join(sorted(ANALYZERS))}")
    return ANALYZERS[name]


def token_estimate(text: Column) -> Column:
    """One token a character."""
    return F.char_length(text)


SENTENCE = "(?s)[^.。!?\\n]*[.。!?\\n]|[^.。!?\\n]+"


def sentences(text: Column) -> Column:
    """Cut after each full stop, question or exclamation mark and line end, which stay."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


_SENTENCE = re.compile(SENTENCE.replace("\\n", "\n"))


def chunk(text: str, most: int = 512, overlap: int = 64) -> list[str]:
    """Greedy packing of sentences into chunks of ``most`` characters; each next chunk begins with the last ``3 * overlap`` of the one before."""
    most = most if most > 0 else 512
    if len(text) <= most:
        return [text]
    done, now = [], ""
    for s in _SENTENCE.findall(text):
        if now and len(now) + len(s) > most:
            done.append(now.strip())
            now = now[max(0, len(now) - 3 * overlap) :] if overlap > 0 else ""
        now += s
    return [*done, now.strip()] if now else done


def chunks(text: Column, most: int = 512, overlap: int = 64) -> Column:
    """array<struct<ord, text>>; the fold over sentences runs on Arrow batches."""

    @F.arrow_udf("array<struct<ord:int,text:string>>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("ord", pa.int32()), ("text", pa.string())]))
        return pa.array([None if t is None else [{"ord": i, "text": c} for i, c in enumerate(chunk(t, most, overlap))] for t in texts.to_pylist()], kind)

    return run(text)


CODE_STARTS = r"^func\s+|^def\s+|^class\s+|^\s*(public|private|protected)\s+|^(export\s+)?(function|const|let|var)\s+"


def code_chunks(files: DataFrame, text: str = "text", key: str = "doc_id", most: int = 50) -> DataFrame:
    """(key, ord, text): source code cut where a definition starts, by blocks of ``most`` lines where none or one does, whole if it is short.

    What stands before the first definition is a chunk of its own; blank chunks go.
    """
    lines = files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    per = W.partitionBy(key)
    marked = lines.withColumn("start", F.col("line").rlike(CODE_STARTS).cast("int")).select("*", F.sum("start").over(per).alias("starts"), F.count("*").over(per).alias("lines"))
    running = F.sum("start").over(per.orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    part = F.when(F.col("lines") <= most, F.lit(0)).when(F.col("starts") > 1, running).otherwise(F.floor(F.col("n") / most))
    joined = marked.withColumn("part", part).groupBy(key, "part", "lines").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    kept = joined.where(F.col("text").rlike("\\S") | (F.col("lines") <= most))
    return kept.select(key, (F.row_number().over(W.partitionBy(key).orderBy("part")) - 1).alias("ord"), "text")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(tags, ","), lambda t: F.btrim(t, F.lit(" \t"))), lambda t: t != "")


def truncate_for_prompt(text: Column, most: int = 2000) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def preview(text: Column, most: int = 200) -> Column:
    """The first characters for listings (200 for search results, 80 for lists)."""
    return truncate_for_prompt(text, most)


def human_bytes(n: Column) -> Column:
    """1024-based size with one decimal, ties to even."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out
