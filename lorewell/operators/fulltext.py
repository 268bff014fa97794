"""Inverted index and BM25.

Two ways to search.  ``bm25`` scans texts once: occurrences of each query term are
counted inside the row, so that nothing is exploded or shuffled; what is kept of a
document is its length and these counts.  ``search_index`` reads a stored index,
where the postings of a term stand together, so that a query reads few pages.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorewell.functions import scores, text as T
from lorewell.shared import cut


def tokens(docs: DataFrame, analyzer: str = "en", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tokens)."""
    return docs.select(key, T.analyzer(analyzer)(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def exploded(tokens_: DataFrame, *keep: str) -> DataFrame:
    """(keep, term), a row for each token.

    The outer form keeps the optimizer from adding a filter on the array's size
    under it, which would tokenize every text twice.
    """
    return tokens_.select(*keep, F.explode_outer("tokens").alias("term")).where("term is not null")


def counted(tokens_: DataFrame, *keep: str) -> DataFrame:
    """(keep, counts): array<struct<term,tf>> of each row's own tokens.

    Words are counted inside the row, in the order of their sorting, so that no task
    holds a table of pairs of terms and documents.
    """
    at = lambda i: F.get("__s", i)
    ordered = tokens_.select(*keep, F.sort_array("tokens").alias("__s"))
    # a run of equal words begins where the word before is another; the end counts as one more
    starts = F.filter(F.sequence(F.lit(0), F.size("__s")), lambda i: ~at(i).eqNullSafe(at(i - 1)))
    runs = ordered.select(*keep, "__s", starts.alias("__at"))
    each = F.transform(F.slice("__at", 1, F.greatest(F.size("__at") - 1, F.lit(0))), lambda i, k: F.struct(at(i).alias("term"), (F.get("__at", k + 1) - i).cast("long").alias("tf")))
    return runs.select(*keep, each.alias("counts"))


def postings(docs: DataFrame, analyzer: str = "en", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, key, tf), one row for each term and key; only where a key stands in several rows are these put together."""
    found = counted(tokens(docs, analyzer, text, key), key).select(key, F.explode_outer("counts").alias("c")).select("c.term", key, "c.tf").where("term is not null")
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return found
    return found.groupBy("term", key).agg(F.sum("tf").alias("tf"))


def doc_stats(docs: DataFrame, analyzer: str = "en", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, dl) of documents that have a token; others are not part of the collection."""
    return tokens(docs, analyzer, text, key).select(key, F.size("tokens").cast("long").alias("dl")).where("dl > 0")


def query_terms(spark: SparkSession, query: str, analyzer: str = "en") -> list[tuple[str, int]]:
    """(term, times) of a query; a term counts as often as it stands there."""
    found = spark.createDataFrame([(query,)], "q string").select(T.analyzer(analyzer)(F.col("q")).alias("t")).first()["t"]
    return sorted(Counter(found).items())


def occurrences(tokens_: Column, term: str) -> Column:
    return F.size(F.filter(tokens_, lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, query: str, top_k: int = 10, analyzer: str = "en", text: str = "text", key: str = "doc_id", k1: float = scores.K1, b: float = scores.B, candidates: Column | None = None) -> DataFrame:
    """(key, score): any term matches, equal scores (of six decimals) by key; ``top_k`` of 0 or less gives all.

    ``candidates`` filters what may be found; N, document frequencies and mean
    length still cover all documents.
    """
    terms = query_terms(docs.sparkSession, query, analyzer)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    mark = candidates if candidates is not None else F.lit(True)
    tok = T.analyzer(analyzer)(F.coalesce(F.col(text), F.lit("")))
    # one pass over a text's words leaves those of the query, which are counted term by term
    asked = F.filter("__t", lambda w: w.isin([t for t, _ in terms]))
    counted = docs.select(F.col(key), mark.alias("__ok"), tok.alias("__t")).select(key, "__ok", F.size("__t").cast("long").alias("dl"), asked.alias("__a"))
    counted = counted.select(key, "__ok", "dl", *(occurrences(F.col("__a"), w).alias(f"tf{i}") for i, (w, _) in enumerate(terms)))
    # kept as a narrow table: texts are read and tokenized once, and no filter on counts is pushed below them
    counted = cut(counted).where("dl > 0")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hit = counted.where(F.col("__ok") & (F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(terms)))) > 0))
    total = F.lit(0.0)
    for i, (_, times) in enumerate(terms):
        total = total + times * scores.bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), scores.idf(F.col("n"), F.col(f"df{i}")), k1, b)
    found = hit.crossJoin(F.broadcast(stats)).select(key, F.round(total, 6).alias("score"))  # one row is broadcast
    found = found.orderBy(F.desc("score"), key)
    return found.limit(top_k) if top_k > 0 else found


def sized_postings(docs: DataFrame, analyzer: str = "en", text: str = "text", key: str = "doc_id", *keep: str) -> DataFrame:
    """(keep, key, dl, term, tf): postings of each row with its length; a row with a null term and the length for every document.

    Texts are tokenized once for both.
    """
    t = docs.select(*keep, key, T.analyzer(analyzer)(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    sized = counted(t.select("*", F.size("tokens").cast("long").alias("dl")), *keep, key, "dl")
    length = F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf"))
    each = sized.select(*keep, key, "dl", F.explode(F.array_append("counts", length)).alias("c"))
    return each.where("dl > 0").select(*keep, key, "dl", "c.term", "c.tf")


def _place(term: Column) -> Column:
    """Where a term's postings stand: files are sorted by this number, which is faster to sort by than the term."""
    return F.xxhash64(term)


def write_index(docs: DataFrame, path: str, analyzer: str = "en", text: str = "text", key: str = "doc_id") -> None:
    """Postings with their document's length, each term's in one place of a file; and the collection's two totals, made from what was written.

    Postings move once, and tasks grow in number, not in size: what is too large for
    one is sorted in several.
    """
    full = sized_postings(docs, analyzer, text, key).withColumn("place", _place(F.col("term")))
    full.hint("rebalance", "place").sortWithinPartitions("place").write.mode("overwrite").parquet(f"{path}/postings")
    lengths = _stored(docs.sparkSession, path, [None]).where("term is null").select(key, "dl").distinct()
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")


def _stored(spark: SparkSession, path: str, terms: list[str | None]) -> DataFrame:
    """What an index has in the places of these terms; the places are pushed down to the scan."""
    return spark.read.parquet(f"{path}/postings").where(F.col("place").isin([_place(F.lit(t).cast("string")) for t in terms])).drop("place")


def rank(own: DataFrame, totals: DataFrame, terms: list[tuple[str, int]], top_k: int = 10, key: str = "doc_id", k1: float = scores.K1, b: float = scores.B, candidates: DataFrame | None = None) -> DataFrame:
    """(key, score) from the postings (term, key, dl, tf) of the query's terms and one row (n, avgdl); ``candidates`` (key) limits what may be found."""
    dfs = own.groupBy("term").agg(F.count("*").alias("df"))
    times = F.coalesce(F.create_map(*(x for t, n in terms for x in (F.lit(t), F.lit(n))))[F.col("term")], F.lit(0)) if terms else F.lit(0)
    hit = own if candidates is None else own.join(candidates.select(key), key, "left_semi")
    each = hit.join(F.broadcast(dfs), "term").crossJoin(F.broadcast(totals))  # a row for each query term, and one row
    part = times * scores.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), scores.idf(F.col("n"), F.col("df")), k1, b)
    found = each.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key)
    return found.limit(top_k) if top_k > 0 else found


def search_index(spark: SparkSession, path: str, query: str, top_k: int = 10, analyzer: str = "en", key: str = "doc_id", k1: float = scores.K1, b: float = scores.B) -> DataFrame:
    """Like ``bm25``, from a stored index: the terms are pushed down to the scan."""
    terms = query_terms(spark, query, analyzer)
    own = _stored(spark, path, [t for t, _ in terms]).where(F.col("term").isin([t for t, _ in terms]))
    own = own.groupBy("term", key, "dl").agg(F.sum("tf").alias("tf"))  # rows of one key and length count as one document
    return rank(own, spark.read.parquet(f"{path}/totals"), terms, top_k, key, k1, b)


def term_stats(docs: DataFrame, analyzer: str = "en", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row: documents, distinct terms, mean length."""
    return token_stats(tokens(docs, analyzer, text, key))


def token_stats(tokens_: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl, n_terms) of a table with ``tokens``, which is read once: a null term after each document's own carries its length."""
    each = tokens_.select(F.size("tokens").alias("dl"), F.explode(F.array_append("tokens", F.lit(None))).alias("term"))
    by_term = each.groupBy("term").agg(F.count_if(F.col("term").isNull() & (F.col("dl") > 0)).alias("docs"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))
    sums = by_term.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), F.sum("total").alias("total"), F.count("term").alias("n_terms"))
    return sums.select("n_docs", F.round(F.try_divide(F.col("total"), F.col("n_docs")), 6).alias("avgdl"), "n_terms")


def remove(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, postings or lengths without the documents of ``gone``; of documents fewer rows move than of their postings."""
    return table.join(gone.select(key).distinct(), key, "left_anti")
