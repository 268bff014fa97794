"""Text analysis, full-text index and pattern scans over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import fulltext, grep
from lorewell.plans.base import bm25_sql, declare, table, tokens_sql
from lorewell.shared import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = declare(QUERIES, ORACLES)

TERMS = "tion orre hehely"


@query(f"with {bm25_sql(TERMS.split(), 10)} select doc_id, score from lex")
def fts_bm25_topk(spark, sf_dir):
    return fulltext.bm25(table(spark, sf_dir, "documents"), f"the {TERMS}", 10)


@query(f"with {bm25_sql(TERMS.split(), None)} select doc_id, score from lex")
def fts_bm25_all(spark, sf_dir):
    return fulltext.bm25(table(spark, sf_dir, "documents"), TERMS, 0)


@query(f"with {bm25_sql(['tion', 'tion', 'ing'], 10)} select doc_id, score from lex")
def fts_bm25_dup_terms(spark, sf_dir):
    return fulltext.bm25(table(spark, sf_dir, "documents"), "tion Tion ing", 10)


@query(f"with {bm25_sql(TERMS.split(), 10)} select doc_id, score from lex")
def fts_index_search(spark, sf_dir):
    """Writes the index and searches it."""
    path = shared_path(spark, "index")
    fulltext.write_index(table(spark, sf_dir, "documents"), path)
    return fulltext.search_index(spark, path, f"the {TERMS}", 10)


@query(f"with t as (select doc_id, unnest({tokens_sql()}) as term from documents) select term, doc_id, count(*)::bigint as tf from t group by 1, 2")
def fts_postings(spark, sf_dir):
    return fulltext.postings(table(spark, sf_dir, "documents"))


@query(f"select doc_id, len({tokens_sql()})::bigint as dl from documents where len({tokens_sql()}) > 0")
def fts_doc_stats(spark, sf_dir):
    return fulltext.doc_stats(table(spark, sf_dir, "documents"))


@query(
    f"with t as (select {tokens_sql()} as t from documents) select (select count(*) from t where len(t) > 0)::bigint as n_docs,"
    " (select round(avg(len(t)), 6) from t where len(t) > 0) as avgdl, (select count(distinct w) from (select unnest(t) as w from t))::bigint as n_terms"
)
def fts_term_stats(spark, sf_dir):
    return fulltext.term_stats(table(spark, sf_dir, "documents"))


@query(f"with t as (select doc_id, {tokens_sql()} as t from documents where doc_id % 2 = 1), g as (select unnest(t) as term, doc_id from t) select term, count(distinct doc_id)::bigint as n_docs from g group by 1")
def fts_remove(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    left = fulltext.postings(fulltext.remove(docs, docs.where("doc_id % 2 = 0")))
    return left.groupBy("term").agg(F.count("doc_id").alias("n_docs"))  # one posting for each term and document


@query(f"select doc_id, len({tokens_sql()})::bigint as n_tokens, md5(array_to_string({tokens_sql()}, ' ')) as tokens_md5 from documents")
def fts_tokens_en(spark, sf_dir):
    t = fulltext.tokens(table(spark, sf_dir, "documents"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(
    "with c as (select doc_id, string_split(lower(text), '') as c from documents),"
    " b as (select doc_id, list_filter(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), lambda p: not contains(p, ' ') and not contains(p, chr(10))) as b from c)"
    " select doc_id, len(b)::bigint as n_tokens, md5(array_to_string(b, '|')) as tokens_md5 from b"
)
def fts_bigram_tokens(spark, sf_dir):
    t = fulltext.tokens(table(spark, sf_dir, "documents"), "bigram")
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("tokens_md5"))


@query(
    rf"with t as (select lang, sum(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+')))::bigint as n_words, sum(len({tokens_sql()}))::bigint as n_kept from documents group by 1)"
    " select lang, n_words, n_kept, round((n_words - n_kept) / n_words::double, 6) as stop_share from t"
)
def fts_stopword_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    each = docs.select("lang", F.size(T.split_words(T.normalize(F.col("text")))).alias("w"), F.size(T.tokens_en(F.col("text"))).alias("k"))
    out = each.groupBy("lang").agg(F.sum("w").cast("long").alias("n_words"), F.sum("k").cast("long").alias("n_kept"))
    return out.withColumn("stop_share", F.round(F.try_divide(F.col("n_words") - F.col("n_kept"), F.col("n_words")), 6))


@query("select lang, sum(length(text))::bigint as tokens, max(length(text))::bigint as longest from documents group by 1")
def token_estimate(spark, sf_dir):
    n = T.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("tokens"), F.max(n).cast("long").alias("longest"))


@query(
    r"with s as (select doc_id, regexp_extract_all(text, '(?s)[^.。!?\n]*[.。!?\n]|[^.。!?\n]+') as s from documents)"
    " select doc_id, len(s)::bigint as n_sentences, md5(array_to_string(s, '|')) as md5 from s"
)
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("md5"))


@query()
def chunk_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", "c.ord", "c.text")


@query(
    "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, len(string_split(text, chr(10))) as lines from documents),"
    " p as (select doc_id, case when lines <= 50 then 0 else n // 50 end as part, lines, string_agg(line, chr(10) order by n) as text from l group by all)"
    " select doc_id, (row_number() over (partition by doc_id order by part) - 1)::int as ord, text from p where regexp_matches(text, '\\S') or lines <= 50"
)
def code_chunk(spark, sf_dir):
    return T.code_chunks(table(spark, sf_dir, "documents"))


@query("select sha256(text) as blob_ref, count(*)::bigint as copies, min(doc_id)::bigint as first_id from documents group by 1")
def blobref_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(T.content_hash(F.col("text")).alias("blob_ref")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("select doc_id, case when n >= 1048576 then format('{:.1f} MB', n / 1048576.0) when n >= 1024 then format('{:.1f} KB', n / 1024.0) else n || ' B' end as size from (select doc_id, strlen(text) as n from documents)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(F.octet_length("text")).alias("size"))


@query("select doc_id, list_filter(list_transform(string_split(coalesce(lang, '') || ', ' || source || ',,x ' || lang, ','), lambda t: trim(t)), lambda t: t <> '')::varchar as tags from documents")
def tag_lists(spark, sf_dir):
    tags = T.split_tags(F.concat(F.coalesce("lang", F.lit("")), F.lit(", "), "source", F.lit(",,x "), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("tags"))


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as preview, case when length(text) > 2000 then left(text, 2000) || '...' else text end as prompt from documents")
def text_previews(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(t).alias("preview"), T.truncate_for_prompt(t).alias("prompt"))


@query("select doc_id from documents where contains(text, 'orre')")
def grep_literal(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(grep.condition(F.col("text"), "orre")).select("doc_id")


@query("select doc_id from documents where contains(lower(text), 'orre')")
def grep_literal_ci(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(grep.condition(F.col("text"), "ORRE", case_sensitive=False)).select("doc_id")


@query(r"select doc_id, len(regexp_extract_all(text, '[0-9]+\.[0-9]+'))::bigint as hits from documents where regexp_matches(text, '[0-9]+\.[0-9]+')")
def grep_regex(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(grep.condition(F.col("text"), r"[0-9]+\.[0-9]+", regex=True))
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"[0-9]+\.[0-9]+")).cast("long").alias("hits"))


@query(
    "with p as (select doc_id, string_split(text, 'orre') as p from documents where contains(text, 'orre')),"
    " e as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as k, len(p) as n from p),"
    " s as (select doc_id, k, n, sum(strlen(x)) over (partition by doc_id order by k) + (k - 1) * 4 as start from e)"
    " select doc_id, start::bigint as start, (start + 4)::bigint as stop from s where k < n"
)
def grep_spans(spark, sf_dir):
    found = grep.grep(table(spark, sf_dir, "documents"), "orre")
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.stop")


@query(r"select doc_id, len(regexp_extract_all(text, '\p{Lu}\p{Ll}+\s\p{Lu}\p{Ll}+'))::bigint as hits from documents where regexp_matches(text, '\p{Lu}\p{Ll}+\s\p{Lu}\p{Ll}+')")
def grep_unicode_classes(spark, sf_dir):
    found = grep.grep(table(spark, sf_dir, "documents"), r"\p{Lu}\p{Ll}+\s\p{Lu}\p{Ll}+", regex=True)
    return found.select("doc_id", F.size("spans").cast("long").alias("hits"))


@query(
    r"with p as (select doc_id, string_split_regex(text, '[0-9]{3,}') as p, regexp_extract_all(text, '[0-9]{3,}') as m from documents where regexp_matches(text, '[0-9]{3,}')),"
    " e as (select doc_id, unnest(m) as m, unnest(p[1:len(m)]) as x, generate_subscripts(m, 1) as k from p),"
    " s as (select doc_id, strlen(m) as n, sum(strlen(x)) over w + sum(strlen(m)) over w as stop from e window w as (partition by doc_id order by k))"
    " select doc_id, (stop - n)::bigint as start, stop::bigint as stop from s"
)
def grep_regex_spans(spark, sf_dir):
    found = grep.grep(table(spark, sf_dir, "documents"), "[0-9]{3,}", regex=True)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.stop")


@query(
    "with s as (select doc_id, text, sum(strlen(text)) over (order by doc_id) as scanned from documents where text is not null)"
    " select doc_id, scanned::bigint as scanned from s where scanned <= 500000 and contains(text, 'tion')"
)
def grep_scan_budget(spark, sf_dir):
    inside, _ = grep.within_budget(table(spark, sf_dir, "documents"), 500_000)
    return inside.where(grep.condition(F.col("text"), "tion")).select("doc_id", "scanned")
