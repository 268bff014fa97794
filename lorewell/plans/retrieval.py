"""Vector search, fusion and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import scores, vectors as V
from lorewell.operators import fulltext, hybrid, vectors
from lorewell.plans.base import bm25_sql, declare, table
from lorewell.sources.embedders import mock_embedder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = declare(QUERIES, ORACLES)

TERMS = "tion orre"
_Q = "q as (select embedding::double[] as q from embeddings where vec_id = 0)"
_INT = (
    "s as (select vec_id, embedding as v, list_max(list_transform(embedding, lambda x: abs(x))) / 127::float as scale from embeddings),"
    " i as (select vec_id, scale, list_transform(v, lambda x: case when scale = 0 then 0 else round((x / scale)::float) end)::double[] as v from s),"
    " qi as (select v as q, scale as qs from i where vec_id = 0)"
)
_VEC = "vec as (select vec_id as doc_id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) as score from embeddings, q order by score desc, doc_id limit 20)"


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"with {_Q} select vec_id, round(list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))), 6) as score from embeddings, q order by score desc, vec_id limit 10")
def vector_cosine_f32(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)


@query(f"with {_Q} select vec_id, round(list_dot_product(embedding::double[], q), 6) as score from embeddings, q order by score desc, vec_id limit 10")
def vector_dot_f32(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, metric="dot")


@query(f"with {_INT} select vec_id, round(scale::double, 6) as scale, array_to_string(v::int[], ',') as q from i")
def quantize_int8(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.scale(v).cast("double"), 6).alias("scale"), F.array_join(V.quantize(v).cast("array<string>"), ",").alias("q"))


@query(f"with {_INT} select vec_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) as score from i, qi order by score desc, vec_id limit 10")
def vector_cosine_int8(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, quantized=True)


@query(f"with {_INT} select vec_id, round(list_dot_product(v, q) * scale::double * qs::double, 6) as score from i, qi order by score desc, vec_id limit 10")
def vector_dot_int8(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, metric="dot", quantized=True)


@query("select len(embedding)::int as dim, count(*)::bigint as n from embeddings group by 1")
def vector_count(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


def _lanes(spark, sf_dir, top: int = 20):
    lex = fulltext.bm25(table(spark, sf_dir, "documents"), TERMS, top)
    vec = vectors.search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), top).withColumnRenamed("vec_id", "doc_id")
    return lex, vec


_RANKS = "fr as (select doc_id, row_number() over (order by score desc, doc_id) as r from lex), vr as (select doc_id, row_number() over (order by score desc, doc_id) as r from vec)"


@query(
    f"with {bm25_sql(TERMS.split(), 20)}, {_Q}, {_VEC}, {_RANKS}"
    " select doc_id, round(coalesce(1.0 / (60 + fr.r), 0)::double + coalesce(1.0 / (60 + vr.r), 0)::double, 6) as score, coalesce(fr.r, 0)::bigint as fts_rank, coalesce(vr.r, 0)::bigint as vector_rank"
    " from fr full join vr using (doc_id) order by score desc, doc_id limit 10"
)
def hybrid_rrf(spark, sf_dir):
    lex, vec = _lanes(spark, sf_dir)
    return hybrid.fuse({"fts": lex, "vector": vec}, 10)


@query(
    f"with {bm25_sql(TERMS.split(), 20)}, {_Q}, {_VEC}, {_RANKS},"
    " g as (select doc_id, (length(text) - length(replace(text, 'orre', ''))) / 4 as score from documents where contains(text, 'orre') order by score desc, doc_id limit 20),"
    " gr as (select doc_id, row_number() over (order by score desc, doc_id) as r from g),"
    " u as (select doc_id, r as a, null as b, null as c from fr union all select doc_id, null, r, null from vr union all select doc_id, null, null, r from gr),"
    " m as (select doc_id, max(a) as a, max(b) as b, max(c) as c from u group by 1)"
    " select doc_id, round(coalesce(1.0 / (60 + a), 0)::double + coalesce(1.0 / (60 + b), 0)::double + coalesce(1.0 / (60 + c), 0)::double, 6) as score,"
    " coalesce(a, 0)::bigint as fts_rank, coalesce(b, 0)::bigint as vector_rank, coalesce(c, 0)::bigint as grep_rank from m order by score desc, doc_id limit 10"
)
def rrf_three_lane(spark, sf_dir):
    lex, vec = _lanes(spark, sf_dir)
    hits = table(spark, sf_dir, "documents").where(F.col("text").contains("orre")).select("doc_id", F.regexp_count("text", F.lit("orre")).cast("double").alias("score"))
    return hybrid.fuse({"fts": lex, "vector": vec, "grep": hits.orderBy(F.desc("score"), "doc_id").limit(20)}, 10)


@query(
    f"with {bm25_sql(TERMS.split(), 20)}, {_Q}, {_VEC}, b as (select min(score) as lo, max(score) as hi from lex),"
    " n as (select doc_id, coalesce((score - lo) / nullif(hi - lo, 0), 1) as lex from lex, b)"
    " select doc_id, round(0.5 * coalesce(lex, 0) + 0.5 * coalesce(vec.score, 0), 6) as score from n full join vec using (doc_id) order by score desc, doc_id limit 10"
)
def weighted_fusion(spark, sf_dir):
    return hybrid.weighted(*_lanes(spark, sf_dir))


@query(f"with {bm25_sql(TERMS.split(), 10, where='lang = $$en$$')} select doc_id, score from lex")
def filtered_search(spark, sf_dir):
    return fulltext.bm25(table(spark, sf_dir, "documents"), TERMS, 10, candidates=F.col("lang") == "en")


@query("select doc_id from (select *, timestamp '2024-01-01' + to_seconds(600 * n_chars) as made from documents) where lang = 'en' and source = 'src3' and made >= timestamp '2024-01-03' and made < timestamp '2024-02-15'")
def filter_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("lang").alias("type"), F.to_json(F.struct("source")).alias("metadata"), F.timestamp_seconds(1704067200 + 600 * F.col("n_chars")).alias("created_at"))
    return rows.where(hybrid.matches("en", {"source": "src3"}, "2024-01-03", "2024-02-15")).select("doc_id")


@query("select vec_id // 4 as memory_id, min(vec_id)::bigint as first_id, round(arg_min(embedding[2], vec_id)::double, 6) as second from embeddings where embedding[1] >= 0 group by 1")
def first_chunk_vectors(spark, sf_dir):
    """Four vectors in a row are the chunks of a memory; those whose first number is negative count as missing."""
    rows = table(spark, sf_dir, "embeddings")
    there = F.when(F.col("embedding")[0] >= 0, F.col("embedding"))
    chunks = rows.select(F.floor(F.col("vec_id") / 4).cast("long").alias("memory_id"), F.col("vec_id").alias("ord"), there.alias("vector"))
    own = vectors.first_chunk_vector(chunks)
    first = chunks.where("vector is not null").groupBy("memory_id").agg(F.min("ord").alias("first_id"))
    return own.join(first, "memory_id").select("memory_id", "first_id", F.round(F.col("vector")[1].cast("double"), 6).alias("second"))


_AGE = "epoch(timestamp '2024-03-01' - ts)"


@query(f"select event_id, round(exp(-ln(2) * greatest(floor({_AGE}), 0) / 259200.0), 6) as recency from events")
def recency_score(spark, sf_dir):
    age = F.lit(1709251200) - F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return table(spark, sf_dir, "events").select("event_id", F.round(scores.recency(age), 6).alias("recency"))


@query(
    f"with b as (select min(value) as lo, max(value) as hi from events)"
    f" select event_id, round(0.6 * coalesce((value - lo) / nullif(hi - lo, 0), 1) + 0.25 * exp(-ln(2) * greatest(floor({_AGE}), 0) / 259200.0) + 0.15 * (case when event_type = 'purchase' then 1.0 else 0.5 end), 6) as score from events, b"
)
def agent_score(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bounds = F.broadcast(events.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))  # one row
    relevance = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(1.0))
    age = F.lit(1709251200) - F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    importance = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.5)
    return events.crossJoin(bounds).select("event_id", F.round(scores.agent_score(relevance, scores.recency(age), importance), 6).alias("score"))


@query()
def mock_embed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", mock_embedder(32)(F.col("text")).alias("embedding"))
