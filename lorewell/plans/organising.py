"""Memories: lifecycle, duplicates and organisation, with ``documents`` and ``conversations`` as memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import records, vectors
from lorewell.plans.base import declare, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = declare(QUERIES, ORACLES)

_INT = (
    "i as (select vec_id as id, list_transform(embedding, lambda x: case when list_max(list_transform(embedding, lambda y: abs(y))) = 0 then 0 else"
    " round((x / (list_max(list_transform(embedding, lambda y: abs(y))) / 127::float))::float) end)::double[] as v from embeddings),"
    " m as (select id, v, sqrt(list_dot_product(v, v)) as n from i),"
    " pairs as (select a.id as a, b.id as b, list_dot_product(a.v, b.v) / (a.n * b.n) as similarity from m a join m b on a.id < b.id where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.4)"
)


def memories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.col("text").alias("content"), F.col("source"), F.lit("semantic").alias("type"), F.to_json(F.struct("lang")).alias("metadata"), F.lit(0.5).cast("float").alias("importance"), (F.col("doc_id") % 10 == 0).alias("deleted")
    )


@query("select doc_id as id, length(text)::bigint as n from documents where doc_id % 10 <> 0 and source = 'src3'")
def list_collection(spark, sf_dir):
    return records.list_collection(memories(spark, sf_dir), "src3").select("id", F.char_length("content").cast("long").alias("n"))


@query("select doc_id as id, source as collection, text as content from documents where doc_id = 42")
def get_by_id(spark, sf_dir):
    return memories(spark, sf_dir).where("id = 42").select("id", "collection", "content")


@query("select doc_id as id, (doc_id % 10 = 0 or lang = 'de') as deleted from documents")
def soft_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return records.soft_deleted(memories(spark, sf_dir), gone).select("id", "deleted")


@query("select doc_id as id from documents where lang <> 'de'")
def hard_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return records.hard_deleted(memories(spark, sf_dir), gone).select("id")


@query("select doc_id as id, case when quality = 1 then 'good' else 'semantic' end as type, case when toxic = 1 then 0.0 else 0.5 end::double as importance from documents left join labels using (doc_id)")
def patch_update(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    patch = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").alias("type"), F.when(F.col("toxic") == 1, F.lit(0.0).cast("float")).alias("importance"))
    return records.patched(memories(spark, sf_dir), patch).select("id", "type", F.col("importance").cast("double").alias("importance"))


@query(
    "with f as (select min(doc_id) as id, source, sha256(text) as blob_ref from documents group by source, sha256(text))"
    " select id, blob_ref from f where not exists (select 1 from documents d where d.lang = 'fr' and d.source = f.source and sha256(d.text) = f.blob_ref)"
)
def idempotent_ingest(spark, sf_dir):
    own = memories(spark, sf_dir)
    known = table(spark, sf_dir, "documents").where("lang = 'fr'").select("source", F.sha2("text", 256).alias("blob_ref"))
    return records.new_records(own, known).select("id", "blob_ref")


@query("select source as collection, count(*) filter (doc_id % 10 <> 0)::bigint as memories, count(*) filter (doc_id % 10 = 0)::bigint as tombstones, coalesce(sum(strlen(text)) filter (doc_id % 10 <> 0), 0)::bigint as n_bytes from documents group by 1")
def collection_stats(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("collection").agg(F.count_if(~F.col("deleted")).alias("memories"), F.count_if("deleted").alias("tombstones"), F.sum(F.when(~F.col("deleted"), F.octet_length("content")).otherwise(0)).alias("n_bytes"))


@query(f"with {_INT} select a, b, round(similarity, 6) as similarity from pairs")
def dup_pairs(spark, sf_dir):
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), threshold=0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"with recursive {_INT}, e as (select a, b from pairs union select b, a from pairs), r as (select a as node, a as c from e union select e.b, r.c from r join e on e.a = r.node),"
    " c as (select node, min(c) as cluster from r group by 1), w as (select cluster, min(similarity) as similarity from pairs join c on c.node = pairs.a group by 1)"
    " select cluster, array_to_string(list(node order by node), ',') as members, count(*)::bigint as size, round(any_value(similarity), 6) as similarity from c join w using (cluster) group by 1"
)
def dup_clusters(spark, sf_dir):
    found = records.clusters(vectors.similar_pairs(table(spark, sf_dir, "embeddings"), threshold=0.4))
    return found.select("cluster", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "size", F.round("similarity", 6).alias("similarity"))


@query("select d.doc_id as id from documents d left join labels l using (doc_id) where d.doc_id % 10 <> 0 and l.quality is null")
def untagged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.to_json(F.struct(F.array(F.col("quality").cast("string")).alias("auto_tags"))).alias("metadata"))
    return records.untagged(records.patched(memories(spark, sf_dir), labels)).select("id")


@query(
    "with n as (select conv_id, turn, row_number() over (order by conv_id, turn) as n from conversations)"
    " select ((n - 1) // 10)::bigint as pool, count(*)::bigint as size, string_agg(conv_id || ':' || turn, ',' order by n) as members, 'episodic group' as topic from n group by 1"
)
def episodic_pools(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    own = records.pools(rows, ["conv_id", "turn"]).groupBy("pool").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct("conv_id", "turn"))).alias("m"))
    return own.select("pool", "size", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["conv_id"], x["turn"])), ",").alias("members"), F.lit("episodic group").alias("topic"))


@query("select 'new' as id, 'src3' as collection, 'all of them' as content, 'semantic' as type, (select '{\"merged_from\":[' || string_agg('\"' || doc_id || '\"', ',' order by doc_id::varchar) || '],\"provenance\":\"merge\"}' from documents where source = 'src3') as metadata, 0.5::double as importance")
def merge_provenance(spark, sf_dir):
    own = memories(spark, sf_dir).where("collection = 'src3'").withColumn("id", F.col("id").cast("string"))
    return records.merged(own, "new", "all of them", confirmed=True).withColumn("importance", F.col("importance").cast("double"))


@query("select doc_id as id, '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || ',\"tags\":[\"' || source || '\"]}' as metadata from documents")
def tags_keep_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    meta = F.to_json(F.struct("lang", F.col("n_chars").alias("n"), F.lit("old").alias("tags")))
    return docs.select(F.col("doc_id").alias("id"), records.set_tags(meta, F.array("source")).alias("metadata"))
