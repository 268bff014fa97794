"""Memories as a table: patches, tombstones, listing, idempotent ingest, organisation.

Content, type, importance and metadata are taken as they come; nothing is validated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorewell.functions import text as T
from lorewell.operators.components import connected_components
from lorewell.operators.running import row_numbers

SCHEMA = (
    "id string, collection string, content string, blob_ref string, content_type string, source string, type string, metadata string,"
    " importance float, created_at timestamp, updated_at timestamp, accessed_at timestamp, access_count bigint, deleted boolean, version bigint"
)
PATCHABLE = ("content", "type", "metadata", "importance", "source")


def latest(log: DataFrame) -> DataFrame:
    """The last version of each id; a log of versions is how a table that is only appended to is updated."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("id", "r.*")


def live(memories: DataFrame) -> DataFrame:
    return memories.where(~F.col("deleted"))


def list_collection(memories: DataFrame, collection: str = "") -> DataFrame:
    """Live memories in the order of id; an empty name lists all collections."""
    rows = live(memories)
    return (rows.where(F.col("collection") == collection) if collection else rows).orderBy("id")


def patched(memories: DataFrame, patch: DataFrame, key: str = "id", columns: tuple[str, ...] = PATCHABLE) -> DataFrame:
    """Values of ``patch`` where it has any; null keeps what was; metadata is replaced as a whole."""
    own = [c for c in columns if c in patch.columns]
    p = patch.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in own))
    out = memories.join(p, key, "left")
    for c in own:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*memories.columns)


def set_tags(metadata: Column, tags: Column) -> Column:
    """Metadata (a JSON object) with its ``tags`` replaced by a list; the other keys keep their values and types."""
    kept = F.map_filter(F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>"), lambda k, v: k != "tags")
    return F.to_json(F.map_concat(kept, F.create_map(F.lit("tags"), F.parse_json(F.to_json(tags)))))


def soft_deleted(memories: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    mark = gone.select(F.col(key), F.lit(True).alias("__gone")).distinct()
    return memories.join(mark, key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def hard_deleted(memories: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return memories.join(gone.select(key).distinct(), key, "left_anti")


def new_records(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Records of which neither the source and content hash together are known nor another of the batch has a smaller id."""
    hashed = incoming.withColumn("blob_ref", T.content_hash(F.col("content")))
    first = hashed.groupBy("source", "blob_ref").agg(F.min("id").alias("id"))
    own = hashed.join(first.select("id"), "id", "left_semi")
    return own.join(known.select("source", "blob_ref").distinct(), ["source", "blob_ref"], "left_anti")


def untagged(memories: DataFrame) -> DataFrame:
    """Live memories whose metadata has neither ``tags`` nor ``auto_tags``."""
    return live(memories).where(F.get_json_object("metadata", "$.tags").isNull() & F.get_json_object("metadata", "$.auto_tags").isNull())


def pools(rows: DataFrame, order: list[str], size: int = 10) -> DataFrame:
    """``rows`` with ``pool``: groups of ``size`` in the given order."""
    return row_numbers(rows, order, "__n").withColumn("pool", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, members, size, similarity) of (a, b, similarity): connected components; similarity is that of the weakest pair."""
    parts = connected_components(pairs.select("a", "b"))
    weakest = pairs.join(parts, pairs["a"] == parts["node"]).groupBy("component").agg(F.min("similarity").alias("similarity"))
    own = parts.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size"))
    return own.join(weakest, "component").select(F.col("component").alias("cluster"), "members", "size", "similarity")


def merged(originals: DataFrame, new_id: str, summary: str, confirmed: bool) -> DataFrame:
    """The semantic memory that replaces ``originals``, which name it as ``merged_from``; needs confirmation, a summary and two originals."""
    if not confirmed:
        raise ValueError("a merge must be confirmed")
    if not summary:
        raise ValueError("a merge needs a summary")
    ids = [r["id"] for r in originals.select("id").orderBy("id").limit(2).collect()]
    if len(ids) < 2:
        raise ValueError("a merge needs two memories or more")
    meta = F.to_json(F.struct(F.sort_array(F.collect_list("id")).alias("merged_from"), F.lit("merge").alias("provenance")))
    one = originals.agg(meta.alias("metadata"), F.first("collection").alias("collection"), F.max("importance").alias("importance"))
    return one.select(F.lit(new_id).alias("id"), "collection", F.lit(summary).alias("content"), F.lit("semantic").alias("type"), "metadata", "importance")


#: What a language model is asked to return, and what stands in for an answer that is no JSON.
EXTRACT = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<subject:string,predicate:string,object:string>>>"
TAGS = "array<string>"
IMPORTANCE = "struct<score:float>"


def organized(answers: DataFrame) -> DataFrame:
    """(id, entities, relations, tags, importance) from a model's answers (id, extract, autotag, importance)."""
    e = F.from_json("extract", EXTRACT)
    score = F.coalesce(F.from_json("importance", IMPORTANCE)["score"], F.lit(0.5).cast("float"))
    none = lambda kind: F.from_json(F.lit("[]"), kind)
    return answers.select(
        "id",
        F.coalesce(e["entities"], none("array<struct<name:string,type:string>>")).alias("entities"),
        F.coalesce(e["relations"], none("array<struct<subject:string,predicate:string,object:string>>")).alias("relations"),
        F.coalesce(F.from_json("autotag", TAGS), none(TAGS)).alias("tags"),
        score.alias("importance"),
    )
