"""A store of memories: the API over the operators.

A store is a folder of Parquet tables.  ``memories`` is a log of versions that is
only appended to, partitioned by collection; the current state is the last version
of each id, so that a write is one atomic commit of files, needs no rewriting, and a
reader sees either all of it or nothing.  ``postings`` has the terms of each content
when it is written, so that a search tokenizes no text but the query.
``accesses``, ``triples``, ``usage``, ``searches`` and ``resets`` are logs in the
same way.  ``compact`` folds memories and accesses into new folders and then
switches to them by creating one file; a crash before or after it loses nothing.
One process writes at a time.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorewell.functions import scores, text as T
from lorewell.operators import fulltext, graph, grep, hybrid, metrics, records, usage, vectors
from lorewell.shared import cut
from lorewell.sources import embedders, files

COLLECTIONS = "name string, analyzer string, embedder_id string, embed_dimension int"
TRIPLES = graph.SCHEMA + ", seq bigint, gone boolean"
SEARCHES = "collection string, mode string, returned bigint, requested bigint, latency_ms double, ts timestamp"
VECTORS = "id string, embedding array<float>, version bigint"
POSTINGS = "collection string, term string, id string, dl bigint, tf bigint, blob_ref string"
ACCESSES = "id string, at timestamp"
RESETS = "what string, at timestamp"
FOLDED = ("memories", "accesses", "vectors", "postings")  # the tables that ``compact`` rewrites
_ACCESSES_HELD = 100


def new_id() -> str:
    """32 hex digits that sort by time."""
    return f"{time.time_ns() // 1000:016x}{uuid.uuid4().hex[:16]}"


class ResultCache:
    """Small results by query; an entry of an older generation is a miss and goes."""

    def __init__(self, most: int = 100):
        self.most, self.entries, self.hits, self.misses = most, OrderedDict(), 0, 0

    @staticmethod
    def key(collection: str, query: str, mode: str, top_k: int, epoch: int) -> str:
        return hashlib.sha256(f"{collection}\0{query}\0{mode}\0{top_k}\0{epoch}".encode()).hexdigest()

    def get(self, key: str, generation: int):
        found = self.entries.get(key)
        if found is None or found[0] != generation:
            self.entries.pop(key, None)
            self.misses += 1
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, key: str, generation: int, value) -> None:
        self.entries[key] = (generation, value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)


class Store:
    def __init__(self, spark: SparkSession, path: str, embed: Callable[[list[str]], list[list[float]]] | None = None, complete: Callable[[str], str] | None = None, keep_metrics: bool = True, analyzer: str = "en", tuning: bool = False):
        self.spark, self.path, self._embed, self._complete = spark, path.rstrip("/"), embed, complete
        self.metrics_enabled, self.default_analyzer, self.tuning, self.closed = keep_metrics, analyzer, tuning, False
        self.generation, self.tuning_epoch, self.cache = 0, 0, ResultCache()
        self._accessed: list[tuple[str, datetime]] = []

    # --- tables -------------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self) -> dict[str, str]:
        """Folder of each folded table: the newest file of ``current`` names them."""
        fs, path = self._fs()
        where = path(f"{self.path}/current")
        turns = sorted((f.getPath().getName() for f in fs.listStatus(where)), key=int) if fs.exists(where) else []
        suffix = f"-{turns[-1]}" if turns else ""
        return {name: name + suffix for name in FOLDED}

    def _where(self, name: str) -> str:
        return f"{self.path}/{self._folders()[name] if name in FOLDED else name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        if self.closed:
            raise RuntimeError("the store is closed")
        fs, path = self._fs()
        where = self._where(name)
        return self.spark.read.schema(schema).parquet(where) if fs.exists(path(where)) else self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, name: str, *by: str) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")
        df.write.mode("append").partitionBy(*by).parquet(self._where(name))

    def close(self) -> None:
        self._flush()
        if self.closed:
            raise RuntimeError("the store is closed")
        self.closed = True

    def _flush(self) -> None:
        """Write the accesses that are held in memory."""
        if self._accessed and not self.closed:
            held, self._accessed = self._accessed, []
            self._append(self.spark.createDataFrame(held, ACCESSES), "accesses")

    def memories(self) -> DataFrame:
        """The last version of every memory, with tombstones and accesses; hard-deleted ones are gone."""
        last = records.latest(self._read("memories", records.SCHEMA + ", hard boolean")).where(~F.col("hard")).drop("hard")
        seen = self._read("accesses", ACCESSES)
        if self._accessed:
            seen = seen.union(self.spark.createDataFrame(self._accessed, ACCESSES))
        seen = seen.groupBy("id").agg(F.count("*").alias("__n"), F.max("at").alias("__at"))
        out = last.join(seen, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("__n", F.lit(0)))
        return out.withColumn("accessed_at", F.greatest("accessed_at", "__at")).select(*last.columns)

    def compact(self) -> None:
        """Fold the logs: one version of each id with its accesses; vectors and postings of what is there."""
        self._flush()
        rows = self.memories()
        live = records.live(rows).select("id", "blob_ref")
        old, turn = self._folders(), str(time.time_ns())
        rows.withColumn("hard", F.lit(False)).write.partitionBy("collection").parquet(f"{self.path}/memories-{turn}")
        self._vectors(live).withColumn("version", F.lit(time.time_ns())).write.parquet(f"{self.path}/vectors-{turn}")
        kept = self._read("postings", POSTINGS).distinct().join(live, ["id", "blob_ref"], "left_semi")
        kept.repartitionByRange("collection", "term", "id").sortWithinPartitions("collection", "term", "id").select(*[c.split()[0] for c in POSTINGS.split(", ")]).write.partitionBy("collection").parquet(f"{self.path}/postings-{turn}")
        fs, path = self._fs()
        fs.create(path(f"{self.path}/current/{turn}"), False).close()  # from here on the new folders count
        for name in old.values():
            fs.delete(path(f"{self.path}/{name}"), True)

    # --- collections --------------------------------------------------------
    def collections(self) -> DataFrame:
        return self._read("collections", COLLECTIONS)

    def create_collection(self, name: str, analyzer: str = "en", embedder_id: str = "", dimension: int = 0) -> None:
        T.analyzer(analyzer)
        if not self.collections().where(F.col("name") == name).isEmpty():
            raise ValueError(f"collection {name!r} exists")
        self._append(self.spark.createDataFrame([(name, analyzer, embedder_id, dimension)], COLLECTIONS), "collections")

    def _collection(self, name: str):
        name = name or "default"
        found = self.collections().where(F.col("name") == name).first()
        if found is None and name == "default":
            self.create_collection(name, self.default_analyzer)
            found = self.collections().where(F.col("name") == name).first()
        if found is None:
            raise KeyError(f"no collection {name!r}")
        return found

    # --- writing ------------------------------------------------------------
    def _write(self, rows: DataFrame, hard: bool = False) -> None:
        version = F.lit(time.time_ns())
        self._append(rows.withColumn("version", version).withColumn("hard", F.lit(hard)), "memories", "collection")
        self.generation += 1

    def _index(self, rows: DataFrame) -> None:
        """Postings of rows whose content is new; they are not sorted before ``compact``."""
        for c in self.collections().collect():  # each has its analyzer
            own = rows.where(F.col("collection") == c["name"])
            full = fulltext.sized_postings(own, c["analyzer"], "content", "id", "collection", "blob_ref")
            self._append(full.select(*[x.split()[0] for x in POSTINGS.split(", ")]), "postings", "collection")

    def remember(self, content: str, collection: str = "", **fields) -> str:
        """Store one memory; its new id."""
        id_ = new_id()
        self.remember_all(self.spark.createDataFrame([(id_, content, *fields.values())], ", ".join(["id string", "content string", *(f"{k} {'float' if k == 'importance' else 'string'}" for k in fields)])), collection)
        return id_

    def remember_all(self, rows: DataFrame, collection: str = "", skip_known: bool = False) -> None:
        """Append a table with ``content`` and, if it has them, id, source, type, content_type, metadata, importance and created_at."""
        name = self._collection(collection)["name"]
        have = set(rows.columns)
        pick = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
        now = F.lit(datetime.now(timezone.utc))
        full = rows.select(
            pick("id", F.concat(F.lit(f"{time.time_ns() // 1000:016x}"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))).alias("id"),
            F.lit(name).alias("collection"), "content", T.content_hash(F.col("content")).alias("blob_ref"), pick("content_type", F.lit("text/plain")).alias("content_type"), pick("source", F.lit("")).alias("source"),
            pick("type", F.lit("semantic")).alias("type"), pick("metadata", F.lit("{}")).alias("metadata"), pick("importance", F.lit(0.5)).cast("float").alias("importance"), pick("created_at", now).alias("created_at"), now.alias("updated_at"), now.alias("accessed_at"), F.lit(0).cast("long").alias("access_count"), F.lit(False).alias("deleted"),
        )
        if skip_known:
            full = records.new_records(full, records.live(self.memories()))
        full = cut(full)  # ids are made once
        self._write(full)
        self._index(full)
        if self._embed is not None:
            ids = [r["id"] for r in rows.select("id").limit(2).collect()] if "id" in have else []
            fresh = self.memories().where(F.col("collection") == name)
            known = self._read("vectors", VECTORS).select("id")
            missing = fresh.join(known, "id", "left_anti") if len(ids) != 1 else fresh.where(F.col("id") == ids[0])
            self._embed_rows(missing)

    def _embed_rows(self, rows: DataFrame) -> None:
        """The vector of the first chunk that has one."""
        chunk = rows.select("id", F.explode(T.chunks(F.col("content"))).alias("c"))
        each = chunk.select(F.col("id").alias("memory_id"), F.col("c.ord").alias("ord"), embedders.embedder(self._embed)(F.col("c.text")).alias("vector"))
        own = vectors.first_chunk_vector(each)
        self._append(own.select(F.col("memory_id").alias("id"), F.col("vector").alias("embedding"), F.lit(time.time_ns()).alias("version")), "vectors")

    def get(self, id_: str):
        """The memory as a row; reading counts as an access."""
        row = records.live(self.memories()).where(F.col("id") == id_)
        found = row.first()
        if found is None:
            raise KeyError(id_)
        self._accessed.append((id_, datetime.now(timezone.utc)))  # an access changes no result
        if len(self._accessed) >= _ACCESSES_HELD:
            self._flush()
        return found

    def update(self, id_: str, **patch) -> None:
        """Set content, type, metadata (as a whole), importance or source; None keeps what was."""
        unknown = set(patch) - set(records.PATCHABLE)
        if unknown:
            raise ValueError(f"cannot set {sorted(unknown)}")
        row = records.live(self.memories()).where(F.col("id") == id_)
        if row.isEmpty():
            raise KeyError(id_)
        for k, v in patch.items():
            if v is not None:
                row = row.withColumn(k, F.lit(v).cast("float" if k == "importance" else "string"))
        row = row.withColumn("blob_ref", T.content_hash(F.col("content"))).withColumn("updated_at", F.current_timestamp())
        self._rewrite(row)
        if patch.get("content") is not None:
            new = self.memories().where(F.col("id") == id_)
            self._index(new)
            if self._embed is not None:
                self._embed_rows(new)

    def _rewrite(self, rows: DataFrame) -> None:
        """A new version; accesses that are counted in the row go from the log with it."""
        self._flush()
        base = records.latest(self._read("memories", records.SCHEMA + ", hard boolean")).select("id", F.col("access_count").alias("__n"))
        self._write(rows.join(base, "id").withColumn("access_count", F.col("__n")).drop("__n"))

    def set_tags(self, id_: str, tags: list[str]) -> None:
        """Replace the tags; other metadata stay."""
        row = records.live(self.memories()).where(F.col("id") == id_)
        self._rewrite(row.withColumn("metadata", records.set_tags(F.col("metadata"), F.array(*map(F.lit, tags)))))

    def forget(self, *ids: str, hard: bool = False) -> None:
        """Tombstones, or nothing at all; what was learned of the memories goes, too (see ``priors``), their vectors with ``compact``."""
        rows = records.live(self.memories()).where(F.col("id").isin(list(ids)))
        if not hard and rows.count() < len(set(ids)):
            raise KeyError(f"not all of {ids} are there")
        self._flush()
        self._write(rows.withColumn("deleted", F.lit(True)), hard=hard)

    def list(self, collection: str = "") -> DataFrame:
        return records.list_collection(self.memories(), collection)

    # --- searching ----------------------------------------------------------
    def _vectors(self, rows: DataFrame) -> DataFrame:
        last = self._read("vectors", VECTORS).groupBy("id").agg(F.max_by("embedding", "version").alias("embedding"))
        return last.join(rows.select("id"), "id", "left_semi")

    def _ranked(self, rows: DataFrame, query: str, config, top_k: int, mark: Column) -> DataFrame:
        """BM25 from the postings of the memories in ``rows``; only those that meet ``mark`` are found."""
        terms = fulltext.query_terms(self.spark, query, config["analyzer"])
        valid = rows.select("id", "blob_ref")
        own = self._read("postings", POSTINGS).where(F.col("collection") == config["name"]).drop("collection")
        asked = own.where(F.col("term").isin([t for t, _ in terms])).distinct().join(valid, ["id", "blob_ref"], "left_semi")
        lengths = own.where("term is null").select("id", "blob_ref", "dl").distinct().join(valid, ["id", "blob_ref"], "left_semi")
        totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return fulltext.rank(asked, totals, terms, top_k, "id", candidates=rows.where(mark))

    def search(self, query: str = "", collection: str = "", mode: str = "hybrid", top_k: int = 10, rrf_k: int = 60, vector: list[float] | None = None, where: Column | None = None, pattern: str | None = None, scoring: str = "", half_life: float = scores.HALF_LIFE_SECONDS) -> DataFrame:
        """(id, score, ..., content): modes fts, vector, hybrid and grep; an unknown mode is fts; ``pattern`` adds a lane of grep to hybrid.

        Deleted memories and those that ``where`` rejects (see ``hybrid.matches``) are
        left out before ranking.  With ``scoring="agent"`` the found ones are ordered
        by relevance (min-max over them), recency and importance; in a store with
        tuning their boost, from priors and affinities, is added to the score.
        """
        if scoring not in ("", "agent"):
            raise ValueError(f"unknown scoring {scoring!r}")
        began, config = time.time(), self._collection(collection)
        top_k = top_k if top_k > 0 else 10
        rows = records.live(self.memories()).where(F.col("collection") == config["name"])
        mark = where if where is not None else F.lit(True)
        fetch = 2 * top_k if mode == "hybrid" else top_k
        lanes: dict[str, DataFrame] = {}
        if mode in ("fts", "hybrid") or mode not in metrics.MODES:
            lanes["fts"] = self._ranked(rows, query, config, fetch, mark)
        if mode in ("vector", "hybrid"):
            if vector is None and self._embed is not None and query:
                vector = list(self._embed([query])[0])
            if vector is not None:
                lanes["vector"] = vectors.search(self._vectors(rows.where(mark)), vector, fetch, quantized=True, key="id")
        if mode == "grep" or pattern:
            hits = grep.grep(rows.where(mark), pattern or query, text="content", key="id")
            lanes["grep"] = hits.select("id", F.size("spans").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(fetch)
        named = {k: v.withColumnRenamed("id", "doc_id") for k, v in lanes.items()}
        if not named:
            found = self.spark.createDataFrame([], "doc_id string, score double")
        elif len(named) == 1 and mode != "hybrid":
            found = next(iter(named.values()))
        else:
            found = hybrid.fuse(named, top_k, rrf_k)
        found = self._scored(rows, found, config, query, scoring, half_life)
        out = rows.join(F.broadcast(found.withColumnRenamed("doc_id", "id")), "id").select("id", "score", "content", "metadata", "importance", "created_at").orderBy(F.desc("score"), "id")  # top_k rows are broadcast
        if self.metrics_enabled:
            n = out.count()
            log = [(config["name"], mode, n, top_k, 1000 * (time.time() - began), datetime.now(timezone.utc))]
            self._append(self.spark.createDataFrame(log, SEARCHES), "searches")
        return out

    def _scored(self, rows: DataFrame, found: DataFrame, config, query: str, scoring: str, half_life: float) -> DataFrame:
        found = found.select("doc_id", "score")
        if scoring == "agent":
            own = found.join(rows.select(F.col("id").alias("doc_id"), "importance", "created_at"), "doc_id")
            age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at")
            found = own.select("doc_id", F.round(scores.agent_score(hybrid.min_max(F.col("score")), scores.recency(age, half_life), F.col("importance")), 6).alias("score"))
        if self.tuning:
            terms = [t for t, n in fulltext.query_terms(self.spark, query, config["analyzer"]) for _ in range(n)]
            here = F.col("collection") == config["name"]
            items = found.withColumnRenamed("doc_id", "item")
            boosted = usage.boosted(items, self.priors().where(here), usage.affinity(self.affinities().where(here), terms))
            found = boosted.select(F.col("item").alias("doc_id"), F.round(F.col("score") + F.col("boost"), 6).alias("score"))
        return found

    def search_cached(self, query: str, collection: str = "", mode: str = "hybrid", top_k: int = 10) -> list:
        """Rows of a search, kept until the store changes."""
        key = ResultCache.key(collection or "default", query, mode, top_k, self.tuning_epoch)
        found = self.cache.get(key, self.generation)
        if found is None:
            found = self.search(query, collection, mode, top_k).collect()
            self.cache.put(key, self.generation, found)
        return found

    # --- graph --------------------------------------------------------------
    def triples(self) -> DataFrame:
        log = self._read("triples", TRIPLES)
        last = log.groupBy(*graph.KEY).agg(F.max_by(F.struct("weight", "source", "gone"), "seq").alias("r"))
        return last.where(~F.col("r.gone")).select(*graph.KEY, "r.weight", "r.source")

    def _triple(self, s: str, p: str, o: str, weight: float, source: str | None, gone: bool) -> None:
        self._append(self.spark.createDataFrame([(s, p, o, weight, source, time.time_ns(), gone)], TRIPLES), "triples")

    def link(self, s: str, p: str, o: str, weight: float = 1.0, source: str | None = None) -> None:
        self._triple(s, p, o, weight, source, False)

    def unlink(self, s: str, p: str, o: str) -> None:
        self._triple(s, p, o, 0.0, None, True)

    def expand(self, start: str, hops: int = 1) -> DataFrame:
        return graph.expand(self.triples(), start, hops)

    # --- usage and metrics --------------------------------------------------
    def record_usage(self, impressions: list[str], used: list[str], terms: list[str] = (), collection: str = "", query_id: str | None = None) -> None:
        if self.tuning:
            row = (query_id or uuid.uuid4().hex, collection or "default", list(terms), impressions, used, datetime.now(timezone.utc))
            self._append(self.spark.createDataFrame([row], usage.EVENT), "usage")

    def _since_reset(self, log: DataFrame, what: str, at: str) -> DataFrame:
        """Rows of the log that are younger than the last reset."""
        last = self._read("resets", RESETS).where(F.col("what") == what).agg(F.max("at").alias("__reset"))
        return log.crossJoin(F.broadcast(last)).where(F.col("__reset").isNull() | (F.col(at) > F.col("__reset"))).drop("__reset")  # one row

    def usage(self) -> DataFrame:
        return self._since_reset(self._read("usage", usage.EVENT), "tuning", "at")

    def _forgotten(self) -> DataFrame:
        there = records.live(self.memories()).select(F.col("id").alias("item"))
        shown = self.usage().select(F.explode(F.concat("impressions", "used")).alias("item")).distinct()
        return shown.join(there, "item", "left_anti")

    def priors(self) -> DataFrame:
        """Of memories that are there; what was learned of forgotten ones is gone."""
        return usage.purge(usage.priors(self.usage()), self._forgotten())

    def affinities(self) -> DataFrame:
        return usage.purge(usage.affinities(self.usage()), self._forgotten())

    def _reset(self, what: str) -> None:
        self._append(self.spark.createDataFrame([(what, datetime.now(timezone.utc))], RESETS), "resets")

    def reset_tuning(self) -> None:
        """Forget all that was learned from usage."""
        self._reset("tuning")
        self.tuning_epoch += 1

    def metrics(self) -> DataFrame:
        return metrics.snapshot(self._since_reset(self._read("searches", SEARCHES), "metrics", "ts"))

    def reset_metrics(self) -> None:
        self._reset("metrics")

    def stats(self) -> DataFrame:
        return self.memories().groupBy("collection").agg(F.count_if(~F.col("deleted")).alias("memories"), F.count_if("deleted").alias("tombstones"))

    def structural_stats(self) -> DataFrame:
        rows = self.memories()
        return metrics.structural(rows, self.triples(), fulltext.tokens(records.live(rows), self.default_analyzer, "content", "id"))

    # --- organisation -------------------------------------------------------
    def suggest(self, collection: str = "", threshold: float = 0.85) -> dict[str, DataFrame]:
        """Untagged memories, pools of episodic ones, and clusters of near duplicates."""
        rows = records.live(self.memories())
        rows = rows.where(F.col("collection") == collection) if collection else rows
        episodic = records.pools(rows.where(F.col("type") == "episodic").select("id"), ["id"])
        numbered = self._vectors(rows).withColumn("key", F.xxhash64("id"))
        pairs = vectors.similar_pairs(numbered, threshold, "key")
        names = numbered.select("key", "id")
        parts = records.clusters(pairs).select("cluster", "similarity", F.explode("members").alias("key")).join(names, "key")
        clusters = parts.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("similarity").alias("similarity"))
        return {"untagged": records.untagged(rows).select("id"), "episodic": episodic, "duplicates": clusters.select("ids", "similarity", F.lit(threshold).alias("threshold"))}

    def merge(self, ids: list[str], summary: str, confirmed: bool = False) -> str:
        """One semantic memory in place of several, which become tombstones."""
        rows = records.live(self.memories()).where(F.col("id").isin(ids))
        new = new_id()
        one = records.merged(rows, new, summary, confirmed)
        self.remember_all(one.select("id", "content", "type", "metadata", "importance"), one.first()["collection"])
        self.forget(*ids)
        return new

    def organize(self, jobs: tuple[str, ...] = ("extract", "autotag", "importance")) -> DataFrame:
        if self._complete is None:
            raise RuntimeError("organising needs a language model")
        rows = records.live(self.memories()).select("id", T.truncate_for_prompt(F.col("content")).alias("prompt"))
        return records.organized(embedders.organize(rows, self._complete, jobs))

    # --- export -------------------------------------------------------------
    def export(self, target: str) -> None:
        """Current state as Parquet, or as a .tar.gz of the store's (local) folder."""
        if target.endswith((".tar.gz", ".tgz")):
            files.pack(self.path, target)
        else:
            self.memories().write.partitionBy("collection").parquet(target)

    @classmethod
    def load(cls, spark: SparkSession, archive: str, path: str, **options) -> Store:
        files.unpack(archive, path)
        return cls(spark, path, **options)

    def info(self) -> dict:
        """Collections, memories and bytes on disk (of a local store)."""
        size = sum(os.path.getsize(os.path.join(r, f)) for r, _, names in os.walk(self.path) for f in names)
        return {"path": self.path, "collections": self.collections().count(), "memories": records.live(self.memories()).count(), "bytes": size, "generation": self.generation}
