import json

import pytest
from pyspark.sql import functions as F

from lorewell.operators import graph, hybrid, metrics, records, usage
from lorewell.sources import embedders
from lorewell.store import Store


def triples(spark, *rows):
    return spark.createDataFrame([(*r, 1.0, None) for r in rows], graph.SCHEMA)


def test_graph(spark):
    t = triples(spark, ("Tokyo", "is_a", "City"), ("Tokyo", "located_in", "Japan"), ("Kyoto", "is_a", "City"))
    assert [graph.find(t, **k).count() for k in ({"subject": "Tokyo"}, {"object_": "City"}, {"predicate": "is_a"}, {"subject": "Tokyo", "predicate": "is_a"})] == [2, 2, 2, 1]
    chain = triples(spark, ("A", "knows", "B"), ("B", "knows", "C"), ("C", "knows", "D"), ("E", "self", "E"))
    assert graph.expand(chain, "A", 1).count() == 1
    assert {(r.s, r.hop) for r in graph.expand(chain, "A", 2).collect()} == {("A", 1), ("B", 2)}
    assert graph.expand(chain, "A", 2, multiplicity=True).count() == 3
    assert graph.expand(chain, "A", 0).count() == 0 and graph.expand(chain, "X", 3).count() == 0
    assert graph.expand(chain, "E", 1, multiplicity=True).count() == 2


def test_usage(spark):
    rows = [("q1", "", ["cache", "eviction"], ["id1", "id2", "id3"], ["id1"], None)]
    events = spark.createDataFrame(rows, usage.EVENT)
    got = {r.item: r.prior for r in usage.priors(events).collect()}
    assert got == {"id1": 0.5, "id2": 0.25, "id3": 0.25}
    assert usage.stats(events).first() == (1, 3, 2)
    heavy = spark.createDataFrame([("q", "c", ["rare"], ["item"], ["item"], None)] * 100, usage.EVENT)
    base = spark.createDataFrame([("item", 0.01), ("other", 0.01)], "item string, score double")
    b = {r.item: r.boost for r in usage.boosted(base, usage.priors(heavy), usage.affinity(usage.affinities(heavy), ["rare"])).collect()}
    assert b == {"item": 0.005, "other": 0.0}


def test_metrics(spark):
    log = spark.createDataFrame([("c", "fts", 10, 10, 0.5), ("c", "fts", 3, 10, 1.0), ("c", "odd", 0, 5, 501.0)], "collection string, mode string, returned long, requested long, latency_ms double")
    got = {(r.collection, r.mode): r for r in metrics.snapshot(log).collect()}
    assert got["c", "fts"].returned == 13 and got["c", "hybrid"].underfilled == 1 and got[None, None].fill_rate == 0.52
    assert {r.mode: r.share for r in metrics.mode_share(log).collect()}["vector"] == 0
    assert {r.bucket: r.searches for r in metrics.latency_histogram(log).collect()} == {"<=1": 2, ">500": 1}
    assert metrics.fill_rate(log.limit(0)).first()[0] == 0


def test_store_life(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    a = s.remember("The quick brown fox", source="x")
    b = s.remember("A lazy dog sleeps", metadata=json.dumps({"k": "v"}))
    with pytest.raises(KeyError):
        s.remember("x", collection="unknown")
    s.create_collection("notes", "bigram")
    with pytest.raises(ValueError):
        s.create_collection("notes")
    s.remember("東京タワー", collection="notes")
    assert [r.id for r in s.search("fox", mode="fts").collect()] == [a]
    assert s.search("東京", collection="notes", mode="fts").count() == 1
    assert s.search("lazy", mode="grep").first().id == b
    assert s.search("fox dog").count() == 2
    s.update(a, content="A slow turtle")
    assert s.search("fox", mode="fts").count() == 0 and s.search("turtle", mode="fts").count() == 1
    s.set_tags(b, ["t1", "t2"])
    meta = json.loads(s.get(b).metadata)
    assert meta == {"k": "v", "tags": ["t1", "t2"]}
    assert records.latest(s.memories()).where(F.col("id") == b).first().access_count == 1
    m = s.merge([a, b], "animals", confirmed=True)
    assert [r.id for r in s.list("default").collect()] == [m]
    with pytest.raises(ValueError):
        s.merge([m], "x", confirmed=True)
    with pytest.raises(KeyError):
        s.get(a)
    s.forget(m, hard=True)
    s.compact()
    assert s.list("default").count() == 0 and s.stats().where("collection = 'default'").first().tombstones == 2
    s.link("x", "is", "y")
    s.link("x", "is", "y", 2.0)
    assert s.triples().first().weight == 2.0 and s.expand("y").count() == 1
    s.unlink("x", "is", "y")
    assert s.triples().count() == 0
    assert s.metrics().where("mode = 'fts'").count() >= 1
    assert s.structural_stats().first().memories == 1
    s.export(str(tmp_path / "x.tar.gz"))
    t = Store.load(spark, str(tmp_path / "x.tar.gz"), str(tmp_path / "t"))
    assert t.list().count() == 1 and t.info()["collections"] == 2
    rows = s.search_cached("東京", "notes", "fts")
    assert s.search_cached("東京", "notes", "fts") is rows
    s.remember("東京", collection="notes")
    assert len(s.search_cached("東京", "notes", "fts")) == 2
    s.close()
    with pytest.raises(RuntimeError):
        s.close()


def test_tags_leave_types_alone(spark):
    d = spark.createDataFrame([('{"n":1,"ok":true,"o":{"a":[1,2.5]},"s":"x","tags":["old"]}',), (None,)], "m string")
    got = [json.loads(r[0]) for r in d.select(records.set_tags(F.col("m"), F.array(F.lit("t")))).collect()]
    assert got == [{"n": 1, "ok": True, "o": {"a": [1, 2.5]}, "s": "x", "tags": ["t"]}, {"tags": ["t"]}]


def test_store_learns_and_forgets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "l"), tuning=True)
    a, b, c = (s.remember(t) for t in ("red apple pie", "red apple tart", "red cherry"))
    plain = {r.id: r.score for r in s.search("apple", mode="fts").collect()}
    s.record_usage([a, b], [b], ["apple"])
    s.record_usage([a, c], [c], ["cherry"])
    tuned = {r.id: r.score for r in s.search("apple", mode="fts").collect()}
    assert tuned[b] > plain[b] and tuned[b] > tuned[a] > plain[a] and tuned[b] <= 1.5 * plain[b] + 1e-6
    s.forget(b)
    assert {r.item for r in s.priors().collect()} == {a, c} and {r.item for r in s.affinities().collect()} == {c}
    s.reset_tuning()
    assert s.priors().count() == 0 and {r.id: r.score for r in s.search("pie", mode="fts").collect()}.keys() == {a}
    assert s.metrics().count() > 0
    s.reset_metrics()
    assert s.metrics().where("mode is not null").count() == 0


def test_store_scores_and_filters(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    rows = [("1", "apple apple", "semantic", '{"k":"v"}', 0.1, "2020-01-01"), ("2", "apple pie", "episodic", '{"k":"w"}', 1.0, "2020-01-01"), ("3", "apple tart", "semantic", '{"k":"v"}', 0.9, "2038-01-01")]
    s.remember_all(spark.createDataFrame(rows, "id string, content string, type string, metadata string, importance double, t string").withColumn("created_at", F.to_timestamp("t")).drop("t"))
    assert [r.id for r in s.search("apple", mode="fts", scoring="agent").collect()] == ["1", "3", "2"]
    only = lambda **k: {r.id for r in s.search("apple", mode="fts", where=hybrid.matches(**k)).collect()}
    assert only(type_="episodic") == {"2"} and only(metadata={"k": "v"}) == {"1", "3"} and only(after="2030-01-01") == {"3"} and only(before="2030-01-01", metadata={"k": "v"}) == {"1"}
    with pytest.raises(ValueError):
        s.search("apple", scoring="odd")


def test_store_survives_an_unfinished_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "c"))
    a = s.remember("one fish")
    s.get(a)
    s.update(a, content="two fish")
    s.get(a)
    for folder in ("memories-5", "postings-5"):  # what a crash before the switch leaves behind
        spark.range(1).write.parquet(str(tmp_path / "c" / folder))
    assert s.search("fish", mode="fts").count() == 1
    for _ in range(2):
        s.compact()
        assert [r.id for r in s.search("two", mode="fts").collect()] == [a] and s.search("one", mode="fts").count() == 0
        assert s.memories().first().access_count == 2
    s.close()
    again = Store(spark, str(tmp_path / "c"))
    again.remember("three fish")
    assert again.search("fish", mode="fts").count() == 2 and again.get(a).access_count == 2


def test_organisation_by_a_model(spark, tmp_path):
    answers = {"extract": '{"entities":[{"name":"Ada","type":"person"}],"relations":[{"subject":"Ada","predicate":"wrote","object":"code"}]}', "autotag": '["x"]', "importance": '{"score":0.25}'}
    s = Store(spark, str(tmp_path / "o"), complete=lambda p: next(v for k, v in answers.items() if p.startswith(embedders.JOBS[k])))
    s.remember("Ada wrote code")
    got = s.organize().first()
    assert (got.entities[0].name, got.relations[0].predicate, got.tags, got.importance) == ("Ada", "wrote", ["x"], 0.25)
    with pytest.raises(ValueError):
        s.organize(("odd",))


def test_mock_embedding_values():
    v = embedders.mock_vector("hello", 3)
    assert sum(x * x for x in v) == pytest.approx(1, abs=1e-6) and v == embedders.mock_vector("hello", 3) != embedders.mock_vector("hellp", 3)
    assert len(embedders.mock_vector("", 5)) == 5


def test_store_with_vectors(spark, tmp_path):
    embed = lambda texts: [embedders.mock_vector(t, 16) for t in texts]
    s = Store(spark, str(tmp_path / "v"), embed=embed, complete=lambda p: '{"score": 0.9}' if "Rate" in p else "no json")
    a = s.remember("alpha", type="episodic")
    s.remember("beta")
    s.remember("alpha")
    assert s.search("alpha", mode="vector").first().score == 1.0
    out = s.suggest()
    assert out["duplicates"].count() == 1 and out["untagged"].count() == 3 and out["episodic"].first().id == a
    got = s.organize().first()
    assert got.tags == [] and round(got.importance, 3) == 0.9


def test_idempotent_ingest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([("1", "same", "u"), ("2", "same", "u"), ("3", "same", "w")], "id string, content string, source string")
    s.remember_all(rows, skip_known=True)
    s.remember_all(rows, skip_known=True)
    assert [r.id for r in s.list().collect()] == ["1", "3"]
