import pytest
from pyspark.sql import functions as F

from lorewell.functions import scores, vectors as V
from lorewell.operators import fulltext, grep, hybrid, records, running, vectors


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_bm25(spark, tmp_path):
    d = docs(spark, "Go programming language Go compiler Go runtime", "Python programming language interpreter", "the", None)
    got = fulltext.bm25(d, "Go programming").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].score > got[1].score
    fulltext.write_index(d, str(tmp_path / "i"))
    assert fulltext.search_index(spark, str(tmp_path / "i"), "Go programming").collect() == got
    assert fulltext.bm25(d, "the").count() == 0 and fulltext.bm25(d, "").count() == 0
    assert fulltext.bm25(docs(spark, *["common term appears everywhere"] * 20), "common term", 5).count() == 5
    assert fulltext.bm25(d.limit(0), "go").count() == 0


def test_vectors(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    got = vectors.search(t, [0.9, 0.1, 0.0], 2).collect()
    assert got[0].vec_id == 1 and got[0].score >= 0.99
    assert {r.vec_id: r.score for r in vectors.search(t, [0.9, 0.1, 0.0], 0, quantized=True).collect()}[3] == 0.0
    dot = vectors.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>"), [1.0, 1.0, 1.0], metric="dot")
    assert dot.first().score == 6.0
    assert vectors.quantize_list([1.0, -0.5, 0.0, 0.25])[0] == [127, -64, 0, 32]
    assert spark.createDataFrame([([1.0, -0.5, 0.0, 0.25],)], "v array<float>").select(V.quantize(F.col("v"))).first()[0] == [127, -64, 0, 32]


def test_quantised_search_keeps_the_best(spark):
    rows = [(i, [(i * 128 + j) / 12800 for j in range(128)]) for i in range(100)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact, rough = (vectors.search(t, rows[50][1], 5, quantized=q).collect() for q in (False, True))
    assert all(abs(a.score - b.score) <= 0.05 for a, b in zip(exact, rough))


def test_pairs_and_clusters(spark):
    t = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(5)] + [(9, [-1.0, 0.0]), (10, None), (11, [0.0, 0.0])], "vec_id long, embedding array<float>")
    for block in (4096, 2):
        got = vectors.similar_pairs(t, 0.9, block=block)
        assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    c = records.clusters(got).collect()
    assert len(c) == 1 and c[0].members == [0, 1, 2, 3, 4] and 0.9 <= c[0].similarity <= 1


def test_fusion(spark):
    lane = lambda *ids: spark.createDataFrame([(i, 1.0 - k / 10) for k, i in enumerate(ids)], "doc_id long, score double")
    got = hybrid.fuse({"fts": lane(1, 2), "vector": lane(1, 3)}).collect()
    assert got[0].doc_id == 1 and abs(got[0].score - 2 / 61) < 1e-3
    assert [r.doc_id for r in hybrid.fuse({"fts": lane(2, 1), "vector": lane(1, 2)}).collect()] == [1, 2]
    assert got[1].vector_rank == 0 and got[1].fts_rank == 2


def test_recency(spark):
    t = spark.createDataFrame([(0.0,), (72.0,), (144.0,), (-5.0,)], "h double").select(scores.recency(F.col("h") * 3600)).collect()
    assert [round(r[0], 2) for r in t] == [1, 0.5, 0.25, 1]


@pytest.mark.parametrize("pattern,regex,cs", [("func", False, True), ("aa", False, True), ("FUNC", False, False), (r"\d+\.\d+\.\d+\.\d+", True, True), ("東京", False, True)])
def test_grep_spans(spark, pattern, regex, cs):
    texts = ["func main() {", "aaaa func", "at 192.168.1.1 now", "東京タワーは東京都港区", "none", ""]
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in grep.grep(docs(spark, *texts), pattern, regex, cs).collect()}
    for i, t in enumerate(texts, 1):
        for a, b in got.get(i, []):
            piece = t.encode()[a:b].decode()
            assert regex or piece == (pattern if cs else pattern.lower())
    assert got
    if pattern == "aa":
        assert got[2] == [(0, 2), (1, 3), (2, 4)]


def test_grep_of_nothing(spark):
    d = docs(spark, "abc")
    assert grep.grep(d, "").count() == 0 and grep.grep(d, "[invalid", regex=True).count() == 0


def test_running_sum_and_budget(spark):
    d = spark.range(1000).select((999 - F.col("id")).alias("id"), (F.col("id") % 7).alias("x"))
    got = running.running_sum(d, ["id"], F.col("x"), "s").orderBy("id").collect()
    total = 0
    for r in got:
        total += r.x
        assert r.s == total
    inside, _ = grep.within_budget(docs(spark, "aaaa", "bb", "cccc"), 7)
    assert [r.doc_id for r in inside.collect()] == [1, 2]


def test_grep_has_one_dialect(spark):
    t = spark.createDataFrame([(1, "né 12 été ab"), (2, "xx"), (3, None), (4, "aéa")], "doc_id long, text string")
    spans = lambda p, **k: {r.doc_id: [tuple(s) for s in r.spans] for r in grep.grep(t, p, regex=True, **k).collect()}
    assert spans(r"\p{L}+") == {1: [(0, 3), (7, 12), (13, 15)], 2: [(0, 2)], 4: [(0, 4)]}
    assert spans(r"b\z") == {1: [(14, 15)]} and spans("(") == {} and spans("") == {}
    assert spans("É", case_sensitive=False) == {1: [(1, 3), (7, 9), (10, 12)], 4: [(1, 3)]}
    assert spans("x*")[2] == [(0, 2)] and spans("a|(b)") == {1: [(13, 14), (14, 15)], 4: [(0, 1), (3, 4)]}


def test_pairs_of_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, None), (6, [0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (4096, 2):
        assert sorted((r.a, r.b) for r in vectors.similar_pairs(t, 0.9, block=block).collect()) == [(1, 2), (3, 4)]
