from collections import Counter

from lorewell.operators import fulltext

TEXTS = ["b a b c c c", "", None, "zz", "the", "zz b é É 東京 b"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_inside_the_row(spark):
    full = fulltext.sized_postings(docs(spark))
    assert "Aggregate" not in plan(full)
    words = {r.doc_id: r.tokens for r in fulltext.tokens(docs(spark)).collect()}
    want = {(i, len(w), t, n) for i, w in words.items() if w for t, n in [*Counter(w).items(), (None, 1)]}
    got = [(r.doc_id, r.dl, r.term, r.tf) for r in full.collect()]
    assert len(got) == len(want) and set(got) == want


def test_index_of_nothing_and_of_rows_written_twice(spark, tmp_path):
    fulltext.write_index(docs(spark).limit(0), str(tmp_path / "none"))
    assert fulltext.search_index(spark, str(tmp_path / "none"), "b").collect() == []
    twice = spark.createDataFrame([(1, "b d"), (1, "b d"), (2, "c"), (3, "b c d")], "doc_id long, text string")
    fulltext.write_index(twice, str(tmp_path / "twice"))
    totals = spark.read.parquet(str(tmp_path / "twice/totals")).first()
    assert (totals.n, totals.avgdl) == (3, 2.0)
    once = spark.createDataFrame([(1, "b d b d"), (2, "c"), (3, "b c d")], "doc_id long, text string")
    assert [r.doc_id for r in fulltext.search_index(spark, str(tmp_path / "twice"), "b").collect()] == [r.doc_id for r in fulltext.bm25(once, "b").collect()] == [1, 3]
