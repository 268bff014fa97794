from collections import Counter

from lorewell.operators import fulltext
from lorewell.plans import registry


def test_postings_keep_no_table_of_terms_and_documents(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, None), (4, "zz a")], "doc_id long, text string")
    found = fulltext.postings(docs)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = {r.doc_id: r.tokens for r in fulltext.tokens(docs).collect()}
    assert sorted(map(tuple, found.collect())) == sorted((t, i, n) for i, w in words.items() for t, n in Counter(w).items())


def test_postings_of_keys_in_several_rows(spark, tmp_path):
    rows = [(1, "b bb b"), (1, "b cc"), (2, "b"), (4, "cc"), (3, None), (None, "b"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.term, r.doc_id): r.tf for r in fulltext.postings(docs).collect()} == {("b", 1): 3, ("bb", 1): 1, ("cc", 1): 1, ("b", 2): 1, ("cc", 4): 1, ("b", None): 2}
    docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.term, r.n_docs) for r in registry.QUERIES["fts_remove"](spark, str(tmp_path)).collect()} == {("b", 1), ("bb", 1), ("cc", 1)}


def test_removal_counts_by_term_alone(spark):
    """No aggregate over pairs of term and document, and documents are removed before their terms are listed."""
    plan = registry.QUERIES["fts_remove"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and plan.index("Generate") < plan.index("LeftAnti")
