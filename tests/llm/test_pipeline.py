import corpus_pipeline
from lorewell.llm import decontaminate, personal, quality, simhash
from lorewell.shared import shared_path

DIR = "/root/testdata/sf0.01"


def test_each_stage_on_what_the_one_before_kept(spark):
    """Stages one by one against what the operators' listings say about the same rows."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, DIR).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{DIR}/labels.parquet")
            marked = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
            assert sum(marked[i] == (i in after) for i in marked) >= 0.95 * len(marked)
            net = quality.train(docs, labels)
            p = docs.select("doc_id", quality.probability(net, docs["text"]).alias("p")).collect()
            assert after == {r.doc_id for r in p if r.p >= quality.THRESHOLD}
        elif name == "simhash_near_dedup":
            assert before - after == {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id != r.class_id}
        elif name == "benchmark_decontamination":
            assert before - after == {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
        elif name == "pii":
            assert after == before
            found = {r.doc_id for r in personal.personal_data(docs).collect()}
            old, new = ({r.doc_id: r.text for r in d.collect()} for d in (docs, out))
            assert {i for i in old if old[i] != new[i]} == found
        docs, last = out, after
    assert last == before and docs.count() >= len(before)
    assert corpus_pipeline.run(spark, DIR).count() == docs.count()


def test_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def write_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, keys string, __row string, `class_id` string"


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    same = "quite the same words stand in these rows, again and again, line by line"
    leak = "before it One two, three four five six seven and after it"
    mail = "please write to anna.meier@example.org about the plan for the next year"
    texts = [(1, same), (2, same), (2, same), (None, same), (3, leak), (None, leak + " more"), (4, mail), (5, None), (None, None), (6, ""), (7, "..."), (8, "x")]
    rows = [(i, t, None, None, len(t) if t else None, "a", "b", "c", "d") for i, t in texts]
    write_tables(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 4, 5, 6, 7, 8] and sum(r.length for r in got) == 15 + 12 + 4 * 1 + 2  # words and end marks; an address becomes one word
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, spark.createDataFrame([], SCHEMA))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_text_of_megabytes(spark, tmp_path):
    words = ["".join("bdklmnrst"[k % 9] + "aeiou"[k % 5] for k in (i % 45, i * i % 97, i % 7)) for i in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "short one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "", "", "", "") for i, t in rows], SCHEMA)
    write_tables(spark, tmp_path, docs)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 400_001 and {r.doc_id for r in got} == {1, 3}
