from pyspark.sql import functions as F

from lorewell.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_english_tokens(spark):
    assert one(spark, "The Quick Brown Fox Jumps Over The Lazy Dog", T.tokens_en) == "quick brown fox jumps over lazy dog".split()
    assert one(spark, "Ｈｅｌｌｏ", T.tokens_en) == ["hello"]
    assert one(spark, "", T.tokens_en) == []
    assert one(spark, None, T.tokens_en) is None


def test_bigrams(spark):
    assert one(spark, "hello", T.tokens_bigram) == ["he", "el", "ll", "lo"]
    assert one(spark, "東京タワー", T.tokens_bigram)[0] == "東京" and len(one(spark, "東京タワー", T.tokens_bigram)) == 4
    assert one(spark, "a", T.tokens_bigram) == [] and one(spark, "", T.tokens_bigram) == []
    assert one(spark, "ab c\td", T.tokens_bigram) == ["ab", "c\t", "\td"]
    assert one(spark, "😀😀x", T.tokens_bigram) == ["😀😀", "😀x"]


def test_normalization_reaches_python_only_where_needed(spark):
    import unicodedata

    for s in ("plain", "Éà ﬁ", "é", "½ ²", "Ĳ", "ÀÉñœ – “x”", "東京ﾀﾜｰ"):
        assert one(spark, s, T.normalize) == unicodedata.normalize("NFKC", s).lower()


def test_chunks():
    assert T.chunk("Hello world, this is a short text.") == ["Hello world, this is a short text."]
    made = T.chunk("This is sentence number. " * 20, 50, 10)
    assert len(made) >= 2 and all(c == c.strip() for c in made)
    assert T.chunk("x" * 600) == ["x" * 600]


def test_code_chunks(spark):
    code = "import a\n" + "".join(f"def f{i}():\n    pass\n" for i in range(4))
    rows = [(1, code), (2, "a\nb"), (3, "\n".join(f"line {i}" for i in range(100)))]
    got = T.code_chunks(spark.createDataFrame(rows, "doc_id long, text string"), most=4).orderBy("doc_id", "ord").collect()
    by = {d: [r.text for r in got if r.doc_id == d] for d in (1, 2, 3)}
    assert by[1][0] == "import a" and len(by[1]) == 5 and by[2] == ["a\nb"] and len(by[3]) == 25
    assert "\n".join(by[1]) == code


def test_small_things(spark):
    assert one(spark, " a,b\t,, c ", T.split_tags) == ["a", "b", "c"]
    assert one(spark, "x" * 2001, T.truncate_for_prompt) == "x" * 2000 + "..."
    assert one(spark, "One. Two! 三。x", T.sentences) == ["One.", " Two!", " 三。", "x"]
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 20,), (1280,), (1792,), (1536,)], "n long").select(T.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["5 B", "2.0 KB", "3.0 MB", "1.2 KB", "1.8 KB", "1.5 KB"]
