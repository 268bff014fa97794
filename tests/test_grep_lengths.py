import random
import re

from pyspark.sql import functions as F

from lorewell.operators import grep


def test_no_text_travels_to_python(spark):
    """A batch in Python holds lengths, whatever the size of the texts."""
    docs = spark.createDataFrame([(1, "an orre")], "doc_id long, text string")
    for regex in (False, True):
        call = grep.grep(docs, "orre", regex=regex)._jdf.queryExecution().analyzed().expressions().apply(1).child()
        assert call.children().apply(0).dataType().simpleString() == "array<int>"


def test_spans_against_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aaab.\\Eé東😀 \n") for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "a" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def bytes_of(t, spans):
        return [(len(t[:a].encode()), len(t[:b].encode())) for a, b in spans]

    def got(*args, **kwargs):
        return {r.doc_id: [tuple(s) for s in r.spans] for r in grep.grep(docs, *args, **kwargs).collect()}

    for p in ("a", "aa", "aba", "\\E", "é", "😀", "a.", "\n"):
        want = {i: bytes_of(t, [(m.start(), m.start() + len(p)) for m in re.finditer(f"(?={re.escape(p)})", t)]) for i, t in enumerate(texts) if t and p in t}
        assert got(p) == want, p
    assert got("AA", case_sensitive=False) == {i: bytes_of(t.lower(), [(m.start(), m.start() + 2) for m in re.finditer("(?=aa)", t.lower())]) for i, t in enumerate(texts) if t and "aa" in t.lower()}
    for p in ("a+", "ab|b", "[é東😀]+", "(a)(b)"):
        assert got(p, regex=True) == {i: bytes_of(t, [m.span() for m in re.finditer(p, t)]) for i, t in enumerate(texts) if t and re.search(p, t)}, p
    empty = got("b*", regex=True)
    assert all(spans[k][0] > spans[k - 1][1] or spans[k][1] > spans[k][0] for spans in empty.values() for k in range(1, len(spans)))
    assert {i: [s for s in spans if s[1] > s[0]] for i, spans in empty.items() if "b" in texts[i]} == {i: bytes_of(t, [m.span() for m in re.finditer("b+", t)]) for i, t in enumerate(texts) if t and "b" in t}


def test_spans_of_batches_without_hits(spark):
    docs = spark.range(20, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "x orre orre").otherwise("none").alias("text"))
    assert [[tuple(s) for s in r.spans] for r in grep.grep(docs, "orre").collect()] == [[(2, 6), (7, 11)]]
