"""The operators leave nothing out: no pruned counts, no lost pieces, no skipped rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lorewell.llm import neighbours, oracles, personal, queries, spans

DIR = "/root/testdata/sf0.001"


# --- op3 --------------------------------------------------------------------
def test_language_model_keeps_ngrams_that_occur_once(spark):
    sql = oracles.LANGUAGE_MODEL
    assert "having" not in sql
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"select doc_id, n_words, log_prob, perplexity from ({sql})").fetchall()}
    got = queries.op3_language_model(spark, DIR).collect()
    assert len(got) == len(want)
    for r in got:
        n, lp, ppl = want[r.doc_id]
        assert r.n_words == n and r.log_prob == pytest.approx(lp, abs=2e-4) and r.perplexity == pytest.approx(ppl, abs=2e-3)


# --- op8 --------------------------------------------------------------------
def test_personal_data_at_the_edge_of_a_text():
    data = np.frombuffer(b"a@b.coc@d.eu" + b"1.2.3.4" + b"5.6.7.8", np.uint8)
    labels = np.repeat([1, 3], [12, 14]).astype(np.uint8)
    offsets = np.array([0, 6, 6, 12, 19, 26])  # the second text is empty
    assert personal.spans(labels, data, offsets) == [(0, 6, 1), (6, 12, 1), (12, 19, 3), (19, 26, 3)]


def test_rows_that_are_only_personal_data():
    mails = [f"mail{i}.jones@mail{i % 7}.example.com" for i in range(10, 40)]
    numbers = [f"192.168.{i}.77" for i in range(10, 40)]
    for values, mark in ((mails, "[EMAIL]"), (numbers, "[IP]")):
        alone = [personal.redact(personal.load(), pa.array([v]))[0].as_py() for v in values]
        assert alone.count(mark) >= 28
        assert personal.redact(personal.load(), pa.array(values)).to_pylist() == alone  # whatever stands in the same batch


@pytest.mark.parametrize(
    "kind, pieces",
    [
        (1, ["a.b@mail.example.com", "x_y@example.co.uk", "p+q@ex-am.de"]),
        (2, ["+1 (212) 555-0199", "+49 30 1234 5678", "+33 1 22 33 44 55", "+491234567890"]),
        (2, ["555-123-4567", "555-987-6543", "(212) 555-0199", "212.555.0199"]),
        (3, ["10.0.0.1", "192.168.1.77", "8.8.8.8"]),
        (4, ["4111111111111111", "4111 1111 1111 1111", "4222-2222-2222-2222", "371449635398431"]),
        (5, ["0123456789abcdef0123456789abcdef", "ghp_abcdefghij0123456789klmnopqrstuvwxyz"]),
    ],
)
def test_lists_are_split_into_their_pieces(kind, pieces):
    for between in (" ", ",", "\n", ", ", ";"):
        value = between.join(pieces).encode()
        labels = np.full(len(value), kind, np.uint8)
        one_run = personal.spans(labels, np.frombuffer(value, np.uint8), np.array([0, len(value)]))
        at = 0
        for x in pieces[:-1]:
            labels[at + len(x) : at + len(x) + len(between)] = 0
            at += len(x) + len(between)
        for got in (one_run, personal.spans(labels, np.frombuffer(value, np.uint8), np.array([0, len(value)]))):
            assert [value[a:b].decode() for a, b, _ in got] == pieces


@pytest.mark.parametrize("kind, value", [(1, b"a.b@mail.example.com"), (2, b"+1 (212) 555-0199"), (2, b"+33 1 22 33 44 55"), (2, b"+49 123 4567890"), (4, b"4111 1111 1111 1111"), (2, b"555-123-4567 ext 12"), (4, b"4111 1111 1111 1111 111")])
def test_one_item_stays_one(kind, value):
    assert personal.items(kind, value) == [(0, len(value))]


def test_made_up_items_stay_one():
    rng = np.random.default_rng(21)
    for kind, make in ((1, spans.email), (2, spans.phone), (3, spans.ip), (4, spans.card), (5, lambda r: spans.secret(r)[1])):
        for _ in range(500):
            value = make(rng).encode()
            assert personal.items(kind, value) in ([(0, len(value))], [])


# --- pipeline ---------------------------------------------------------------
def test_stages_decide_by_row(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    leak, clean = " ".join(f"q{i}" for i in range(30)), " ".join(f"z{i}" for i in range(60))
    rows = [(None, a), (7, a), (7, a), (3, a), (None, b), (None, b), (7, c), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path))
    key = lambda r: tuple(map(str, r))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(3, a), (None, b), (7, c), (3, None), (None, "")], key=key)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, leak), (5, leak + " " + clean), (5, clean), (None, clean), (6, None)]
    got = corpus_pipeline.benchmark_decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(5, clean), (None, clean), (6, None)], key=key)


# --- op6 --------------------------------------------------------------------
def test_vectors_of_every_length_have_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0]), (6, [1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.id, r.neighbour) for r in neighbours.neighbours(t).orderBy("id", "rank").collect()]
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1), (4, 5), (5, 4)]
