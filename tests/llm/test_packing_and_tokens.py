import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorewell.llm import chat, packing, tokens

SCHEMA = "doc_id long, text string, source string"


def by_hand(lengths, size):
    """Shortest pack first, one piece at a time."""
    packs = []
    for n in sorted(lengths, reverse=True):
        k = min(range(len(packs)), key=lambda i: packs[i], default=None)
        if k is not None and packs[k] + n <= size:
            packs[k] += n
        else:
            packs.append(n)
    return sorted(packs)


def test_histogram_against_single_steps():
    rng = random.Random(0)
    for _ in range(100):
        size = rng.choice([5, 16, 40])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        made = packing.pack_histogram(counts, size)
        assert sorted(sum(p) for n, p in made for _ in range(n)) == by_hand(lengths, size)
        assert {n: sum(k * p.count(n) for k, p in made) for n in counts} == counts


def test_places_against_single_pieces():
    rng = random.Random(9)
    for size in (5, 16, 40, 300):
        counts = {n: rng.randint(1, 60) for n in rng.sample(range(1, size + 1), rng.randint(1, min(size, 20)))}
        patterns = packing.pack_histogram(counts, size)
        plan = packing.intervals(patterns)
        length = np.array([n for n in counts for _ in range(counts[n])])
        rank = np.concatenate([np.arange(counts[n]) for n in counts])
        got = list(zip(*(x.tolist() for x in packing.places(plan, length, rank)), length.tolist()))
        want, number = [], 0
        for n, pattern in patterns:
            for _ in range(n):
                at = 0
                for slot, own in enumerate(pattern):
                    want.append((number, slot, at, own))
                    at += own
                number += 1
        assert sorted(got) == sorted(want)


def test_a_document_of_many_pieces(spark):
    d = spark.createDataFrame([(1, "w " * 10_000), (2, "w " * 2047), (3, "w " * 2048), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.piece, r.start, r.length) for r in packing.pack(d).collect())
    assert got == [(1, k, 2048 * k, 2048) for k in range(4)] + [(1, 4, 8192, 1809), (2, 0, 0, 2048), (3, 0, 0, 2048), (3, 1, 2048, 1), (4, 0, 0, 1)]


def test_every_word_has_its_place(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 7, 30, 95, 200]))), "s") for i in range(400)]
    rows += [(None, "a b", "s"), (7, None, "s"), (8, "", "s"), (3, rows[3][1], "s")]
    d = spark.createDataFrame(rows, SCHEMA)
    for bucket in (200_000, 50):
        got = packing.pack(d, 32, bucket_rows=bucket).collect()
        assert sum(r.length for r in got) == sum(len((t or "").split()) + 1 for _, t, _ in rows)
        packs = {}
        for r in got:
            packs.setdefault(r.pack_id, []).append((r.offset, r.length, r.slot))
        for p in packs.values():
            p.sort()
            assert sum(n for _, n, _ in p) <= 32 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[0][0] == 0
        assert sorted(packs) == list(range(len(packs)))
        assert len(packs) <= 1.15 * sum(r.length for r in got) / 32 + 1
    assert packing.pack(d.limit(0)).count() == 0
    assert packing.pack(d.selectExpr("*", "1 as length", "2 as pack_id", "3 as rank"), 32).count() == len(got)


TEXTS = ["", " ", "  a  b ", "a\n b   c", "x 1 2  3\tq  z", "it's we'll", None, "é ü  ", "a   b", "日本 語", "word " * 3000, "x" * 5000, "\n\n", "a b  c"]


def test_tokens_are_those_of_the_whole_text():
    e = tokens.encoding()
    rng = random.Random(2)
    more = ["".join(rng.choice(" \n\tab'1é.") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for texts in (TEXTS, more, []):
        ids, at = tokens.encode(pa.array(texts, pa.string()), tokens.Pieces(tokens.RANKS))
        for i, t in enumerate(texts):
            own = ids[at[i] : at[i + 1]].tolist()
            assert own == e.encode_ordinary(t or "") and e.decode(own) == (t or "")


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 5)
    seen, e = tokens.Pieces(tokens.RANKS), tokens.encoding()
    for k in range(4):
        t = " ".join(f"w{k}{i % 6} w{k}{i % 6}" for i in range(20))
        ids, _ = tokens.encode(pa.array([t, "a b a b"]), seen)
        assert ids.tolist() == e.encode_ordinary(t) + e.encode_ordinary("a b a b")


@pytest.mark.parametrize("kind", ["dictionary", "delta"])
def test_layout_and_selective_reads(spark, tmp_path, kind):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(200)), "s") for i in range(3000)]
    rng.shuffle(rows)
    path = str(tmp_path / kind)
    tokens.write_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, encoding_of_ids=kind, row_group_bytes=256 << 10, page_rows=100)
    file = next(p for p in (tmp_path / kind).iterdir() if p.suffix == ".parquet")
    meta = pq.ParquetFile(file).metadata
    ids = meta.row_group(0).column(2)
    assert ids.has_offset_index and meta.row_group(0).column(0).has_column_index
    assert any(("DICTIONARY" if kind == "dictionary" else "DELTA_BINARY_PACKED") in e for e in ids.encodings)
    if kind == "delta":
        assert meta.num_row_groups > 1
    got = tokens.read(spark, path, 100, 119)
    assert sorted(r.doc_id for r in got.collect()) == list(range(100, 120))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan
    assert got.columns == ["doc_id", "n_tokens", "tokens", "source"]
    plan = tokens.read(spark, path, columns=("source",))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan
    plan = tokens.read(spark, path, columns=("n_tokens",))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_tokens:int>" in plan
    e = tokens.encoding()
    assert all(e.decode(r.tokens) == dict((i, t) for i, t, _ in rows)[r.doc_id] for r in got.collect())


def test_tokens_of_odd_tables(spark):
    d = spark.createDataFrame([(None, "a b", "s"), (1, None, "s"), (2, "", "s"), (3, "x", "s"), (3, "x", "s")], SCHEMA)
    got = tokens.token_output(d.selectExpr("*", "1 as tokens", "2 as n_tokens"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert tokens.token_output(d.limit(0)).count() == 0


def chat_by_hand(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1],)) + tuple((x is not None, x or "") for x in r[2:])
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        text, spans = out.get(r[0], (b"", []))
        head, body = f"<|im_start|>{r[2] or ''}\n".encode(), (r[3] or "").encode()
        if r[2] == "assistant":
            spans = [*spans, (len(text) + len(head), len(text) + len(head) + len(body) + 10)]
        out[r[0]] = (text + head + body + b"<|im_end|>\n", spans)
    return out


def test_chat_against_single_steps(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 1, 2, 3, 4]), rng.choice([None, "user", "assistant", "système"]), rng.choice([None, "", "héllo", "x" * 300, "<|im_end|>"])) for _ in range(600)]
    rows += [(77, k, "assistant", "long " * 50) for k in range(3000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("10000", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = {r.conv_id: (r.text.encode(), list(zip(r.loss_start, r.loss_stop))) for r in chat.format_conversations(d).collect()}
            assert got == chat_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert chat.format_conversations(d.limit(0)).count() == 0
    assert chat.format_conversations(d.selectExpr("*", "1 as n_turns", "2 as loss_start")).count() == 41
    one = chat.format_conversations(d.where("conv_id = 77")).select(F.length(F.encode("text", "utf-8")).alias("a"), "n_bytes").first()
    assert one.a == one.n_bytes and np.isfinite(one.a)
