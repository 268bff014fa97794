import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from lorewell.llm import decontaminate, simhash
from lorewell.llm.bytetext import Words, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfghjklmnp") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def changed(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def pairs_within(sig, radius):
    found = list(simhash.within(np.ascontiguousarray(sig), np.zeros(len(sig), np.int64), np.full(len(sig), len(sig)), radius, chunk=64))
    return tuple(np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))


def test_within_against_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    sig = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 63, (40, 4)).astype(np.uint64)), rng.integers(0, 1 << 63, (120, 4), dtype=np.uint64)])
    bits = np.unpackbits(sig.view(np.uint8).reshape(len(sig), -1), axis=1)
    for radius in (0, 3, 4, 64, 100, 118):
        i, j = pairs_within(sig, radius)
        want = {(a, b) for a in range(len(sig)) for b in range(a + 1, len(sig)) if (bits[a] != bits[b]).sum() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_copies_go_and_others_stay(spark):
    rng = random.Random(1)
    rows, groups = [], {}
    for g in range(60):
        text = prose(rng, rng.choice([12, 40, 200]))
        for c in range(rng.choice([1, 1, 2, 4])):
            groups.setdefault(g, []).append(len(rows))
            rows.append((len(rows), text if c < 2 else changed(rng, text, 0.04)))
    hot = prose(rng, 80)
    first = len(rows)
    rows += [(first + k, hot) for k in range(3000)]
    rows += [(None, hot), (90001, None), (90002, ""), (90003, "..."), (90004, None)]
    listed = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert all(r.links >= 1 for r in listed.values()) and all(listed[first + i].links == 2999 for i in range(3000))
    got = {i: r.class_id for i, r in listed.items() if r.class_id != i}
    for own in groups.values():
        for i in own[1:]:
            assert rows[i][1] != rows[own[0]][1] or got[i] == own[0]
        assert own[0] not in got
    near = [i for own in groups.values() for i in own[1:]]
    assert sum(i in got for i in near) >= 0.95 * len(near)
    assert all(got[i] == first for i in range(first + 1, first + 3000))
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.where("doc_id > 90000").count() == 4 and kept.where("doc_id is null").count() == 1


def test_recall_against_all_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    s = simhash.signatures(d).toPandas()
    sig = s[["s0", "s1", "s2", "s3"]].to_numpy().view(np.uint64)
    i, j = pairs_within(sig, simhash.RADIUS)
    ids = s["doc_id"].to_numpy()
    parent = {int(x): int(x) for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(ids[i].tolist(), ids[j].tolist()):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent if root(x) != x}
    listed = simhash.near_duplicates(d).collect()
    got = {r.doc_id: r.class_id for r in listed if r.class_id != r.doc_id}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    # links: pairs that share a block, or the signature
    keys, links = np.stack(s["keys"].to_numpy()), dict.fromkeys(ids.tolist(), 0)
    for a, b in zip(i.tolist(), j.tolist()):
        if (keys[a] == keys[b]).any() or (sig[a] == sig[b]).all():
            links[ids[a]], links[ids[b]] = links[ids[a]] + 1, links[ids[b]] + 1
    assert {r.doc_id: r.links for r in listed} == {k: n for k, n in links.items() if n}


def test_signatures_against_definition(spark):
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (1, 2, 3, 9, 120)] + ["one two one two one two", "é É x"]
    got = {r.doc_id: r for r in simhash.signatures(docs(spark, list(enumerate(texts)))).collect()}
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def word(w):
        b = w.encode()
        return mix((len(b) + sum(c * 256 ** (i % 8) * pow(0x9E3779B97F4A7C15, i // 8 + 1, 1 << 64) for i, c in enumerate(b))) & m)

    def run(ws):
        acc = 0
        for w in ws:
            acc = (acc * 0x9E3779B97F4A7C15 + w) & m
        return mix(acc)

    for d, text in enumerate(texts):
        ws = [word(w) for w in re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.lower())]
        feats = {run(ws[i : i + 2]) for i in range(len(ws) - 1)} if len(ws) > 1 else set(ws)
        for lane in range(4):
            own = [f if lane == 0 else mix((f + mix(lane + 1)) & m) for f in feats]
            sig = sum((2 * sum(f >> b & 1 for f in own) > len(own)) << b for b in range(64))
            assert got[d][f"s{lane}"] & m == sig
        runs = [run(ws[i : i + 4]) for i in range(len(ws) - 3)] or [mix(sum(ws) & m)]
        assert [k & m for k in got[d].keys] == [mix(min(mix(r ^ mix(9 + j)) for r in runs) + mix(33 + j) & m) for j in range(8)]


def test_many_close_signatures_in_little_memory():
    code = """
import resource, numpy as np, pyarrow as pa
from lorewell.llm import simhash
rng = np.random.default_rng(0)
base, n = rng.integers(0, 1 << 63, 4, dtype=np.uint64), 20_000
sig = np.repeat(base[None], n, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (n, 4)).astype(np.uint64))
keys = pa.ListArray.from_arrays(np.arange(0, 9 * n + 1, 9, dtype=np.int32), pa.array(np.full(9 * n, 5)))
side = np.zeros(n, np.int32)
cols = {"rep": np.arange(n), "n": np.ones(n, np.int64), "turn": np.zeros(n, np.int32), **{f"s{k}": sig[:, k].view(np.int64) for k in range(4)}, "key": np.full(n, 5), "tile": np.arange(n) // 4096, "side": side}
batch = pa.RecordBatch.from_arrays([*map(pa.array, cols.values()), keys], names=[*cols, "keys"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = pa.Table.from_batches(list(simhash._match(64)(batch.slice(k, 1000) for k in range(0, n, 1000)))).to_pandas()
links = out[out.b.isna()].set_index("a").links
sizes = np.bincount(np.arange(n) // 4096)
assert (links.sort_index().to_numpy() == np.repeat(sizes, sizes) - 1).all()
assert len(out[~out.b.isna()]) == n - len(sizes)
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_dedup_of_odd_tables(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    twice = docs(spark, [(1, "one and the same text here"), (1, "one and the same text here"), (2, "one and the same text here")])
    assert simhash.drop_near_duplicates(twice).count() == 2
    extra = docs(spark, [(5, "a b c"), (6, "a b c")]).selectExpr("*", "1 as s0", "2 as keys", "3 as rep", "4 as component", "5 as __gone")
    assert simhash.drop_near_duplicates(extra).count() == 1


def tiled_by_hand(doc, item, least):
    """Greedy string tiling as it is defined: look through all pairs of places for the longest unmarked matches."""
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    while True:
        best, found = least, []
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while b + n < len(item) and a + n < len(doc) and item[b + n] == doc[a + n] and not in_item[b + n] and not in_doc[a + n]:
                    n += 1
                if n > best:
                    best, found = n, [(b, a)]
                elif n == best and n >= least:
                    found.append((b, a))
        if not found:
            return sum(in_item)
        for b, a in found:
            if not any(in_item[b : b + best]) and not any(in_doc[a : a + best]):
                in_item[b : b + best] = [True] * best
                in_doc[a : a + best] = [True] * best


def test_tiling_against_definition():
    rng = random.Random(2)
    for _ in range(200):
        words = [str(i) for i in range(rng.choice([3, 8, 30]))]
        item, doc = ([rng.choice(words) for _ in range(rng.randint(5, 25))] for _ in "ab")
        if rng.random() < 0.7:
            doc = doc[:5] + item[10:] + doc[5:9] + item[:10]
        bench, text = " ".join(item), " ".join(doc)
        w = Words(*utf8(pa.array([text])))
        items = decontaminate.Items(np.array([7]), pa.array([bench]), 3)
        got = decontaminate._matches(w, items, 1e-9)
        assert (round(got[0][2] * len(item)) if got else 0) == tiled_by_hand(doc, item, 3)


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_leaks(spark, most):
    rng = random.Random(3)
    items = [prose(rng, 30) for _ in range(20)]
    rows = []
    for i, item in enumerate(items):
        w = item.split()
        rows.append((i, prose(rng, 50) + " " + item.upper() + ", " + prose(rng, 50)))
        rows.append((100 + i, prose(rng, 20) + " " + " ".join(w[15:]) + " " + prose(rng, 20) + " " + " ".join(w[:15])))
        rows.append((200 + i, prose(rng, 300)))
        rows.append((300 + i, prose(rng, 20) + " " + " ".join(w[:8]) + " " + prose(rng, 20)))
    rows += [(None, items[0]), (900, None), (901, ""), (0, rows[0][1])]
    bench = spark.createDataFrame([*enumerate(items), (None, "x y"), (50, None), (51, ""), (52, "..."), (0, items[0])], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, rows), bench, broadcast_bytes=most)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(b + i, i) for i in range(20) for b in (0, 100)}
    assert got.count() == 40 and all(r.coverage == 1.0 for r in got.where("doc_id < 100").collect())
    kept = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert kept.where("doc_id >= 200").count() == 42 and kept.where("doc_id < 200").count() == 0 and kept.where("doc_id is null").count() == 1


def test_hot_seeds_lose_no_leak(spark):
    """Items that share a passage with each other and with every document, and partial leaks around the threshold, in both ways."""
    rng = random.Random(13)
    hot = prose(rng, 12)
    items = [prose(rng, 10) + " " + hot + " " + prose(rng, rng.randint(5, 15)) for _ in range(30)] + ["x y x y x y x y x y x y", "a b c", hot, prose(rng, 9)]
    rows = []
    for i in range(300):
        w = rng.choice(items).split()
        k, n = rng.randint(0, len(w)), rng.randint(0, len(w))
        rows.append((i, prose(rng, rng.randint(0, 30)) + " " + rng.choice(["", hot]) + " " + " ".join(w[k : k + n]) + " " + prose(rng, 5) + " " + " ".join(w[:k])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    a, b = (sorted(map(tuple, decontaminate.leaks(docs(spark, rows), bench, broadcast_bytes=most).collect())) for most in (1 << 30, 0))
    assert a == b and len(a) > 100
    for d, m, coverage, _ in a[:40]:
        item = re.findall("[0-9a-z]+", items[m])
        assert round(coverage * len(item)) == tiled_by_hand(re.findall("[0-9a-z]+", rows[d][1]), item, min(5, len(item)))


def test_ties_of_texts_under_one_id(spark):
    a, b, c = "p q r s t", "u v w x y", "k l m n o"
    bench = spark.createDataFrame([(1, f"{a} {b}")], "item_id long, text string")
    rows = [(7, f"{a} {c} {b}"), (7, f"{a} {b}"), (7, f"{b} {a}"), (7, a)]
    for _ in range(2):
        assert [tuple(r) for r in decontaminate.leaks(docs(spark, rows), bench).collect()] == [(7, 1, 1.0, 1)]
        rows.reverse()


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, [(1, "a b c d e f")]), bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs(spark, [(1, "A, b; c d e f")]).selectExpr("*", "1 as item_id", "2 as coverage", "3 as seed"), bench).count() == 1
