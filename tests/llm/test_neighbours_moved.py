import numpy as np
from pyspark.sql import functions as F

from lorewell.llm import neighbours


def shuffled(spark):
    """Bytes that all stages so far have written for exchanges."""
    sc = spark.sparkContext
    jvm, context = sc._jvm, sc._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    stages = context.statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_queries_that_ask_many_parts_are_not_moved_to_each(spark):
    """In random directions no part can be left out: what is moved must grow with the table, not with queries times parts."""
    x = np.random.default_rng(3).normal(0, 1, (12_000, 32)).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    t.count()
    before = shuffled(spark)
    got = neighbours.neighbours(t, queries=F.col("vec_id") % 20 == 0, part_rows=32, sample=4000).toPandas()
    moved = shuffled(spark) - before
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0.0
    for i, own in got.groupby("id"):
        s = unit @ unit[i]
        s[i] = -9
        hits += np.isin(own.neighbour, np.argsort(-s)[:10]).mean()
    assert set(got.id) == set(range(0, 12_000, 20)) and hits / 600 >= 0.9
    assert moved < 4 * x.nbytes


def test_copies_in_several_batches():
    """Of copies the first of each run stay, wherever batches end."""
    a, b = np.eye(2, dtype=np.float32)
    rows = [(7, 1, a), (7, 1, a), (7, 2, a), (7, 3, a), (7, 4, a), (7, 4, b), (7, 4, b), (7, 9, b), (8, 5, b), (8, 6, b), (8, 7, b)]
    for size in range(1, len(rows) + 1):
        held = neighbours.Held(None, 2)
        for lo in range(0, len(rows), size):
            node, ids, x = (np.array(c) for c in zip(*rows[lo : lo + size]))
            held.add(node, ids, x)
        kept = {n: [int(i) for ids, _ in own for i in ids] for n, own in held.parts.items()}
        assert kept == {7: [1, 2, 4, 9], 8: [5, 6]}
