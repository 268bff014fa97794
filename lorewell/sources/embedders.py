"""Embedders and language models as plug-ins: batches of texts in, vectors or answers out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def embedder(embed: Callable[[list[str]], Iterable[list[float] | None]]) -> Callable[[Column], Column]:
    """Column function from a batch embedder; a null text has a null vector."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        some = [i for i, t in enumerate(values) if t is not None]
        out: list = [None] * len(values)
        for i, v in zip(some, embed([values[i] for i in some])):
            out[i] = None if v is None else [float(x) for x in v]
        return pa.array(out, pa.list_(pa.float32()))

    return lambda text: run(text)


def mock_vector(text: str, dim: int) -> list[float]:
    """Deterministic unit vector: FNV-1a of the text seeds a linear congruential sequence."""
    seed = 0xCBF29CE484222325
    for byte in text.encode():
        seed = ((seed ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    out = []
    for _ in range(dim):
        seed = (seed * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append((seed - (1 << 64) if seed >> 63 else seed) / float((1 << 63) - 1))
    size = math.sqrt(sum(v * v for v in out))
    return [float(np.float32(float(np.float32(v)) / size)) for v in out] if size else out


def mock_embedder(dim: int) -> Callable[[Column], Column]:
    return embedder(lambda texts: [mock_vector(t, dim) for t in texts])


JOBS = {
    "extract": "List the entities and relations of this text as JSON with the keys entities and relations.\n",
    "autotag": "Give a JSON array of tags for this text.\n",
    "importance": 'Rate the importance of this text as JSON {"score": 0..1}.\n',
}


def organize(memories: DataFrame, complete: Callable[[str], str] | None, jobs: tuple[str, ...] = ("extract", "autotag", "importance")) -> DataFrame:
    """(id, extract, autotag, importance): a model's answers for each memory (id, prompt).

    An error skips the rest of that memory's jobs; without a model, and for jobs
    not asked for, answers are null.
    """
    unknown = set(jobs) - {*JOBS, "dedup"}
    if unknown:
        raise ValueError(f"unknown jobs: {sorted(unknown)}")

    def run(frames):
        for frame in frames:
            rows = []
            for id_, prompt in zip(frame["id"], frame["prompt"]):
                answers: dict[str, str | None] = dict.fromkeys(JOBS)
                for job in jobs:
                    if complete is None or job == "dedup":
                        continue
                    try:
                        answers[job] = complete(JOBS[job] + prompt)
                    except Exception:  # noqa: BLE001 - whatever the model's client raises, this memory is done
                        break
                rows.append((id_, *(answers[j] for j in JOBS)))
            yield pd.DataFrame(rows, columns=["id", *JOBS])

    return memories.select("id", "prompt").mapInPandas(run, "id string, extract string, autotag string, importance string")
