"""Scores of single rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

K1, B, RRF_K, HALF_LIFE_SECONDS = 1.2, 0.75, 60, 72 * 3600.0


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def bm25_term(tf: Column, dl: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    """What one term adds: ``weight`` is its idf."""
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.coalesce(F.try_divide(dl, avgdl), F.lit(0.0))))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank; nothing for a list in which the row isn't."""
    return F.coalesce(F.lit(1.0) / (rank + F.lit(k)), F.lit(0.0))


def recency(age_seconds: Column, half_life: float = HALF_LIFE_SECONDS) -> Column:
    """Halves with every half-life; the future counts as now; no half-life, no decay."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.exp(-math.log(2.0) * F.greatest(age_seconds.cast("double"), F.lit(0.0)) / half_life)


def agent_score(relevance: Column, recent: Column, importance: Column, w: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> Column:
    return w[0] * relevance + w[1] * recent + w[2] * importance


def prior(used: Column, shown: Column) -> Column:
    """Share of uses, smoothed; 0 for what was never shown."""
    return F.when(shown.isNull(), F.lit(0.0)).otherwise((F.coalesce(used, F.lit(0)) + 1.0) / (shown + 3.0))


def boost(prior_: Column, affinity: Column, base: Column, w_prior: float = 0.15, w_affinity: float = 0.20, most: float = 0.5) -> Column:
    return F.least(w_prior * prior_ + w_affinity * affinity, most * base)
