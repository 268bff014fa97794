"""Registered queries and their SQL."""

from __future__ import annotations

from lorewell.plans import analytics, graphs, organising, retrieval, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (texts, retrieval, graphs, analytics, organising):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
