"""How queries over the driver's tables are declared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.functions.text import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def declare(queries: dict[str, Callable], oracles: dict[str, str]):
    """Decorator that registers a function under its name, with its SQL if there is any."""

    def with_sql(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return with_sql


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(column: str = "text") -> str:
    """DuckDB's analyzer ``en``."""
    return rf"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{Nd}}]+'), lambda w: not list_contains([{_STOPS}], w))"


def bm25_sql(terms: list[str], top: int | None, where: str = "true") -> str:
    """CTEs ``tok`` to ``lex`` (doc_id, score): BM25 of the terms (repeated ones count repeatedly), cut to the best."""
    values = ", ".join(f"('{t}')" for t in terms)
    cut = f"limit {top}" if top else ""
    return f"""tok as (select doc_id, {where} as ok, {tokens_sql()} as t from documents),
len as (select doc_id, ok, len(t)::double as dl from tok where len(t) > 0),
tot as (select count(*)::double as n, avg(dl) as avgdl from len),
post as (select doc_id, w, count(*)::double as tf from (select doc_id, unnest(t) as w from tok) where w in (select w from (values {values}) v(w)) group by 1, 2),
df as (select w, count(*)::double as df from post group by 1),
asked as (select w from (values {values}) v(w)),
lex as (select doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from asked join post using (w) join df using (w) join len using (doc_id), tot where ok group by doc_id order by score desc, doc_id {cut})"""
