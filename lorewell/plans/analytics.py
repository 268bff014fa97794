"""Search metrics and usage, with ``events`` as the log.

click, view, purchase and signup are searches of mode fts, vector, hybrid and grep,
error one of an unknown mode; ``value`` is the latency.  As usage: the user is the
item, the event's type the term, every event an impression and a purchase a use.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import fulltext, metrics, usage
from lorewell.plans.base import declare, table, tokens_sql
from lorewell.plans.graphs import triples

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = declare(QUERIES, ORACLES)

_LOG = (
    "log as (select 'events' as collection, case event_type when 'click' then 'fts' when 'view' then 'vector' when 'signup' then 'grep' else 'hybrid' end as mode,"
    " least(10, (props->>'$.k')::bigint % 13) as returned, 10 as requested, value as latency_ms, ts from events)"
)
_SUMS = "count(*)::bigint as searches, sum(returned)::bigint as returned, sum(requested)::bigint as requested, count(*) filter (returned < requested)::bigint as underfilled"


def search_log(events):
    mode = F.create_map(*map(F.lit, ("click", "fts", "view", "vector", "purchase", "hybrid", "signup", "grep")))
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.lit("events").alias("collection"), F.coalesce(F.try_element_at(mode, F.col("event_type")), F.lit("unknown")).alias("mode"), F.least(F.lit(10), k % 13).alias("returned"), F.lit(10).cast("long").alias("requested"), F.col("value").alias("latency_ms"), "ts"
    )


def usage_log(events):
    item = F.array(F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").cast("string").alias("query_id"), F.lit("").alias("collection"), F.array("event_type").alias("terms"), item.alias("impressions"), F.when(F.col("event_type") == "purchase", item).otherwise(F.array().cast("array<string>")).alias("used"), F.col("ts").cast("timestamp").alias("at")
    )


def _log(spark, sf_dir):
    return search_log(table(spark, sf_dir, "events"))


@query(f"with {_LOG} select collection, mode, {_SUMS} from log group by 1, 2")
def metrics_counts(spark, sf_dir):
    return metrics.counts(_log(spark, sf_dir))


@query(f"with {_LOG} select round(sum(returned) / sum(requested)::double, 6) as fill_rate from log")
def metrics_fill_rate(spark, sf_dir):
    return metrics.fill_rate(_log(spark, sf_dir))


@query(f"with {_LOG} select mode, count(*)::bigint as searches, round(count(*) / sum(count(*)) over ()::double, 6) as share from log group by 1")
def metrics_mode_share(spark, sf_dir):
    return metrics.mode_share(_log(spark, sf_dir))


@query(
    f"with {_LOG} select mode, case when latency_ms <= 1 then '<=1' when latency_ms <= 5 then '<=5' when latency_ms <= 10 then '<=10' when latency_ms <= 25 then '<=25' when latency_ms <= 50 then '<=50'"
    " when latency_ms <= 100 then '<=100' when latency_ms <= 250 then '<=250' when latency_ms <= 500 then '<=500' else '>500' end as bucket, count(*)::bigint as searches from log where latency_ms is not null group by 1, 2"
)
def metrics_latency_hist(spark, sf_dir):
    return metrics.latency_histogram(_log(spark, sf_dir))


@query(f"with t as (select unnest({tokens_sql()}) as term from documents) select term, count(*)::bigint as n from t group by 1 order by n desc, term limit 20")
def metrics_top_terms(spark, sf_dir):
    return metrics.top_terms(fulltext.exploded(fulltext.tokens(table(spark, sf_dir, "documents"))), 20)


@query("with t as (select event_type as term, count(*) * 0.001 as n from events group by 1) select term, round(n, 6)::double as n from t where n >= 0.01")
def metrics_term_decay(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("term")).agg(F.count("*").cast("double").alias("n"))
    return metrics.decay(counted, 0.001).select("term", F.round("n", 6).alias("n"))


@query(f"with {_LOG} select collection, mode, {_SUMS}, round(sum(returned) / sum(requested)::double, 6) as fill_rate from log group by rollup (collection, mode)")
def metrics_rollup(spark, sf_dir):
    return metrics.snapshot(_log(spark, sf_dir))


@query(f"with {_LOG} select date_trunc('day', ts)::date::varchar as day, collection, mode, {_SUMS} from log group by 1, 2, 3")
def metrics_daily(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("mode", metrics.mode_of(F.col("mode")))
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "collection", "mode").agg(*metrics._sums())


@query(
    f"with t as (select {tokens_sql()} as t from documents) select count(*) filter (doc_id % 10 <> 0)::bigint as memories, count(*) filter (doc_id % 10 = 0)::bigint as tombstones, count(distinct source)::bigint as collections,"
    " (select count(*) from t where len(t) > 0)::bigint as fts_docs, (select count(distinct w) from (select unnest(t) as w from t))::bigint as fts_terms,"
    " (select count(*) from customer)::bigint + (select count(*) from supplier) + (select count(*) from nation) + (select count(*) from orders) + (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as triples from documents"
)
def structural_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    memories = docs.select((F.col("doc_id") % 10 == 0).alias("deleted"), F.col("source").alias("collection"))
    return metrics.structural(memories, triples(spark, sf_dir), fulltext.tokens(docs))


_PRIOR = "pr as (select user_id::varchar as item, count(*)::bigint as shown, count(*) filter (event_type = 'purchase')::bigint as used from events group by 1)"


@query(f"with {_PRIOR} select 'default' as collection, item, shown, used, round((used + 1)::double / (shown + 3)::double, 6) as prior from pr")
def usage_prior(spark, sf_dir):
    return usage.priors(usage_log(table(spark, sf_dir, "events")))


_AFF = (
    "af as (select event_type as term, user_id::varchar as item, count(*)::double as weight from events where event_type = 'purchase' group by 1, 2),"
    " top as (select * from (select *, row_number() over (partition by term order by weight desc, item) as r from af) where r <= 32)"
)


@query(f"with {_AFF} select 'default' as collection, term, item, weight from top")
def usage_affinity_topn(spark, sf_dir):
    return usage.affinities(usage_log(table(spark, sf_dir, "events")))


@query(
    f"with {_PRIOR}, {_AFF}, base as (select user_id::varchar as item, round(avg(value), 6) as score from events group by 1)"
    " select base.item, score, round(least(0.15::double * coalesce(round((used + 1)::double / (shown + 3)::double, 6), 0) + 0.2::double * coalesce(2 * weight, 0), 0.5::double * score), 6) as boost from base left join pr using (item) left join top using (item)"
)
def usage_boost(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    log = usage_log(events)
    base = events.groupBy(F.col("user_id").cast("string").alias("item")).agg(F.round(F.avg("value"), 6).alias("score"))
    affinity = usage.affinity(usage.affinities(log), ["purchase", "purchase"])
    return usage.boosted(base, usage.priors(log), affinity).select("item", "score", "boost")


@query(f"with {_PRIOR} select item, shown, used from pr where item <> '7'")
def usage_purge(spark, sf_dir):
    gone = spark.createDataFrame([("7",)], "item string")
    return usage.purge(usage.priors(usage_log(table(spark, sf_dir, "events"))), gone).select("item", "shown", "used")


@query(f"with {_PRIOR}, {_AFF} select (select count(*) from events)::bigint as events, (select count(*) from pr)::bigint as items, (select count(*) from top)::bigint as term_items")
def usage_stats(spark, sf_dir):
    return usage.stats(usage_log(table(spark, sf_dir, "events")))


@query(
    "select 'default' as collection, event_type as term, user_id::varchar as item, round(sum(exp(-ln(2) * greatest(epoch(timestamp '2024-03-01') - floor(epoch(ts)), 0) / 604800.0)), 6) as weight"
    " from events where event_type = 'purchase' group by 2, 3"
)
def usage_decayed_affinity(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    log = usage_log(events).drop("at").withColumn("collection", F.lit("default")).join(events.select(F.col("event_id").cast("string").alias("query_id"), F.col("ts").cast("timestamp").alias("at")), "query_id")
    return usage.decayed_affinities(log, "2024-03-01", 604800).withColumn("weight", F.round("weight", 6))
