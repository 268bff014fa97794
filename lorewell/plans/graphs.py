"""Triples made of the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import graph
from lorewell.plans.base import declare, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = declare(QUERIES, ORACLES)

_TRIPLES = (
    "t as (select 'c:' || c_custkey as s, 'in_nation' as p, 'n:' || c_nationkey as o from customer union all select 's:' || s_suppkey, 'in_nation', 'n:' || s_nationkey from supplier"
    " union all select 'n:' || n_nationkey, 'in_region', 'r:' || n_regionkey from nation union all select 'o:' || o_orderkey, 'by', 'c:' || o_custkey from orders"
    " union all select 'l:' || l_orderkey || ':' || l_linenumber, 'part_of', 'o:' || l_orderkey from lineitem)"
)


def triples(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    link = lambda df, s, p, o: df.select(F.concat_ws(":", F.lit(s[0]), *s[1:]).alias("s"), F.lit(p).alias("p"), F.concat_ws(":", F.lit(o[0]), o[1]).alias("o"))
    out = link(t("customer"), ("c", "c_custkey"), "in_nation", ("n", "c_nationkey"))
    for other in (
        link(t("supplier"), ("s", "s_suppkey"), "in_nation", ("n", "s_nationkey")),
        link(t("nation"), ("n", "n_nationkey"), "in_region", ("r", "n_regionkey")),
        link(t("orders"), ("o", "o_orderkey"), "by", ("c", "o_custkey")),
        link(t("lineitem"), ("l", "l_orderkey", "l_linenumber"), "part_of", ("o", "l_orderkey")),
    ):
        out = out.unionByName(other)
    return out.withColumn("weight", F.lit(1.0).cast("float")).withColumn("source", F.lit(None).cast("string"))


@query(f"with {_TRIPLES} select s, p, o from t where s = 'c:7'")
def graph_by_subject(spark, sf_dir):
    return graph.find(triples(spark, sf_dir), subject="c:7").select("s", "p", "o")


@query(f"with {_TRIPLES} select s, p, o from t where p = 'in_region'")
def graph_by_predicate(spark, sf_dir):
    return graph.find(triples(spark, sf_dir), predicate="in_region").select("s", "p", "o")


@query(f"with {_TRIPLES} select s, p, o from t where o = 'c:7'")
def graph_by_object(spark, sf_dir):
    return graph.find(triples(spark, sf_dir), object_="c:7").select("s", "p", "o")


@query(f"with {_TRIPLES} select s, p, o from t where s = 'c:7' and p = 'in_nation'")
def graph_by_subject_predicate(spark, sf_dir):
    return graph.find(triples(spark, sf_dir), subject="c:7", predicate="in_nation").select("s", "p", "o")


@query(f"with {_TRIPLES} select s, p, o from t where starts_with(s, 's:1')")
def graph_prefix(spark, sf_dir):
    return graph.find_prefix(triples(spark, sf_dir), "s:1").select("s", "p", "o")


@query(
    "select 'c:' || o_custkey as s, 'last_status' as p, o_orderstatus as o, arg_max(o_orderkey, o_orderkey)::float as weight from orders group by o_custkey, o_orderstatus"
)
def graph_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    writes = orders.select(F.concat(F.lit("c:"), "o_custkey").alias("s"), F.lit("last_status").alias("p"), F.col("o_orderstatus").alias("o"), F.col("o_orderkey").cast("float").alias("weight"), F.lit("orders").alias("source"), F.col("o_orderkey").alias("seq"))
    return graph.upsert(writes).select("s", "p", "o", "weight")


@query(f"with {_TRIPLES} select s, p, o from t where p = 'in_nation' and not exists (select 1 from supplier where s = 's:' || s_suppkey)")
def graph_remove(spark, sf_dir):
    own = triples(spark, sf_dir).where("p = 'in_nation'")
    return graph.remove(own, own.where(F.col("s").startswith("s:"))).select("s", "p", "o")


@query(f"with {_TRIPLES} select s, p, o, 1::int as hop from t where s = 'n:3' or o = 'n:3'")
def graph_expand_1hop(spark, sf_dir):
    return graph.expand(triples(spark, sf_dir), "n:3", 1).select("s", "p", "o", "hop")


_TWO = (
    " a as (select s, p, o, 1 as hop from t where s = 'n:3' or o = 'n:3'), f as (select case when s = 'n:3' then o else s end as e from a),"
    " b as (select s, p, o, 2 as hop from t where s in (select e from f) or o in (select e from f))"
)


@query(f"with {_TRIPLES},{_TWO} select s, p, o, min(hop)::int as hop from (select * from a union all select * from b) group by 1, 2, 3")
def graph_expand_2hop(spark, sf_dir):
    return graph.expand(triples(spark, sf_dir), "n:3", 2).select("s", "p", "o", "hop")


@query(
    f"with {_TRIPLES},{_TWO}, d as (select distinct e from f where e <> 'n:3'),"
    " m as (select s, p, o, 1 as hop from a union all select s, p, o, 2 from t join d on t.s = d.e union all select s, p, o, 2 from t join d on t.o = d.e)"
    " select s, p, o, count(*)::bigint as times from m group by 1, 2, 3"
)
def graph_expand_multiplicity(spark, sf_dir):
    return graph.expand(triples(spark, sf_dir), "n:3", 2, multiplicity=True).groupBy("s", "p", "o").agg(F.count("*").alias("times"))


@query(f"with {_TRIPLES} select p, count(*)::bigint as n from (select distinct s, p, o from t) group by 1")
def graph_count(spark, sf_dir):
    return triples(spark, sf_dir).select("s", "p", "o").distinct().groupBy("p").agg(F.count("*").alias("n"))


@query(
    "with t as (select 'c:' || o_custkey as s, 'o:' || o_orderkey as o, o_orderkey::varchar as source from orders), h as (select s, o from t where source in ('1', '2')),"
    " e as (select s as e from h union select o from h)"
    " select t.source as doc_id, 1::int as hop from t where (t.s in (select e from e) or t.o in (select e from e)) and t.source not in ('1', '2') group by 1"
)
def graph_memories_near(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = orders.select(F.concat(F.lit("c:"), "o_custkey").alias("s"), F.lit("placed").alias("p"), F.concat(F.lit("o:"), "o_orderkey").alias("o"), F.lit(1.0).cast("float").alias("weight"), F.col("o_orderkey").cast("string").alias("source"))
    return graph.memories_near(own, orders.where("o_orderkey in (1, 2)").select(F.col("o_orderkey").alias("doc_id")), 1)
