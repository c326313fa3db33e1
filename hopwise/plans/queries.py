"""Registered graph queries over the test tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.functions.predicates import between, containing, ends_with, gt, gte, inside, lt, lte, neq, not_containing, not_ends_with, not_regex, not_starting_with, outside, regex, starting_with, within, without
from hopwise.plans.traversal import Order, Scope, Source, Traversal
from hopwise.graph import EdgeTable, GraphBuilder, PropertyGraph, VertexTable
from hopwise.operators import shared_dir
from hopwise.sources.graphml import read_graphml, write_graphml
from hopwise.sources.examples import crew, modern
from hopwise.errors import GraphTraversalError, QueryError
from hopwise.sources.files import FileIO, Graphs, read_folder
from hopwise.sources.jsonfiles import graphson_lines, read_graphson, read_json_lines, read_json_tree
from hopwise.sources.rdf import triples, turtle
from hopwise.sources.tables import table_graph, talk_graph
from hopwise.streaming.edges import degrees, fresh_edges, hop, landed, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
A = Traversal()


def query(sql: str | None, graph=table_graph):
    """Registers a traversal builder under its name with its SQL; the builder gets the source and returns a DataFrame."""

    def add(build):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(graph(spark, sf_dir).traversal())
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return add


def simple(name: str, sql: str, build: Callable[[Source], DataFrame], graph=table_graph) -> None:
    build.__name__ = name
    query(sql, graph)(build)


def _sizes(g: Source):
    return g.V().has_label("part").values("p_size").fold()


# ---- sources, has, predicates


@query("""select 'region' as label, count(*) as n from region union all select 'nation', count(*) from nation union all select 'customer', count(*) from customer
union all select 'supplier', count(*) from supplier union all select 'part', count(*) from part union all select 'order', count(*) from orders union all select 'event', count(*) from events""")
def v_count(g):
    return g.graph.summary().where("element = 'vertex'").select("label", "n")


@query("""select 'in_region' as label, count(*) as n from nation union all select 'in_nation', count(*) from customer union all select 'based_in', count(*) from supplier
union all select 'placed', count(*) from orders union all select 'contains', count(*) from lineitem union all select 'shipped_by', count(*) from lineitem union all select 'did', count(*) from events""")
def graph_summary(g):
    return g.graph.summary().where("element = 'edge'").select("label", "n")


simple("v_all_count", "select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(*) from events) as n", lambda g: g.V().count().to_df("n"))
simple("e_count", "select count(*) as n from lineitem", lambda g: g.E().has_label("contains").count().to_df("n"))
simple("v_ids", "select p_partkey as id from part where p_partkey in (1, 5, 7)", lambda g: g.V().has_label("part").has_id(1, 5, 7).to_df("id"))
simple("has_eq", "select c_custkey as id from customer where c_mktsegment = 'BUILDING'", lambda g: g.V().has_label("customer").has("c_mktsegment", "BUILDING").to_df("id"))
simple("has_exists", "select count(*) as n from orders where o_orderpriority is not null", lambda g: g.V().has("o_orderpriority").count().to_df("n"))
simple("has_not", "select (select count(*) from region) + (select count(*) from nation) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(*) from events) as n", lambda g: g.V().has_not("c_acctbal").count().to_df("n"))
simple("has_label_key_value", "select p_partkey as id from part where p_size = 10", lambda g: g.V().has("part", "p_size", 10).to_df("id"))
simple("has_id_predicate", "select o_orderkey as id from orders where o_orderkey < 40", lambda g: g.V().has_label("order").has_id(lt(40)).to_df("id"))
simple("has_name", "select n_nationkey as id from nation where n_name in ('NATION_3', 'NATION_7') or n_name in (select n_name from nation where n_nationkey < 2)", lambda g: g.V().has_label("nation").or_(A.has_name("NATION_3", "NATION_7"), A.has_id(lt(2))).to_df("id"))
simple("within_key", "select p_partkey as id from part where p_size in (3, 9, 27)", lambda g: g.V().has_label("part").within("p_size", [3, 9, 27]).to_df("id"))
simple("contains_text", "select p_partkey as id from part where contains(p_type, 'A')", lambda g: g.V().has_label("part").contains("p_type", "A").to_df("id"))
simple("callable_predicate", "select p_partkey as id from part where p_size % 7 = 0", lambda g: g.V().has_label("part").has("p_size", lambda x: x is not None and x % 7 == 0).to_df("id"))

for _name, _p, _sql in [
    ("gt", gt(300000), "> 300000"), ("gte", gte(300000), ">= 300000"), ("lt", lt(9000), "< 9000"), ("lte", lte(9000), "<= 9000"), ("neq", neq(9000), "<> 9000"),
    ("inside", inside(1000, 20000), "between 1000.0000001 and 19999.9999999"), ("between", between(1000, 20000), "between 1000 and 20000"), ("outside", outside(5000, 390000), "not between 5000 and 390000"),
]:
    simple(f"pred_{_name}", f"select o_orderkey as id from orders where o_totalprice {_sql}", lambda g, p=_p: g.V().has_label("order").has("o_totalprice", p).to_df("id"))
for _name, _p, _sql in [
    ("within", within("A", "F", "1-URGENT", "5-LOW"), "in ('1-URGENT', '5-LOW')"), ("without", without(["1-URGENT", "5-LOW"]), "not in ('1-URGENT', '5-LOW')"),
    ("starting_with", starting_with("1"), "like '1%'"), ("not_starting_with", not_starting_with("1"), "not like '1%'"), ("ends_with", ends_with("H"), "like '%H'"), ("not_ends_with", not_ends_with("H"), "not like '%H'"),
    ("containing", containing("O"), "like '%O%'"), ("not_containing", not_containing("O"), "not like '%O%'"),
]:
    simple(f"pred_{_name}", f"select o_orderkey as id from orders where o_orderpriority {_sql}", lambda g, p=_p: g.V().has_label("order").has("o_orderpriority", p).to_df("id"))
simple("pred_regex", "select o_orderkey as id from orders where regexp_matches(o_orderpriority, '^(?:[1-3]-[A-Z]+)')", lambda g: g.V().has_label("order").has("o_orderpriority", regex("[1-3]-[A-Z]+")).to_df("id"))
simple("pred_not_regex", "select o_orderkey as id from orders where not regexp_matches(o_orderpriority, '^(?:[1-3]-[A-Z]+)')", lambda g: g.V().has_label("order").has("o_orderpriority", not_regex("[1-3]-[A-Z]+")).to_df("id"))

# ---- projections

simple("values_one", "select p_brand as v from part", lambda g: g.V().has_label("part").values("p_brand").to_df("v"))
simple("values_multi", "select p_brand as v from part union all select p_type from part", lambda g: g.V().has_label("part").values("p_brand", "p_type").to_df("v"))
simple("properties_kv", "select 'p_brand' as k, p_brand as v from part union all select 'p_size', cast(p_size as varchar) from part", lambda g: g.V().has_label("part").properties("p_brand", "p_size").to_df("k", "v"))
simple("has_key", "select cast(p_size as varchar) as v from part", lambda g: g.V().has_label("part").properties("p_brand", "p_size").has_key("p_size").value().to_df("v"))
simple("has_value", "select 'p_size' as k from part where p_size = 10", lambda g: g.V().has_label("part").properties("p_brand", "p_size").has_value("10").key().to_df("k"))
simple("element_map", "select p_partkey as p_partkey, p_brand, p_size from part", lambda g: g.V().has_label("part").element_map("p_partkey", "p_brand", "p_size").to_df())
simple("id_step", "select s_suppkey as id from supplier", lambda g: g.V().has_label("supplier").id_().to_df("id"))
simple("label_step", "select 'supplier' as label, count(*) as n from supplier", lambda g: g.V().has_label("supplier").label().to_df("label").groupBy("label").agg(F.count(F.lit(1)).alias("n")))
simple("name_step", "select r_name as name from region", lambda g: g.V().has_label("region").name().to_df("name"))
simple("select_bindings", "select o_custkey as c, o_orderkey as o from orders", lambda g: g.V().has_label("customer").as_("c").out("placed").as_("o").select("c", "o").to_df())
simple("select_by", "select c_name as c, o_totalprice as o from customer join orders on o_custkey = c_custkey where o_totalprice > 200000", lambda g: g.V().has_label("customer").as_("c").out("placed").has("o_totalprice", gt(200000)).as_("o").select("c", "o").by("c_name").by("o_totalprice").to_df())
simple("select_back", "select c_custkey as id from customer join orders on o_custkey = c_custkey where o_totalprice > 300000", lambda g: g.V().has_label("customer").as_("c").out("placed").has("o_totalprice", gt(300000)).select("c").to_df("id"))

# ---- hops

simple("out_1hop", "select o_orderkey as id from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'", lambda g: g.V().has_label("customer").has("c_mktsegment", "BUILDING").out("placed").to_df("id"))
simple("in_1hop", "select c_custkey as id from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1", lambda g: g.V().has_label("nation").has("n_regionkey", 1).in_("in_nation").to_df("id"))
simple("both_1hop", "select count(*) as n from (select n_regionkey from nation where n_nationkey < 5 union all select c_custkey from customer where c_nationkey < 5 union all select s_suppkey from supplier where s_nationkey < 5)", lambda g: g.V().has_label("nation").has_id(lt(5)).both().count().to_df("n"))
simple("oute_prop_filter", "select l_orderkey as src, l_partkey as dst, 'contains' as label from lineitem where l_quantity > 45", lambda g: g.V().has_label("order").outE("contains").has("l_quantity", gt(45)).to_df("src", "dst", "label"))
simple("ine", "select l_orderkey as src, l_suppkey as dst from lineitem where l_suppkey <= 3", lambda g: g.V().has_label("supplier").has_id(lte(3)).inE("shipped_by").to_df("src", "dst", "label").drop("label"))
simple("bothe_count", "select count(*) as n from (select 1 from orders where o_orderkey < 100 union all select 1 from lineitem where l_orderkey < 100 union all select 1 from lineitem where l_orderkey < 100)", lambda g: g.V().has_label("order").has_id(lt(100)).bothE().count().to_df("n"))
simple("outv", "select l_orderkey as id from lineitem where l_discount > 0.09", lambda g: g.E().has_label("contains").has("l_discount", gt(0.09)).outV().to_df("id"))
simple("inv", "select p_brand as v from lineitem join part on l_partkey = p_partkey where l_discount > 0.09", lambda g: g.E().has_label("contains").has("l_discount", gt(0.09)).inV().values("p_brand").to_df("v"))
simple("bothv", "select n_nationkey as id from nation union all select n_regionkey from nation", lambda g: g.E().has_label("in_region").bothV().to_df("id"))


@query("select count(*) as n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where r_name = 'EUROPE'")
def three_hop_count(g):
    return g.V().has_label("region").has_name("EUROPE").in_("in_region").in_("in_nation").out("placed").count().to_df("n")


@query("select n_name as nation, count(*) as n, round(sum(o_totalprice), 2) as total from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name")
def four_hop_values(g):
    pairs = g.V().has_label("nation").as_("n").in_("in_nation").out("placed").as_("o").select("n", "o").by("name").by("o_totalprice").to_df("nation", "price")
    return pairs.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


# ---- filters with sub-traversals

simple("filter_exists", "select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)", lambda g: g.V().has_label("customer").filter_(A.out("placed").has("o_totalprice", gt(300000))).to_df("id"))
simple("filter_not", "select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)", lambda g: g.V().has_label("customer").not_(A.out("placed").has("o_totalprice", gt(300000))).to_df("id"))
simple("filter_and", "select c_custkey as id from customer where c_acctbal > 0 and exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')", lambda g: g.V().has_label("customer").and_(A.values("c_acctbal").is_(gt(0)), A.out("placed").has("o_orderstatus", "F")).to_df("id"))
simple("filter_or", "select c_custkey as id from customer where c_mktsegment = 'MACHINERY' or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)", lambda g: g.V().has_label("customer").or_(A.has("c_mktsegment", "MACHINERY"), A.out("placed").has("o_totalprice", gt(350000))).to_df("id"))
simple("filter_count_gt", "select o_custkey as id from orders group by o_custkey having count(*) > 10", lambda g: g.V().has_label("customer").filter_(A.out("placed").count().is_(gt(10))).to_df("id"))
simple("filter_count_zero", "select c_custkey as id from customer where (select count(*) from orders where o_custkey = c_custkey and o_totalprice > 250000) = 0", lambda g: g.V().has_label("customer").filter_(A.out("placed").has("o_totalprice", gt(250000)).count().is_(0)).to_df("id"))
simple("filter_nested", "select s_suppkey as id from supplier where exists (select 1 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_suppkey = s_suppkey and c_nationkey = 3 and l_quantity > 40)", lambda g: g.V().has_label("supplier").filter_(A.inE("shipped_by").has("l_quantity", gt(40)).outV().in_("placed").filter_(A.out("in_nation").has_id(3))).to_df("id"))
simple("filter_binding", "select l_partkey as id from lineitem where l_quantity > 30 and l_discount > 0.05", lambda g: g.V().has_label("order").outE("contains").as_("e").filter_(A.select("e").values("l_quantity").is_(gt(30))).filter_(A.select("e").values("l_discount").is_(gt(0.05))).inV().to_df("id"))
simple("is_value", "select p_size as v from part where p_size > 40", lambda g: g.V().has_label("part").values("p_size").is_(gt(40)).to_df("v"))

# ---- dedup, order, slices

simple("dedup_value", "select distinct o_orderpriority as v from orders", lambda g: g.V().has_label("order").values("o_orderpriority").dedup().to_df("v"))
simple("dedup_by", "select distinct c_mktsegment as v from customer", lambda g: g.V().has_label("customer").dedup("c_mktsegment").values("c_mktsegment").to_df("v"))
simple("dedup_hop", "select distinct l_suppkey as id from lineitem join orders on l_orderkey = o_orderkey where o_totalprice > 250000", lambda g: g.V().has_label("order").has("o_totalprice", gt(250000)).out("shipped_by").dedup().to_df("id"))
simple("order_limit", "select o_orderkey as id from orders order by o_totalprice desc, o_orderkey limit 10", lambda g: g.V().has_label("order").order().by("o_totalprice", Order.desc).limit(10).to_df("id"))
simple("range_skip", "select p_partkey as id from part order by p_retailprice, p_partkey limit 15 offset 5", lambda g: g.V().has_label("part").order(by="p_retailprice").range(5, 20).to_df("id"))
simple("limit_unordered", "select s_suppkey as id from supplier order by s_suppkey limit 5", lambda g: g.V().has_label("supplier").limit(5).to_df("id"))
simple("order_by_anon", "select c_custkey as id from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey order by coalesce(n, 0) desc, c_custkey limit 10", lambda g: g.V().has_label("customer").order().by(A.out("placed").count(), Order.desc).limit(10).to_df("id"))

# ---- reducers

simple("count_global", "select count(*) as n from orders", lambda g: g.V().has_label("order").count().to_df("n"))
simple("sum_global", "select cast(sum(p_size) as bigint) as n from part", lambda g: g.V().has_label("part").values("p_size").sum_().to_df("n"))
simple("mean_global", "select round(avg(o_totalprice), 4) as v from orders", lambda g: g.V().has_label("order").values("o_totalprice").mean().to_df("v").select(F.round("v", 4).alias("v")))
simple("min_global", "select min(o_totalprice) as v from orders", lambda g: g.V().has_label("order").values("o_totalprice").min_().dedup().to_df("v"))
simple("max_global", "select o_totalprice as v from orders where o_totalprice = (select max(o_totalprice) from orders)", lambda g: g.V().has_label("order").values("o_totalprice").max_().to_df("v"))
simple("argmax_binding", "select o_orderkey as id from orders where o_totalprice = (select max(o_totalprice) from orders)", lambda g: g.V().has_label("order").as_("o").values("o_totalprice").max_().select("o").to_df("id"))
simple("fold_list", "select string_agg(r_name, ',' order by r_regionkey) as v from region", lambda g: g.V().has_label("region").values("r_name").fold().to_df("v").select(F.array_join("v", ",").alias("v")))
simple("fold_func", "select cast(sum(p_size) + 100 as bigint) as v from part", lambda g: g.V().has_label("part").values("p_size").fold(100, lambda a, b: a + b).to_df("v"))
simple("count_local", "select length(r_name) as v from region", lambda g: g.V().has_label("region").values("r_name").count(Scope.local).to_df("v"))
simple("sum_local", "select cast(sum(p_size) as bigint) as v from part", lambda g: g.V().has_label("part").values("p_size").fold().sum_(Scope.local).to_df("v").select(F.col("v").cast("long").alias("v")))
simple("max_min_local", "select max(p_size) as v from part union all select min(p_size) from part", lambda g: _sizes(g).max_(Scope.local).to_df("v").union(_sizes(g).min_(Scope.local).to_df("v")))
simple("mean_local", "select round(avg(p_size), 6) as v from part", lambda g: _sizes(g).mean(Scope.local).to_df("v").select(F.round("v", 6).alias("v")))
simple("unfold_list", "select r_name as v from region", lambda g: g.V().has_label("region").values("r_name").fold().unfold().to_df("v"))

# ---- local, union, branch

simple("local_topn", "select o_custkey as c, o_orderkey as o from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 2", lambda g: g.V().has_label("customer").as_("c").local(A.out("placed").order().by("o_totalprice", Order.desc).limit(2)).as_("o").select("c", "o").to_df())
simple("local_count", "select c_custkey as c, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1", lambda g: g.V().has_label("customer").as_("c").local(A.out("placed").count()).as_("n").select("c", "n").to_df())
simple("local_dedup", "select distinct o_custkey as c, o_orderpriority as p from orders", lambda g: g.V().has_label("customer").as_("c").local(A.out("placed").values("o_orderpriority").dedup()).as_("p").select("c", "p").to_df())
simple("union_bag", "select l_partkey as id from lineitem where l_orderkey < 200 union all select l_suppkey from lineitem where l_orderkey < 200", lambda g: g.V().has_label("order").has_id(lt(200)).union(A.out("contains"), A.out("shipped_by")).to_df("id"))
simple("union_dedup", "select c_nationkey as v from customer union select s_nationkey from supplier", lambda g: g.V().has_label("nation").union(A.in_("in_nation").values("c_nationkey"), A.in_("based_in").values("s_nationkey")).dedup().to_df("v"))
simple("branch_option", "select case c_mktsegment when 'BUILDING' then c_name when 'MACHINERY' then c_mktsegment else cast(c_nationkey as varchar) end as v from customer", lambda g: g.V().has_label("customer").branch(A.values("c_mktsegment")).option("BUILDING", A.values("c_name")).option("MACHINERY", A.values("c_mktsegment")).option(None, A.values("c_nationkey")).to_df("v"))

# ---- recursion and paths

simple("repeat_times", "select b.n_nationkey as id from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < 5", lambda g: g.V().has_label("nation").has_id(lt(5)).repeat(A.both("in_region")).times(2).to_df("id"))
simple("repeat_emit", "with t as (select conv_id * 1000 + turn as id from conversations group by 1), r as (select id, id + 1 as b, id + 2 as c from t where id % 1000 = 0) select b as id from r where b in (select id from t) union all select c from r where b in (select id from t) and c in (select id from t)", lambda g: g.V().has("turn", 0).repeat(A.out("next_turn")).times(2).emit().to_df("id"), talk_graph)
simple("repeat_until", "select max(conv_id * 1000 + turn) as id from conversations where conv_id in (select conv_id from conversations where turn = 0) group by conv_id having count(distinct turn) = max(turn) + 1 and max(turn) > 0", lambda g: g.V().has("turn", 0).repeat(A.out("next_turn")).until(A.not_(A.out("next_turn"))).to_df("id"), talk_graph)
simple("until_repeat", "select max(conv_id * 1000 + turn) as id from conversations where conv_id in (select conv_id from conversations where turn = 0) group by conv_id having count(distinct turn) = max(turn) + 1", lambda g: g.V().has("turn", 0).until(A.not_(A.out("next_turn"))).repeat(A.out("next_turn")).to_df("id"), talk_graph)
simple("simple_path", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey", lambda g: g.V().has_label("nation").as_("a").out("in_region").in_("in_region").simple_path().as_("b").select("a", "b").to_df())
simple("path_by", "select c_name || '>' || n_name || '>' || r_name as p from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", lambda g: g.V().has_label("customer").out("in_nation").out("in_region").path("name").to_df("p").select(F.array_join("p", ">").alias("p")))
simple("as_path", "select count(*) as n, cast(sum(3) as bigint) as steps from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", lambda g: g.V().has_label("customer").out("in_nation").out("in_region").as_path().to_df("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("p")).cast("long").alias("steps")))

# ---- changes


@query("select r_name as name, 'Aachen' as city from region")
def property_update(g):
    g.V().has_label("region").property("city", "Aachen").iterate().run()
    return g.V().has("city", "Aachen").element_map("name", "city").to_df("name", "city")


@query("select n_name as name, 'k' || (n_nationkey % 50) as last, case when n_nationkey < 9 then 'low' || n_regionkey end as more from nation")
def many_updates(g):
    """Fifty changes in a row, none of which makes the table's plan longer for the next."""
    for i in range(25):
        g.V().has_label("nation").has_id(i).property("last", f"k{i}").iterate().run()
    for i in range(25):
        low = g.V().has_label("nation").has_id(lt(9)).has("n_regionkey", i % 5)
        low.property("more", f"low{i % 5}").iterate().run()
    return g.V().has_label("nation").element_map("name", "last", "more").to_df("name", "last", "more")


@query("select r_name as name from region union all select 'ATLANTIS'")
def add_v(g):
    g.addV("region", "ATLANTIS", id=99).iterate().run()
    return g.V().has_label("region").values("name").to_df("name")


@query("select n_nationkey as src, n_regionkey as dst from nation union all select 1, 2")
def add_e(g):
    g.addE("in_region").from_(1).to_(2).iterate().run()
    return g.E().has_label("in_region").to_df("src", "dst", "label").drop("label")


@query("select c_custkey as src, s_suppkey as dst from customer join supplier on c_nationkey = s_nationkey")
def property_join(g):
    g.graph.join("customer", "supplier", "c_nationkey", "s_nationkey", "near")
    return g.V().has_label("customer").outE("near").to_df("src", "dst", "label").drop("label")


# ---- files, exports, streams


def nations(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions and nations only, with string ids that are unique over both."""
    t = table_graph(spark, sf_dir)
    keyed = lambda c, label: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    v = [VertexTable(x.df.withColumn("id", keyed("id", x.label)), x.label) for x in t.vertices if x.label in ("region", "nation")]
    e = next(x for x in t.edges if x.label == "in_region")
    df = e.df.select(keyed("src", "nation").alias("src"), keyed("dst", "region").alias("dst"), "eid", "_seq")
    return PropertyGraph(spark, v, [EdgeTable(df, "in_region", "nation", "region")], t.config)


NAMES_SQL = "select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey"


def _names(graph: PropertyGraph) -> DataFrame:
    return graph.traversal().V().has_label("nation").as_("n").out("in_region").as_("r").select("n", "r").by("name").by("name").to_df("nation", "region")


@query(NAMES_SQL, nations)
def graphml_round_trip(g):
    """Written by the executors as a folder of part files, and read again."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}.graphml"
    write_graphml(g.graph, path, single=False)
    return _names(read_graphml(g.graph.spark, path, edge_label_key="labelE"))


@query(NAMES_SQL, nations)
def graphson_round_trip(g):
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}.json"
    graphson_lines(g.graph).write.text(path)
    return _names(read_graphson(g.graph.spark, path))


@query("select 'http://example.org/nation:' || n_nationkey as s, 'http://example.org/region:' || n_regionkey as o from nation", nations)
def rdf_triples(g):
    return triples(g.graph).where("p = 'http://example.org/in_region'").select("s", "o")


@query(NAMES_SQL, nations)
def registry_graph(g):
    """The graph of nations, stored and named in a registry."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}.graphml"
    write_graphml(g.graph, path, single=False)
    known = Graphs(g.graph.spark, {"configs": {"nations": {"name": "nations", "file_path": path, "edge_label_key": "labelE"}, "modern": {"name": "modern", "custom_loader": "modern"}}})
    return _names(known.get("nations"))


def refused(g: Source, error: type[Exception], run: Callable[[], object]) -> DataFrame:
    """One row: whether a traversal was refused with this error."""
    try:
        run()
    except error as e:
        return rows(g.graph.spark, [str(e)], "message string")
    return rows(g.graph.spark, [], "message string")


@query("select 'repeat did not end after 2 rounds' as message from conversations having max(turn) > 5", talk_graph)
def round_cap(g):
    """A loop over the turns that needs more rounds than its graph allows."""
    short = replace(g.graph, config=replace(g.graph.config, most_rounds=2)).traversal()
    return refused(g, GraphTraversalError, lambda: short.V().has("turn", 0).repeat(A.out("next_turn").in_("next_turn").out("next_turn")).until(A.has("turn", 6)).to_list().run())


simple("order_asc_or_desc", "select 'order is either ascending or descending' as message", lambda g: refused(g, QueryError, lambda: g.V().has_label("part").order(by="p_size", asc=True, desc=True)))


@query("select 'p:nation' || n_nationkey as subject, 'p:region' || n_regionkey as region from nation", nations)
def rdf_turtle(g):
    """Subjects with prefixes; ids get plain names first."""
    plain = lambda c: F.replace(F.col(c), F.lit(":"), F.lit(""))
    v = [VertexTable(t.df.withColumn("id", plain("id")), t.label) for t in g.graph.vertices]
    e = [EdgeTable(t.df.withColumns({"src": plain("src"), "dst": plain("dst")}), t.label, t.src_label, t.dst_label) for t in g.graph.edges]
    rows = turtle(PropertyGraph(g.graph.spark, v, e, g.graph.config)).where("not head")
    found = rows.select(F.regexp_extract("value", r"^(\S+) ", 1).alias("subject"), F.regexp_extract("value", r"p:in_region (p:region\d+)", 1).alias("region"))
    return found.where("region <> ''")


def stream_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in each hour, from the table read as a stream of edges."""
    events = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(events).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{events}*")
    counted = degrees(stream.select(F.col("user_id").alias("src"), F.col("event_id").alias("dst"), F.col("ts").cast("timestamp").alias("ts")))
    return latest(counted, ["start", "id"], ["n"]).select(F.col("start").cast("string").alias("hour"), "id", "n")


def stream_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of edges to customers, each once, and one hop more to the customer's nation."""
    events = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{events}*")
    fresh = fresh_edges(stream.select(F.col("event_id").alias("src"), F.col("user_id").alias("dst"), F.col("ts").cast("timestamp").alias("ts")))
    nations_of = next(t for t in table_graph(spark, sf_dir).edges if t.label == "in_nation").df
    return landed(hop(fresh, nations_of).select("src", "next")).groupBy(F.col("next").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["stream_hop"] = stream_hop
ORACLES["stream_hop"] = "select c_nationkey as nation, count(*) as n from events join customer on user_id = c_custkey group by 1"
QUERIES["stream_degrees"] = stream_degrees
ORACLES["stream_degrees"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, user_id as id, count(*) as n from events group by all"


# ---- terminals, positions, bindings


def rows(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in values], schema)


simple("to_list_terminal", "select r_name as name from region", lambda g: rows(g.graph.spark, g.V().has_label("region").values("r_name").to_list().run(), "name string"))
simple("iter_terminal", "select n_nationkey as id from nation", lambda g: rows(g.graph.spark, g.V().has_label("nation").iter().run(), "id long"))
simple("next_terminal", "select p_partkey as id from part order by p_partkey limit 3", lambda g: rows(g.graph.spark, g.V().has_label("part").next(3).run(), "id long"))
simple("has_next_terminal", "select true as some, false as none", lambda g: rows(g.graph.spark, [(g.V().has_label("part").has_next().run(), g.V().has("p_size", lt(0)).has_next().run())], "some boolean, none boolean"))
simple("print_query_terminal", "select 'V().has_label(''part'').range(0, 3)' as text", lambda g: rows(g.graph.spark, [g.V().has_label("part").limit(3).print_query()], "text string"))
simple("identity_step", "select n_nationkey as id from nation", lambda g: g.V().has_label("nation").identity().to_df("id"))
simple("skip_rest", "select p_partkey as id from part order by p_retailprice, p_partkey offset 7", lambda g: g.V().has_label("part").order(by="p_retailprice").skip(7).to_df("id"))
simple("order_stable", "select s_suppkey as id from supplier order by s_nationkey, s_suppkey limit 7", lambda g: g.V().has_label("supplier").order(by="s_nationkey").limit(7).to_df("id"))
simple("order_desc", "select r_name as name from region order by r_name desc limit 2", lambda g: g.V().has_label("region").order(by="name", desc=True).limit(2).values("name").to_df("name"))
simple("local_sum", "select c_custkey as c, round(coalesce(sum(o_totalprice), 0), 2) as v from customer left join orders on o_custkey = c_custkey group by 1", lambda g: g.V().has_label("customer").as_("c").local(A.out("placed").values("o_totalprice").sum_()).as_("v").select("c", "v").to_df().select("c", F.round("v", 2).alias("v")))
simple("local_max_min", "select o_custkey as c, max(o_totalprice) as v from orders group by 1 union all select o_custkey, min(o_totalprice) from orders group by 1", lambda g: _of_orders(g, A.out("placed").values("o_totalprice").max_().dedup()).union(_of_orders(g, A.out("placed").values("o_totalprice").min_().dedup())))
simple("local_fold", "select o_custkey as c, string_agg(o_orderpriority, ',' order by o_orderkey) as v from orders group by 1", lambda g: _of_orders(g, A.out("placed").values("o_orderpriority").fold()).where("size(v) > 0").select("c", F.array_join("v", ",").alias("v")))
simple("or_unlike", "select o_orderkey as id from orders join customer on o_custkey = c_custkey where c_nationkey < 3 or exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = o_orderkey and p_size = 50)", lambda g: g.V().has_label("customer").as_("c").out("placed").or_(A.select("c").out("in_nation").has_id(lt(3)), A.out("contains").has("p_size", 50)).to_df("id"))
simple("emit_filter", "with t as (select conv_id * 1000 + turn as id from conversations group by 1) select id from t where id % 1000 = 2 and id - 1 in (select id from t) and id - 2 in (select id from t)", lambda g: g.V().has("turn", 0).repeat(A.out("next_turn")).times(2).emit(A.has("turn", 2)).to_df("id"), talk_graph)
simple("emit_before_repeat", "with t as (select conv_id * 1000 + turn as id from conversations group by 1) select id from t where id % 1000 = 0 union all select id from t where id % 1000 = 1 and id - 1 in (select id from t)", lambda g: g.V().has("turn", 0).emit().repeat(A.out("next_turn")).times(1).to_df("id"), talk_graph)


def _of_orders(g: Source, reducer: Traversal) -> DataFrame:
    return g.V().has_label("customer").as_("c").local(reducer).as_("v").select("c", "v").to_df()


@query("select r_regionkey as id from region")
def side_effect_rows(g):
    seen: list[int] = []
    g.V().has_label("region").side_effect(lambda row: seen.append(row["id"])).iterate().run()
    return rows(g.graph.spark, seen, "id long")


# ---- built graphs, their union, look-ups and files


def example(make) -> Callable[[SparkSession, str], PropertyGraph]:
    return lambda spark, sf_dir: make(spark)


MODERN = "with v(id, name) as (values ('0', 'marko'), ('1', 'vadas'), ('2', 'lop'), ('3', 'josh'), ('4', 'ripple'), ('5', 'peter'))"
simple("v_by_ids", f"{MODERN} select name from v where id in ('3', '0')", lambda g: g.V("3", "0").values("name").to_df("name"), example(modern))
simple("e_by_pairs", "select * from (values ('0', '1', 'knows'), ('3', '2', 'created')) t(src, dst, label)", lambda g: g.E(("0", "1"), ("3", "2")).to_df("src", "dst", "label"), example(modern))
simple("nodes_by_label_and_name", f"{MODERN} select id from v where name = 'josh'", lambda g: g.graph.get_nodes("Person", "josh").select("id"), example(modern))
simple("map_contains", "select 'daniel' as name", lambda g: g.V().contains("location", "aachen").values("name").to_df("name"), example(crew))
simple("map_path", "select 'stephen' as name", lambda g: g.V().has(["location", "dulles", "startTime"], 2000).values("name").to_df("name"), example(crew))
simple("merged_graphs", "select 'vertex' as element, 12 as n union all select 'edge', 13", lambda g: g.graph.merge(modern(g.graph.spark), "0", "0", "Guide").summary().groupBy("element").agg(F.sum("n").alias("n")), example(modern))
simple("quads_lookup", "select distinct 'in_region' as key, 'region:' || n_regionkey as found from nation", lambda g: g.graph.lookup("P", "O").where("key = 'in_region'").select("key", F.explode("found").alias("found")), nations)
simple("quads_lookup_os", "select r_name as key, 'region:' || r_regionkey as found from region", lambda g: g.graph.lookup("O", "S").where("size(found) = 1").select("key", F.explode("found").alias("found")).join(g.V().has_label("region").values("name").to_df("key"), "key"), nations)


@query("select 'b' as name, 2 as n union all select 'c', 1")
def built_graph(g):
    """A builder keeps one edge for each pair of vertices."""
    b = GraphBuilder()
    for name in "abc":
        b.add_labeled_node("Letter", name)
    for src, dst in ((0, 1), (0, 1), (2, 1), (0, 2)):
        b.add_labeled_edge(src, dst, "to")
    made = b.build(g.graph.spark).traversal()
    return made.E().inV().values("name").to_df("name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(MODERN + " select name from v union all select name from v", example(modern))
def io_reads_into_graph(g):
    """A graph written and read into a graph that holds vertices already."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}.json"
    FileIO(g.graph, path).write()
    return FileIO(g.graph, path).read().traversal().V().values("name").to_df("name")


@query("select n_name as name, n_regionkey as region from nation")
def json_lines(g):
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}.json"
    next(t for t in g.graph.vertices if t.label == "nation").df.select(F.col("id").alias("key"), "name", "n_regionkey").write.json(path)
    found, bad = read_json_lines(g.graph.spark, path)
    return found.traversal().V().element_map("name", "n_regionkey").to_df("name", "region")


@query("select 'has_' || k as label, n from (values ('name', 25), ('region', 25)) t(k, n)")
def json_tree(g):
    """A folder of documents, one for each nation: an edge from each object to what it holds."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}"
    names = g.V().has_label("nation").element_map("name", "n_regionkey").to_df("name", "region")
    names.repartition(25, "name").select(F.to_json(F.struct("name", "region")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_json_tree(g.graph.spark, path).summary().where("element = 'edge'").select("label", "n")


@query("select o_orderkey as key, l_quantity as quantity from orders join lineitem on l_orderkey = o_orderkey where o_totalprice > 350000 and l_quantity > 40")
def json_documents(g):
    """Orders with their lines, one document a line: from each line item's quantity up to the order's key."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}"
    lines = g.V().has_label("order").has("o_totalprice", gt(350000)).as_("o").outE("contains").as_("e").select("o", "e").by("o_orderkey").by("l_quantity").to_df("key", "quantity")
    lines.groupBy("key").agg(F.collect_list(F.struct("quantity")).alias("lines")).select(F.to_json(F.struct("key", "lines")).alias("value")).write.text(path)
    tree = read_json_tree(g.graph.spark, path, lines=True).traversal()
    up = tree.V().has("name", "quantity").as_("q").in_("has_quantity").in_("has_item").in_("has_lines").out("has_key").as_("k").select("k", "q").by("value").by("value").to_df("key", "quantity")
    return up.select(F.col("key").cast("long").alias("key"), F.col("quantity").cast("double").alias("quantity")).where("quantity > 40")


# ---- three constrained legs: many simple paths from one vertex


def route_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Suppliers with 149 routes from each, of a length between 0 and 8999."""
    t = table_graph(spark, sf_dir)
    v = next(x for x in t.vertices if x.label == "supplier")
    n = v.df.count()
    k = F.explode(F.sequence(F.lit(2), F.lit(150))).alias("k")
    rows = v.df.select(F.col("id").alias("src"), k).select("src", ((F.col("src") * F.col("k") * 7 + F.col("k")) % max(n, 1)).alias("dst"), "k", ((F.col("src") * 131 + F.col("k") * 977) % 9000).alias("dist"))
    rows = rows.join(v.df.select(F.col("id").alias("dst")), "dst").select("src", "dst", F.col("k").cast("long").alias("eid"), F.col("k").cast("long").alias("_seq"), "dist")
    return PropertyGraph(spark, [v], [EdgeTable(rows, "route", "supplier", "supplier")], t.config)


@query(
    """with n as (select count(*) as n from supplier), e as materialized (select s_suppkey as a, (s_suppkey * k * 7 + k) % n as b from supplier, n, range(2, 151) t(k)
where (s_suppkey * 131 + k * 977) % 9000 <= 5000 and (s_suppkey * k * 7 + k) % n in (select s_suppkey from supplier))
select count(*) as paths, cast(sum(7) as bigint) as steps from e x join e y on y.a = x.b join e z on z.a = y.b where x.a = 3 and x.b <> x.a and y.b not in (x.a, x.b) and z.b not in (x.a, x.b, y.b)""",
    route_graph,
)
def leg_paths(g):
    leg = A.outE("route").has("dist", lte(5000)).inV().simple_path()
    paths = g.V().has_label("supplier").has_id(3).repeat(leg).times(3).as_path().to_df("p")
    return paths.agg(F.count(F.lit(1)).alias("paths"), F.sum(F.size("p")).cast("long").alias("steps"))


# ---- many walks, searches, hubs and joins by key: what a level of a traversal holds stays small

#: Walks from orders to parts and back, twice: how many end at each order.
WALKS = """with e as (select l_orderkey as o, l_partkey as p from lineitem),
a as (select p, count(*) as n from e group by p), b as (select o, sum(n) as n from e join a using (p) group by o),
c as (select p, sum(n) as n from e join b using (o) group by p), d as (select o, sum(n) as n from e join c using (p) group by o)"""
_WALK = A.out("contains").in_("contains")
simple("bulk_walks", f"{WALKS} select cast(sum(n) as bigint) as n from d", lambda g: g.V().has_label("order").repeat(_WALK).times(2).count().to_df("n"))
simple("bulk_sum", f"{WALKS} select cast(sum(n * c_nationkey) as bigint) as v from d join orders on o = o_orderkey join customer on o_custkey = c_custkey", lambda g: g.V().has_label("order").repeat(_WALK).times(2).in_("placed").values("c_nationkey").sum_().to_df("v"))
simple("bulk_mean", f"{WALKS} select round(sum(n * o_totalprice) / sum(n), 3) as v from d join orders on o = o_orderkey where o_totalprice > 1000", lambda g: g.V().has_label("order").repeat(_WALK).times(2).has("o_totalprice", gt(1000)).values("o_totalprice").mean().to_df("v").select(F.round("v", 3).alias("v")))
simple("bulk_dedup", "with e as (select l_orderkey as o, l_partkey as p, l_suppkey as s from lineitem) select count(distinct s) as n from e where o in (select o from e where p in (select p from e join orders on o = o_orderkey where o_totalprice > 390000))", lambda g: g.V().has_label("order").has("o_totalprice", gt(390000)).out("contains").in_("contains").out("shipped_by").dedup().count().to_df("n"))
simple("bulk_in_filter", "with e as (select l_orderkey as o, l_partkey as p from lineitem), a as (select p, count(*) as n from e group by p) select o_custkey as id from orders join e on o = o_orderkey join a using (p) group by 1 having sum(n) > 1500", lambda g: g.V().has_label("customer").filter_(A.out("placed").out("contains").in_("contains").count().is_(gt(1500))).to_df("id"))


_LEG = A.outE("route").as_("e").inV().filter_(A.select("e").values("dist").is_(lte(2000)))


def _search(levels: str) -> str:
    return f"""with recursive n as (select count(*) as n from supplier), e as materialized (select s_suppkey as a, (s_suppkey * k * 7 + k) % n as b from supplier, n, range(2, 151) t(k)
where (s_suppkey * 131 + k * 977) % 9000 <= 2000 and (s_suppkey * k * 7 + k) % n in (select s_suppkey from supplier)),
r as (select b, 1 as level from e where a = 3 union select e.b, {levels} from r join e on e.a = r.b {"where level < 3" if "level" in levels else ""}) select distinct b as id from r"""


simple("reachable", _search("level + 1"), lambda g: g.V().has_label("supplier").has_id(3).repeat(_LEG).times(3).emit().dedup().to_df("id"), route_graph)
simple("reachable_all", _search("1"), lambda g: g.V().has_label("supplier").has_id(3).repeat(_LEG).until(A.has_id(-1)).emit().dedup().to_df("id"), route_graph)
simple(
    "reachable_levels",
    """with n as (select count(*) as n from supplier), e as materialized (select s_suppkey as a, (s_suppkey * k * 7 + k) % n as b from supplier, n, range(2, 151) t(k)
where (s_suppkey * 131 + k * 977) % 9000 <= 2000 and (s_suppkey * k * 7 + k) % n in (select s_suppkey from supplier)),
x as materialized (select b as y from e where a = 3 and b <> 3), y as materialized (select y, b as z from x join e on a = y where b not in (3, y))
select 3 as length, count(*) as paths, count(distinct y) as ends from x union all select 5, count(*), count(distinct z) from y union all select 7, count(*), count(distinct b) from y join e on a = z where b not in (3, y, z)""",
    lambda g: g.V().has_label("supplier").has_id(3).repeat(_LEG.simple_path()).times(3).emit().as_("dest").path().count(Scope.local).as_("length").select("dest", "length").to_df("dest", "length").groupBy(F.col("length").cast("int").alias("length")).agg(F.count(F.lit(1)).alias("paths"), F.countDistinct("dest").alias("ends")),
    route_graph,
)
simple("reachable_turns", "with t as (select distinct conv_id * 1000 + turn as id from conversations) select x.id from t x where id % 1000 > 0 and (select count(*) from t y where y.id between x.id - x.id % 1000 and x.id) = x.id % 1000 + 1", lambda g: g.V().has("turn", 0).repeat(A.out("next_turn")).until(A.not_(A.out("next_turn"))).emit().dedup().to_df("id"), talk_graph)
simple("repeat_capped", "with t as (select distinct conv_id * 1000 + turn as id from conversations) select max(id) as id from t group by id // 1000 having min(id) % 1000 = 0 and max(id) - min(id) = count(*) - 1 and count(*) between 2 and 4", lambda g: g.V().has("turn", 0).repeat(A.out("next_turn"), times=3, until=A.not_(A.out("next_turn"))).to_df("id"), talk_graph)
simple("repeat_bindings", "with t as (select distinct conv_id * 1000 + turn as id from conversations) select min(id) as a, max(id) as b from t group by id // 1000 having min(id) % 1000 = 0 and max(id) - min(id) = count(*) - 1 and count(*) > 1", lambda g: g.V().has("turn", 0).as_("a").repeat(A.out("next_turn")).until(A.not_(A.out("next_turn"))).as_("b").select("a", "b").to_df(), talk_graph)
simple("filter_binding_hop", "select o_orderkey as id from orders join customer on o_custkey = c_custkey where c_nationkey < 3 and o_totalprice > 200000", lambda g: g.V().has_label("customer").as_("c").out("placed").has("o_totalprice", gt(200000)).filter_(A.select("c").out("in_nation").has_id(lt(3))).to_df("id"))
simple("local_binding", "select o_orderkey as o, (select count(*) from orders y where y.o_custkey = x.o_custkey) as n from orders x where o_totalprice > 350000", lambda g: g.V().has_label("customer").as_("c").out("placed").has("o_totalprice", gt(350000)).as_("o").local(A.select("c").out("placed").count()).as_("n").select("o", "n").to_df())


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders and parts; nine of ten edges start at one order, the smallest."""
    t = table_graph(spark, sf_dir)
    e = next(x for x in t.edges if x.label == "contains")
    hub = e.df.agg(F.min("src")).first()[0]
    rows = e.df.withColumn("src", F.when(F.col("_seq") % 10 > 0, F.lit(hub)).otherwise(F.col("src")))
    return PropertyGraph(spark, [v for v in t.vertices if v.label in ("order", "part")], [EdgeTable(rows, "star", "order", "part")], t.config).spread()


simple("hub_hop", "with e as (select case when l_partkey % 10 > 0 then (select min(l_orderkey) from lineitem) else l_orderkey end as o, l_partkey as p from lineitem) select o_orderstatus as status, p as part, count(*) as n from e join orders on o = o_orderkey group by all", lambda g: g.V().has_label("order").has("o_orderstatus").as_("o").out("star").as_("p").select("o", "p").by("o_orderstatus").by("p_partkey").to_df("status", "part").groupBy("status", "part").agg(F.count(F.lit(1)).alias("n")), star_graph)


def _joined(g: Source) -> Source:
    g.graph.join("customer", "supplier", "c_nationkey", "s_nationkey", "near")
    return g


simple("key_join_count", "select count(*) as n from customer join supplier on c_nationkey = s_nationkey", lambda g: _joined(g).V().has_label("customer").out("near").count().to_df("n"))
simple("key_join_dedup", "select distinct s_suppkey as id from customer join supplier on c_nationkey = s_nationkey where c_acctbal > 9000", lambda g: _joined(g).V().has_label("customer").has("c_acctbal", gt(9000)).out("near").dedup().to_df("id"))
simple("key_join_walks", "with n as (select k, (select count(*) from customer where c_nationkey = k) as c, (select count(*) from supplier where s_nationkey = k) as s from range(25) t(k)) select cast(sum(c * s * c * s) as bigint) as n from n", lambda g: _joined(g).V().has_label("customer").out("near").in_("near").out("near").count().to_df("n"))
simple("key_join_in_filter", "select c_custkey as id from customer where (select count(*) from supplier where s_nationkey = c_nationkey) > 4", lambda g: _joined(g).V().has_label("customer").filter_(A.out("near").count().is_(gt(4))).to_df("id"))

# ---- given tables: ids, pairs, look-ups, merges, maps, folders, builders

simple("ids_by_index", "select l_partkey as id from lineitem where l_orderkey = (select max(o_orderkey) from orders)", lambda g: _last_order(g).out("contains").to_df("id"))
simple("has_id_by_index", "select o_orderkey as id from orders where o_orderkey > (select max(o_orderkey) - 3 from orders)", lambda g: _last_order(g, 3).to_df("id"))


def _last_order(g: Source, n: int = 1) -> Traversal:
    """The orders of the greatest keys, from an index of ids over all tables."""
    last = g.V().has_label("order").values("o_orderkey").max_().next().run()
    indexed = g.graph.indexed().traversal()
    return indexed.V(last) if n == 1 else indexed.V().has_id(*range(last - n + 1, last + 1)).has_label("order")


simple("ids_of_table", "select p_name as name from part where p_partkey in (7, 3)", lambda g: g.V(7, 3).has_label("part").values("name").to_df("name"))
simple("pairs_of_table", "select n_nationkey as src, n_regionkey as dst from nation where n_nationkey in (3, 4)", lambda g: g.E(*[("nation:%d" % r["n_nationkey"], "region:%d" % r["n_regionkey"]) for r in _some_nations(g)]).to_df("src", "dst", "label").select(F.substring_index("src", ":", -1).cast("long").alias("src"), F.substring_index("dst", ":", -1).cast("long").alias("dst")), nations)


def _some_nations(g: Source) -> list:
    return g.V().has_label("nation").has("n_nationkey", within(3, 4)).element_map("n_nationkey", "n_regionkey").to_df().collect()


simple("nodes_of_table", "select n_nationkey as id from nation where n_name = (select max(n_name) from nation)", lambda g: g.graph.get_nodes("nation", g.V().has_label("nation").values("name").order(Order.desc).limit(1).next().run()).select(F.substring_index("id", ":", -1).cast("long").alias("id")), nations)


def map_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations with a map of their customers' market segments to what these customers hold."""
    t = table_graph(spark, sf_dir)
    v = {x.label: x for x in t.vertices}
    held = v["customer"].df.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("c_nationkey").cast("long").alias("id"))
    held = held.agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("segments"))
    return PropertyGraph(spark, [VertexTable(v["nation"].df.join(held, "id", "left"), "nation")], [], t.config)


simple("map_contains_key", "select distinct c_nationkey as id from customer where c_mktsegment = 'BUILDING'", lambda g: g.V().has_label("nation").contains("segments", "BUILDING").to_df("id"), map_graph)
simple("map_path_value", "select c_nationkey as id from customer where c_mktsegment = 'BUILDING' group by 1 having count(*) > 12", lambda g: g.V().has_label("nation").has(["segments", "BUILDING"], gt(12)).to_df("id"), map_graph)


@query("select n_name as name, 2 as n from nation union all select r_name, 2 from region", nations)
def merged_tables(g):
    """The graph of nations twice, the second time under new ids."""
    numbered = _numbered(g.graph)
    return numbered.plus(numbered).traversal().V().values("name").to_df("name").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select 'vertex' as element, 2 * ((select count(*) from nation) + (select count(*) from region)) as n union all select 'edge', 2 * (select count(*) from nation) + 1", nations)
def linked_tables(g):
    numbered = _numbered(g.graph)
    return numbered.merge(numbered, "0", "1", "to_copy").summary().groupBy("element").agg(F.sum("n").alias("n"))


def _numbered(graph: PropertyGraph) -> PropertyGraph:
    """Nations as 100 and more, regions from 0, in one vertex table as built graphs have."""
    number = lambda c: (F.substring_index(c, ":", -1).cast("long") + F.when(F.col(c).startswith("nation"), 100).otherwise(0)).cast("string")
    rows = graph.all_vertices().select(number("id").alias("id"), "name", "labels", number("id").cast("long").alias("_seq"))
    e = graph.edges[0].df.select(number("src").alias("src"), number("dst").alias("dst"), "eid", "_seq")
    return PropertyGraph(graph.spark, [VertexTable(rows)], [EdgeTable(e, "in_region")])


@query("select r_name as region, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1", nations)
def built_from_tables(g):
    """A builder takes vertices and edges row by row, one edge for each pair."""
    b = GraphBuilder()
    rows = _names(g.graph).collect()
    for name in sorted({r["region"] for r in rows}):
        b.add_labeled_node("region", name, node_id=name)
    for r in rows * 2:
        b.add_labeled_edge(b.add_labeled_node("nation", r["nation"], node_id="n" + r["nation"]), r["region"], "in_region")
    made = b.build(g.graph.spark).traversal()
    return made.E().inV().values("name").to_df("region").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("select n_name as name from nation union all select r_name from region union all select n_name from nation union all select r_name from region", nations)
def io_of_tables(g):
    """The graph of nations written to a file and read into the numbered graph of nations."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}.json"
    numbered = _numbered(g.graph)
    FileIO(numbered, path).write()
    return FileIO(numbered, path).read().traversal().V().values("name").to_df("name")


@query("select 'nations' as folder, count(distinct n_regionkey) as n from nation union all select 'region=' || n_regionkey, 1 from (select distinct n_regionkey from nation)")
def folder_files(g):
    """A folder of nations by region as a graph: how many folders or files each folder holds."""
    path = f"{shared_dir(g.graph.spark)}/hopwise-{uuid.uuid4().hex}/nations"
    rows = next(t for t in g.graph.vertices if t.label == "nation").df
    rows.select("name", F.col("n_regionkey").alias("region")).coalesce(1).write.partitionBy("region").json(path)
    found = read_folder(g.graph.spark, path, ignored=("_SUCCESS",)).traversal()
    return found.V().has_label("Directory").as_("d").out().as_("x").select("d", "x").by("name").by("name").to_df("folder", "x").groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
