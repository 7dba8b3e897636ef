"""Registered queries over the relational tables as a graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import P
from .operators.listops import Seq
from .operators.tree import Tree
from .operators.trie import Trie
from .plans import __
from .sources.tables import table_graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str = "value"):
    """A traversal fn(graph), whose values are returned as column `name`, and its SQL."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(table_graph(spark, sf_dir))
            return out.withColumnRenamed("value", name) if isinstance(out, DataFrame) else out.to_df().withColumnRenamed("value", name)

        run.__name__ = fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def traversals(table: dict) -> None:
    for name, (fn, sql) in table.items():
        fn.__name__ = name
        query(sql)(fn)


def _fields(t, **fields: str) -> DataFrame:
    """A result of structs as columns."""
    return t.to_df().select(*(F.col(f"value.{f}").alias(n) for n, f in fields.items()))


traversals({
    # Sources and terminals
    "v_by_label": (lambda g: g.V().hasLabel("Nation").values("n_name"), "select n_name as value from nation"),
    "v_all_ids": (lambda g: g.V().hasLabel("Region", "Nation", "Supplier").id(), "select 'region:' || r_regionkey as value from region union all select 'nation:' || n_nationkey from nation union all select 'supplier:' || s_suppkey from supplier"),
    "v_by_id": (lambda g: g.V("customer:7").values("c_name"), "select c_name as value from customer where c_custkey = 7"),
    "e_by_label": (lambda g: g.E().hasLabel("IN_REGION").inV().id(), "select 'region:' || n_regionkey as value from nation"),
    "inject_values": (lambda g: g.traversal().inject(None, 10, 9, None).sum(), "select cast(19 as bigint) as value"),
    "inject_before": (lambda g: g.V("region:1").values("r_name").inject("first"), "select r_name as value from region where r_regionkey = 1 union all select 'first'"),
    # Adjacency
    "out_one_hop": (lambda g: g.V().hasLabel("Nation").out("IN_REGION").values("r_name"), "select r_name as value from nation join region on n_regionkey = r_regionkey"),
    "in_one_hop": (lambda g: g.V().hasLabel("Nation").in_("IN_NATION").values("c_name"), "select c_name as value from customer join nation on c_nationkey = n_nationkey"),
    "both_hop": (lambda g: g.V().hasLabel("Nation").both("IN_REGION", "BASED_IN").id(), "select 'region:' || n_regionkey as value from nation union all select 'supplier:' || s_suppkey from supplier join nation on s_nationkey = n_nationkey"),
    "out_all_labels": (lambda g: g.V().hasLabel("Order").out().id(), "select 'part:' || l_partkey as value from lineitem union all select 'supplier:' || l_suppkey from lineitem"),
    "out_e_props": (lambda g: g.V().hasLabel("Customer").outE("PLACED").id(), "select 'placed:' || o_orderkey as value from orders"),
    "in_e": (lambda g: g.V().hasLabel("Region").inE("IN_REGION").outV().values("n_name"), "select n_name as value from nation"),
    "both_e": (lambda g: g.V().hasLabel("Nation").bothE("IN_REGION", "IN_NATION").id(), "select 'in_region:' || n_nationkey as value from nation union all select 'in_nation:' || c_custkey from customer"),
    "in_v": (lambda g: g.V().hasLabel("Customer").outE("IN_NATION").inV().values("n_name"), "select n_name as value from customer join nation on c_nationkey = n_nationkey"),
    "out_v": (lambda g: g.E().hasLabel("BASED_IN").outV().values("s_name"), "select s_name as value from supplier"),
    "both_v": (lambda g: g.E().hasLabel("IN_REGION").bothV().id(), "select 'nation:' || n_nationkey as value from nation union all select 'region:' || n_regionkey from nation"),
    "other_v": (lambda g: g.V().hasLabel("Nation").bothE("IN_REGION", "BASED_IN").otherV().id(), "select 'region:' || n_regionkey as value from nation union all select 'supplier:' || s_suppkey from supplier"),
    "two_hop_count": (lambda g: g.V().hasLabel("Nation").in_("IN_NATION").out("PLACED").count(), "select count(*) as value from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey"),
    "two_hop_sum": (lambda g: g.V().hasLabel("Nation").in_("IN_NATION").out("PLACED").values("o_totalprice").sum().map(lambda c: F.round(c, 2)), "select round(sum(o_totalprice), 2) as value from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey"),
    "three_hop_dedup": (lambda g: g.V().hasLabel("Nation").in_("IN_NATION").out("PLACED").out("CONTAINS").dedup().count(), "select count(distinct l_partkey) as value from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey"),
    "user_events": (lambda g: g.V().hasLabel("User").out("DID").has("event_type", "click").count(), "select count(*) as value from events where event_type = 'click'"),
    # Filters and predicates
    "has_key": (lambda g: g.V().has("s_acctbal").id(), "select 'supplier:' || s_suppkey as value from supplier"),
    "has_eq": (lambda g: g.V().has("c_mktsegment", "BUILDING").id(), "select 'customer:' || c_custkey as value from customer where c_mktsegment = 'BUILDING'"),
    "has_label_eq": (lambda g: g.V().has("Part", "p_size", 15).values("p_name"), "select p_name as value from part where p_size = 15"),
    "has_gt": (lambda g: g.V().has("Order", "o_totalprice", P.gt(100000.0)).id(), "select 'order:' || o_orderkey as value from orders where o_totalprice > 100000"),
    "has_lte": (lambda g: g.V().has("Part", "p_size", P.lte(5)).id(), "select 'part:' || p_partkey as value from part where p_size <= 5"),
    "has_between": (lambda g: g.V().has("Part", "p_size", P.between(10, 20)).id(), "select 'part:' || p_partkey as value from part where p_size >= 10 and p_size < 20"),
    "has_inside": (lambda g: g.V().has("Part", "p_size", P.inside(10, 20)).id(), "select 'part:' || p_partkey as value from part where p_size > 10 and p_size < 20"),
    "has_outside": (lambda g: g.V().has("Part", "p_size", P.outside(5, 45)).id(), "select 'part:' || p_partkey as value from part where p_size < 5 or p_size > 45"),
    "has_within": (lambda g: g.V().has("c_mktsegment", P.within("BUILDING", "MACHINERY")).id(), "select 'customer:' || c_custkey as value from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "has_without": (lambda g: g.V().has("Customer", "c_mktsegment", P.without("BUILDING")).id(), "select 'customer:' || c_custkey as value from customer where c_mktsegment <> 'BUILDING'"),
    "has_neq": (lambda g: g.V().has("Order", "o_orderstatus", P.neq("F")).id(), "select 'order:' || o_orderkey as value from orders where o_orderstatus <> 'F'"),
    "has_starting_with": (lambda g: g.V().has("Nation", "n_name", P.startingWith("N")).values("n_name"), "select n_name as value from nation where n_name like 'N%'"),
    "has_id": (lambda g: g.V().hasId("region:1", "nation:2", "none:3").id(), "select 'region:1' as value union all select 'nation:2'"),
    "has_key_any": (lambda g: g.V().hasKey("r_name", "n_name").id(), "select 'region:' || r_regionkey as value from region union all select 'nation:' || n_nationkey from nation"),
    "has_not": (lambda g: g.V().hasLabel("Region", "Nation").hasNot("n_name").id(), "select 'region:' || r_regionkey as value from region"),
    "has_label_filter": (lambda g: g.V().hasLabel("Order").out().hasLabel("Supplier").count(), "select count(*) as value from lineitem"),
    "has_edge_prop": (lambda g: g.V().hasLabel("Order").outE("CONTAINS").has("l_quantity", P.gt(40.0)).inV().has("p_size", P.gt(25)).id(), "select 'part:' || l_partkey as value from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey where p_size > 25 and l_quantity > 40"),
    "is_value": (lambda g: g.V().hasLabel("Part").values("p_size").is_(7), "select p_size as value from part where p_size = 7"),
    "is_predicate": (lambda g: g.V().hasLabel("Part").values("p_size").is_(P.gte(45)), "select p_size as value from part where p_size >= 45"),
    "filter_fn": (lambda g: g.V().hasLabel("Part").values("p_name").filter(lambda c: F.length(c) % 2 == 0), "select p_name as value from part where length(p_name) % 2 = 0"),
    "none": (lambda g: g.V().hasLabel("Region").values("r_name").none(), "select r_name as value from region where false"),
    "dedup": (lambda g: g.V().hasLabel("Customer").values("c_mktsegment").dedup(), "select distinct c_mktsegment as value from customer"),
    # Sub-traversals
    "and_filter": (lambda g: g.V().hasLabel("Nation").and_(__.in_("IN_NATION"), __.in_("BASED_IN")).values("n_name"), "select n_name as value from nation where exists (select 1 from customer where c_nationkey = n_nationkey) and exists (select 1 from supplier where s_nationkey = n_nationkey)"),
    "or_filter": (lambda g: g.V().hasLabel("Customer").or_(__.has("c_acctbal", P.lt(0.0)), __.out("PLACED").has("o_totalprice", P.gt(300000.0))).id(), "select 'customer:' || c_custkey as value from customer where c_acctbal < 0 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)"),
    "not_filter": (lambda g: g.V().hasLabel("Customer").not_(__.outE("PLACED")).id(), "select 'customer:' || c_custkey as value from customer where not exists (select 1 from orders where o_custkey = c_custkey)"),
    "where_filter": (lambda g: g.V().hasLabel("Supplier").where(__.out("BASED_IN").out("IN_REGION").has("r_name", "ASIA")).id(), "select 'supplier:' || s_suppkey as value from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'"),
    "choose": (lambda g: g.V().hasLabel("Customer").choose(__.has("c_acctbal", P.lt(0.0)), __.out("IN_NATION"), __.out("PLACED")).id(), "select 'nation:' || c_nationkey as value from customer where c_acctbal < 0 union all select 'order:' || o_orderkey from customer join orders on o_custkey = c_custkey where not c_acctbal < 0"),
    "coalesce": (lambda g: g.V().hasLabel("Customer").coalesce(__.out("PLACED"), __.out("IN_NATION")).id(), "select 'order:' || o_orderkey as value from orders join customer on o_custkey = c_custkey union all select 'nation:' || c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)"),
    "optional": (lambda g: g.V().hasLabel("Nation").optional(__.in_("BASED_IN")).id(), "select coalesce('supplier:' || s_suppkey, 'nation:' || n_nationkey) as value from nation left join supplier on s_nationkey = n_nationkey"),
    "union": (lambda g: g.V().hasLabel("Nation").union(__.out("IN_REGION"), __.in_("BASED_IN")).id(), "select 'region:' || n_regionkey as value from nation union all select 'supplier:' || s_suppkey from supplier"),
    # Projections
    "ids": (lambda g: g.V().hasLabel("Region").id(), "select 'region:' || r_regionkey as value from region"),
    "labels": (lambda g: g.V().hasLabel("Nation").both().label(), "select 'Region' as value from nation union all select 'Customer' from customer union all select 'Supplier' from supplier"),
    "values_multi": (lambda g: g.V().hasLabel("Part").values("p_name", "p_size").map(lambda c: c.cast("string")), "select p_name as value from part union all select cast(p_size as varchar) from part"),
    "map_fn": (lambda g: g.V().hasLabel("Part").values("p_size").map(lambda c: c * 2 + 1), "select p_size * 2 + 1 as value from part"),
    "identity": (lambda g: g.V().hasLabel("Region").identity().values("r_name"), "select r_name as value from region"),
    "select_one": (lambda g: g.V().hasLabel("Nation").as_("n").out("IN_REGION").has("r_name", "EUROPE").select("n").by("n_name"), "select n_name as value from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'"),
    "path_by": (lambda g: g.V("region:2").in_("IN_REGION").in_("BASED_IN").path().map(lambda c: F.array_join(c, ">")), "select 'region:2>nation:' || n_nationkey || '>supplier:' || s_suppkey as value from nation join supplier on s_nationkey = n_nationkey where n_regionkey = 2"),
    "unfold": (lambda g: g.V().hasLabel("Region").values("r_name").fold().unfold(), "select r_name as value from region"),
    # Barriers
    "count": (lambda g: g.V().hasLabel("Order").count(), "select count(*) as value from orders"),
    "sum": (lambda g: g.V().hasLabel("Part").values("p_size").sum(), "select cast(sum(p_size) as bigint) as value from part"),
    "mean": (lambda g: g.V().hasLabel("Part").values("p_size").mean().map(lambda c: F.round(c, 6)), "select round(avg(p_size), 6) as value from part"),
    "min": (lambda g: g.V().hasLabel("Customer").values("c_name").min(), "select min(c_name) as value from customer"),
    "max": (lambda g: g.V().hasLabel("Order").values("o_totalprice").max(), "select max(o_totalprice) as value from orders"),
    "fold_sorted": (lambda g: g.V().hasLabel("Region").values("r_name").order().fold().map(lambda c: F.array_join(c, ",")), "select string_agg(r_name, ',' order by r_name) as value from region"),
    "fold_seed": (lambda g: g.V().hasLabel("Nation").values("n_name").map(lambda c: F.length(c)).fold(0, lambda a, b: a + b), "select cast(sum(length(n_name)) as integer) as value from nation"),
    # Order and slices
    "order_limit": (lambda g: g.V().hasLabel("Order").values("o_totalprice").order().limit(10), "select o_totalprice as value from orders order by o_totalprice limit 10"),
    "order_by_desc": (lambda g: g.V().hasLabel("Customer").order().by("c_name", "desc").limit(5).id(), "select 'customer:' || c_custkey as value from customer order by c_name desc limit 5"),
    "range_slice": (lambda g: g.V().hasLabel("Customer").values("c_name").range(10, 20), "select c_name as value from customer order by c_custkey limit 10 offset 10"),
    "skip": (lambda g: g.V().hasLabel("Nation").values("n_name").skip(20), "select n_name as value from nation order by n_nationkey offset 20"),
    "tail": (lambda g: g.V().hasLabel("Order").values("o_totalprice").order().tail(100), "select o_totalprice as value from orders order by o_totalprice desc limit 100"),
})

traversals({
    "as_select_by": (
        lambda g: _fields(g.V().hasLabel("Nation").as_("a").out("IN_REGION").in_("IN_REGION").as_("b").select("a", "b").by("n_name"), a="a", b="b"),
        "select x.n_name as a, y.n_name as b from nation x join nation y on x.n_regionkey = y.n_regionkey",
    ),
    "value_map": (lambda g: _fields(g.V().hasLabel("Supplier").valueMap("s_name", "s_acctbal"), s_name="s_name", s_acctbal="s_acctbal"), "select s_name, s_acctbal from supplier"),
    "label_counts": (
        lambda g: g.stats().filter("kind = 'vertex' and label <> 'User'").select("label", "n"),
        "select 'Region' as label, count(*) as n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer union all select 'Supplier', count(*) from supplier union all select 'Part', count(*) from part union all select 'Order', count(*) from orders union all select 'Event', count(*) from events",
    ),
    # Edges that are parallel, by their own properties
    "edge_values_sum": (lambda g: g.V().hasLabel("Order").outE("CONTAINS").values("l_quantity").sum().map(lambda c: F.round(c, 2)), "select round(sum(l_quantity), 2) as value from lineitem"),
    "edge_has_prop": (lambda g: g.E().hasLabel("CONTAINS").has("l_quantity", P.gt(40.0)).count(), "select count(*) as value from lineitem where l_quantity > 40"),
    "edge_has_prop_ends": (lambda g: g.V().hasLabel("Order").outE("SHIPPED_BY").has("l_shipdate").inV().id(), "select 'supplier:' || l_suppkey as value from lineitem where l_shipdate is not null"),
    "edge_value_map": (lambda g: _fields(g.E().hasLabel("CONTAINS").valueMap("l_quantity", "l_discount"), q="l_quantity", d="l_discount"), "select l_quantity as q, l_discount as d from lineitem"),
    "edge_labels": (lambda g: g.V().hasLabel("Supplier").bothE().label(), "select 'BASED_IN' as value from supplier union all select 'SHIPPED_BY' from lineitem"),
    "edge_count": (lambda g: g.E().count(), "select (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from orders) + 2 * (select count(*) from lineitem) + (select count(*) from events) as value"),
    "e_by_id": (lambda g: g.E("in_region:3").inV().values("r_name"), "select r_name as value from nation join region on n_regionkey = r_regionkey where n_nationkey = 3"),
    # Aggregates of nothing, branches over whole streams
    "where_count_zero": (lambda g: g.V().hasLabel("Customer").where(__.out("PLACED").count().is_(0)).id(), "select 'customer:' || c_custkey as value from customer where not exists (select 1 from orders where o_custkey = c_custkey)"),
    "where_count_many": (lambda g: g.V().hasLabel("Customer").where(__.out("PLACED").count().is_(P.gt(10))).id(), "select 'customer:' || o_custkey as value from orders group by o_custkey having count(*) > 10"),
    "union_counts": (lambda g: g.V().hasLabel("Nation").union(__.out("IN_REGION").count(), __.in_("BASED_IN").count()), "select count(*) as value from nation union all select count(*) from supplier"),
    "optional_count": (lambda g: g.V().hasLabel("Nation").optional(__.in_("BASED_IN").count()).to_df().select(F.col("value").cast("long").alias("value")), "select count(s_suppkey) as value from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey"),
    "choose_count": (lambda g: g.V().hasLabel("Customer").choose(__.out("PLACED").count().is_(0), __.id(), __.label()), "select case when exists (select 1 from orders where o_custkey = c_custkey) then 'Customer' else 'customer:' || c_custkey end as value from customer"),
    # Values of mixed types
    "is_mixed": (lambda g: g.V().hasLabel("Part").values("p_name", "p_size").is_(P.gt(25)).count(), "select count(*) as value from part where p_size > 25"),
    "is_mixed_text": (lambda g: g.V().hasLabel("Part").values("p_brand", "p_size").is_("Brand#11").count(), "select count(*) as value from part where p_brand = 'Brand#11'"),
    "max_mixed": (lambda g: g.V().hasLabel("Part").values("p_name", "p_size").max().map(lambda c: c.cast("double")), "select cast(max(p_size) as double) as value from part"),
    "min_mixed": (lambda g: g.V().hasLabel("Part").values("p_name", "p_size").min().map(lambda c: c.cast("double")), "select cast(min(p_size) as double) as value from part"),
    "order_mixed": (lambda g: g.V().hasLabel("Part").values("p_name", "p_size").order().limit(5).map(lambda c: c.cast("double")), "select cast(p_size as double) as value from part order by p_size limit 5"),
    "map_python": (lambda g: g.V().hasLabel("Part").values("p_size").map(lambda v: f"{v}!", "string"), "select p_size || '!' as value from part"),
    "map_python_float": (lambda g: g.V().hasLabel("Part").values("p_size").map(lambda v: float(v) / 2, "double"), "select p_size / 2.0::double as value from part"),
    "filter_python": (lambda g: g.V().hasLabel("Part").values("p_name").filter(lambda v: len(v) > 12), "select p_name as value from part where length(p_name) > 12"),
    # More predicates and projections
    "has_p_eq": (lambda g: g.V().has("Part", "p_size", P.eq(15)).id(), "select 'part:' || p_partkey as value from part where p_size = 15"),
    "has_gte": (lambda g: g.V().has("Part", "p_size", P.gte(45)).id(), "select 'part:' || p_partkey as value from part where p_size >= 45"),
    "has_edge_label": (lambda g: g.E().hasLabel("PLACED", "IN_REGION").count(), "select (select count(*) from orders) + (select count(*) from nation) as value"),
    "v_null": (lambda g: g.V(None).V().hasLabel("Region").id(), "select 'region:' || r_regionkey as value from region"),
    "properties": (lambda g: _fields(g.V().hasLabel("Region").properties("r_name"), r_name="r_name"), "select r_name from region"),
    "has_value": (lambda g: g.V().hasLabel("Region").properties("r_name").hasValue("ASIA").values("r_name"), "select r_name as value from region where r_name = 'ASIA'"),
    "path_by_name": (lambda g: g.V().hasLabel("Region").out("X").path().by("r_name").map(lambda c: F.array_join(c, ">")), "select r_name as value from region where false"),
    "path_by_key": (lambda g: g.V().hasLabel("Nation").path().by("n_name").map(lambda c: F.array_join(c, ">")), "select n_name as value from nation"),
    "by_elsewhere": (lambda g: g.V().hasLabel("Nation").identity().by("n_name"), "select n_name as value from nation"),
    "dedup_elements": (lambda g: g.V().hasLabel("Customer").out("IN_NATION").dedup().values("n_name"), "select n_name as value from nation where exists (select 1 from customer where c_nationkey = n_nationkey)"),
    # Mutations
    "set_properties": (lambda g: _fields(g.setProperties("vertex", "region:1", {"r_name": "X", "size": 3}).V().hasLabel("Region").valueMap("r_name", "size"), r_name="r_name", size="size"), "select case when r_regionkey = 1 then 'X' else r_name end as r_name, case when r_regionkey = 1 then 3 end as size from region"),
    "set_property_wider": (lambda g: g.setProperty("vertex", "part:1", "p_size", 2.5).V().hasLabel("Part").values("p_size"), "select case when p_partkey = 1 then 2.5 else cast(p_size as double) end as value from part"),
    "remove_property": (lambda g: g.removeProperty("vertex", "region:1", "r_name").V().hasLabel("Region").hasNot("r_name").id(), "select 'region:1' as value"),
    "remove_properties": (lambda g: g.removeProperties("vertex", "customer:1", ["c_name", "c_acctbal"]).V().hasLabel("Customer").has("c_name").count(), "select count(*) - 1 as value from customer"),
    "set_edge_property": (lambda g: g.setProperty("edge", "in_region:3", "since", 1990).E().has("since", 1990).outV().values("n_name"), "select n_name as value from nation where n_nationkey = 3"),
    "add_vertex": (lambda g: g.addVertex(["Region"], {"r_name": "NEW"}, "r-new").V().hasLabel("Region").values("r_name"), "select r_name as value from region union all select 'NEW'"),
    "add_edge": (lambda g: g.addEdge("nation:3", "region:4", ["TWINNED"], {}, "t1").V().hasLabel("Nation").out("TWINNED").values("r_name"), "select r_name as value from region where r_regionkey = 4"),
    "remove_edge": (lambda g: g.removeEdge("in_region:3").V().hasLabel("Nation").out("IN_REGION").count(), "select count(*) - 1 as value from nation"),
    "add_vertex_label": (lambda g: g.addLabelToVertex("region:1", "Big").V().hasLabel("Big").values("r_name"), "select r_name as value from region where r_regionkey = 1"),
    "remove_vertex_label": (lambda g: g.removeLabelFromVertex("region:1", "Region").V().hasLabel("Region").id(), "select 'region:' || r_regionkey as value from region where r_regionkey <> 1"),
    "add_edge_label": (lambda g: g.addLabelToEdge("in_region:3", "SPECIAL").V().hasLabel("Nation").out("SPECIAL").values("r_name"), "select r_name as value from nation join region on n_regionkey = r_regionkey where n_nationkey = 3"),
    "remove_edge_label": (lambda g: g.removeLabelFromEdge("in_region:3", "IN_REGION").V().hasLabel("Nation").out("IN_REGION").count(), "select count(*) - 1 as value from nation"),
    "truncate": (lambda g: g.truncate().V().count(), "select cast(0 as bigint) as value"),
    "edges_from": (lambda g: g.edgesFromByLabel("nation:3", "IN_REGION").select("id", "dst"), "select 'in_region:3' as id, 'region:' || n_regionkey as dst from nation where n_nationkey = 3"),
    "edges_to": (lambda g: g.edgesToByLabel("nation:3", "IN_NATION").select("id", "src"), "select 'in_nation:' || c_custkey as id, 'customer:' || c_custkey as src from customer where c_nationkey = 3"),
    "vertices_by_label": (lambda g: g.getVerticesByLabel("Supplier").select("id", "s_name"), "select 'supplier:' || s_suppkey as id, s_name from supplier"),
    "edges_by_label": (lambda g: g.getEdgesByLabel("IN_REGION").select("src", "dst"), "select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation"),
    "remove_vertex": (lambda g: g.removeVertex("nation:3").V().hasLabel("Region").in_("IN_REGION").id(), "select 'nation:' || n_nationkey as value from nation where n_nationkey <> 3"),
    "set_property": (lambda g: g.setProperty("vertex", "region:1", "r_name", "X").V().hasLabel("Region").values("r_name"), "select case when r_regionkey = 1 then 'X' else r_name end as value from region"),
})


def _named(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return add


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


@_named("select p_partkey as pos, p_size as v from part where p_partkey < coalesce((select min(p_partkey) from part where not p_size < 45), 1e18)")
def list_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Seq(_parts(spark, sf_dir).select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("v"))).takeWhile(lambda v: v < 45).df


@_named("select p_partkey as pos, p_size as v from part where p_partkey > (select min(p_partkey) from part where p_size = 30)")
def list_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Seq(_parts(spark, sf_dir).select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("v"))).after(lambda v: v == 30).df


@_named("select p_brand as v, min(p_partkey) as pos from part group by p_brand")
def list_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Seq(_parts(spark, sf_dir).select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("v"))).distinct().df


@_named("select p_partkey as seq, p_name as key from part where p_name like 'a%' and p_name <> 'a'")
def trie_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trie(_parts(spark, sf_dir).select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("key"), F.lit(1).alias("value"))).descendantsOf("a").select("seq", "key")


def _tree(spark: SparkSession, sf_dir: str) -> Tree:
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    rows = region.select(F.expr("'r' || r_regionkey").alias("id"), F.lit("all").alias("parent_id"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("value"))
    rows = rows.union(nation.select(F.expr("'n' || n_nationkey"), F.expr("'r' || n_regionkey"), "n_nationkey", "n_name"))
    return Tree(spark.sql("select 'all' as id, cast(null as string) as parent_id, 0 as pos, 'all' as value").union(rows))


@_named("select 'all' as id, 0 as depth union all select 'r' || r_regionkey, 1 from region union all select 'n' || n_nationkey, 2 from nation")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).walk().select("id", "depth")


@_named("select 'r' || n_regionkey as id, 1 as distance from nation where n_nationkey = 7 union all select 'all', 2")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).ancestors("n7").select("id", "distance")


def _seq(spark: SparkSession, sf_dir: str, value: str) -> Seq:
    return Seq(_parts(spark, sf_dir).select(F.col("p_partkey").alias("pos"), F.col(value).alias("v")))


def sequences(table: dict) -> None:
    for name, (fn, value, sql) in table.items():
        _named(sql)(lambda spark, sf_dir, fn=fn, value=value: fn(_seq(spark, sf_dir, value)).df)
        QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("<lambda>"), ORACLE_SQL.pop("<lambda>")


_ALL = "select p_partkey as pos, {} as v from part"
sequences({
    "list_before": (lambda q: q.before(lambda v: v == 30), "p_size", _ALL.format("p_size") + " where p_partkey < (select min(p_partkey) from part where p_size = 30)"),
    "list_skip_while": (lambda q: q.skipWhile(lambda v: v < 45), "p_size", _ALL.format("p_size") + " where p_partkey >= (select min(p_partkey) from part where not p_size < 45)"),
    "list_filter": (lambda q: q.filter(lambda v: v > 40), "p_size", _ALL.format("p_size") + " where p_size > 40"),
    "list_reject": (lambda q: q.reject(lambda v: v > 40), "p_size", _ALL.format("p_size") + " where not p_size > 40"),
    "list_take": (lambda q: q.take(7), "p_name", _ALL.format("p_name") + " order by p_partkey limit 7"),
    "list_skip": (lambda q: q.skip(50), "p_name", _ALL.format("p_name") + " order by p_partkey offset 50"),
    "list_slice": (lambda q: q.slice(10, 20), "p_name", _ALL.format("p_name") + " order by p_partkey limit 10 offset 10"),
    "list_tail": (lambda q: q.tail(), "p_name", _ALL.format("p_name") + " order by p_partkey offset 1"),
    "list_pipe": (lambda q: q.pipe(lambda x: x.filter(lambda v: v > 10), lambda x: x.take(5)), "p_size", _ALL.format("p_size") + " where p_size > 10 order by p_partkey limit 5"),
})


@_named("select count(*) as n, bool_and(p_size > 0) as every, bool_or(p_size > 49) as some, arg_min(p_name, p_partkey) as head, arg_max(p_name, p_partkey) as last from part")
def list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, names = _seq(spark, sf_dir, "p_size"), _seq(spark, sf_dir, "p_name")
    return spark.createDataFrame([(sizes.count(), sizes.every(lambda v: v > 0), sizes.some(lambda v: v > 49), names.head(), names.last())], "n long, every boolean, some boolean, head string, last string")


def _trie(spark: SparkSession, sf_dir: str) -> Trie:
    return Trie(_parts(spark, sf_dir).select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("key"), F.col("p_size").alias("value"))).unique()


@_named("select p_name as key, arg_max(p_size, p_partkey) as value from part group by p_name")
def trie_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trie(spark, sf_dir).df.select("key", "value")


@_named("select p_name as key from part group by p_name having p_name <> (select min(p_name) from part)")
def trie_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trie(spark, sf_dir)
    return t.remove(t.df.agg(F.min("key")).first()[0]).df.select("key")


@_named("select count(distinct p_name) as words from part")
def trie_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_trie(spark, sf_dir).words,)], "words long")


@_named("select 'n' || n_nationkey as id from nation where n_regionkey = 2")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).children("r2").select("id")


@_named("select 'all' as id union all select 'r' || r_regionkey from region where r_regionkey <> 1 union all select 'n' || n_nationkey from nation")
def tree_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).remove("r1").walk().select("id")


@_named("select 'n' || n_nationkey as id from nation where n_regionkey in (1, 2) union all select 'r1' union all select 'r2'")
def tree_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).move("r1", "r2").walk("r2").select("id")


_NAMES = "select 'region:' || r_regionkey as id, r_name as name from region union all select 'nation:' || n_nationkey, n_name from nation union all select 'customer:' || c_custkey, c_name from customer union all select 'supplier:' || s_suppkey, s_name from supplier"


@_named(f"""{_NAMES} union all select 'in_region:' || n_nationkey, 'nation:' || n_nationkey || '>region:' || n_regionkey from nation
  union all select 'in_nation:' || c_custkey, 'customer:' || c_custkey || '>nation:' || c_nationkey from customer
  union all select 'based_in:' || s_suppkey, 'supplier:' || s_suppkey || '>nation:' || s_nationkey from supplier""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of vertices and three of edges, as JSON rows and read back: names of vertices, ends of edges."""
    from .graph import PropertyGraph
    from .sources.pg_json import from_rows, json_rows

    g = table_graph(spark, sf_dir)
    back = from_rows(json_rows(PropertyGraph(spark, g.vertex_tables[:4], g.edge_tables[:3])))
    names = back.vertices.select("id", F.get(F.coalesce("r_name", "n_name", "c_name", "s_name"), 0).alias("name"))
    return names.union(back.edges.select("id", F.concat("src", F.lit(">"), "dst")))
