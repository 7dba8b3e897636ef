"""The relational tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..graph import PropertyGraph
from ..schema import edge_table, vertex_table


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, customer, supplier, orders, lineitem, events = map(t, ("nation", "customer", "supplier", "orders", "lineitem", "events"))
    vertices = [
        vertex_table(t("region"), "Region", "r_regionkey", ["r_name"]),
        vertex_table(nation, "Nation", "n_nationkey", ["n_name"]),
        vertex_table(customer, "Customer", "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"]),
        vertex_table(supplier, "Supplier", "s_suppkey", ["s_name", "s_acctbal"]),
        vertex_table(t("part"), "Part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
        vertex_table(orders, "Order", "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"]),
        vertex_table(events, "Event", "event_id", ["event_type", "value"]),
        vertex_table(events.select("user_id").distinct(), "User", "user_id", []),
    ]
    line = "l_orderkey * 8 + l_linenumber"  # lines of one order and number repeat: the id is no key
    edges = [
        edge_table(nation, "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey"),
        edge_table(customer, "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey"),
        edge_table(supplier, "BASED_IN", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey"),
        edge_table(orders, "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey", ["o_orderdate"]),
        edge_table(lineitem, "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), line, ["l_quantity", "l_extendedprice", "l_discount"]),
        edge_table(lineitem, "SHIPPED_BY", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), line, ["l_shipdate"]),
        edge_table(events, "DID", ("User", "user_id"), ("Event", "event_id"), "event_id", ["ts"]),
    ]
    return PropertyGraph(spark, vertices, edges)
