"""Property graphs as JSON: {nodes: [{id, labels, properties}], edges: [{id?, from, to, labels, properties}]}."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import EdgeTable, VertexTable



def is_pg(value) -> bool:
    """Whether a parsed value has the format's shape."""
    ok = lambda x, *keys: isinstance(x, dict) and all(k in x for k in keys) and isinstance(x["labels"], list) and isinstance(x["properties"], dict)
    return isinstance(value, dict) and all(ok(n, "id", "labels", "properties") for n in value.get("nodes", [0])) and all(ok(e, "from", "to", "labels", "properties") for e in value.get("edges", [0]))


def graph_of(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """nodes (seq, id, labels, properties json), edges (seq, id, from, to, labels, properties json); an edge that hangs
    in the air raises when rows are read, parallel edges with one derived id collapse to the first.  One job finds the
    properties' names, their types and loose ends."""
    derived = F.concat(F.col("from"), F.lit("-["), F.array_join("labels", ","), F.lit("]->"), F.col("to"))
    edges = edges.withColumn("id", F.coalesce("id", derived))
    edges = edges.groupBy("id").agg(F.min_by(F.struct("seq", "from", "to", "labels", "properties"), "seq").alias("e")).select("id", "e.*")
    texts = F.from_json("properties", "map<string,string>")
    numbers = F.expr("v rlike '^\\\\[[-+0-9.eE,]*\\\\]$' and not contains(v, ',,') and not startswith(v, '[,')")  # no nested repetition, which long mixed lists would make backtrack
    seen = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.explode(texts).alias("name", "v")).groupBy("kind", "name").agg(F.coalesce(F.bool_and(numbers), F.lit(True)).alias("ok"))
    ends = nodes.filter("id is not null").select("id", F.lit(True).alias("ok")).union(edges.select(F.explode(F.array("from", "to")), F.lit(False)))
    loose = ends.groupBy("id").agg(F.bool_or("ok").alias("ok")).filter("not ok").select(F.lit("end"), "id", "ok").limit(1)
    found = seen("node", nodes).union(seen("edge", edges)).union(loose).collect()  # the schema
    if any(kind == "end" for kind, _, _ in found):
        raise ValueError("an edge's end is no node")
    tables = []
    for kind, df, cls, cols in (("node", nodes, VertexTable, ["id", "seq", "labels"]), ("edge", edges, EdgeTable, ["id", "seq", F.col("from").alias("src"), F.col("to").alias("dst"), "labels"])):
        props = [F.from_json(F.col("_texts")[k], "array<double>" if ok else "array<string>").alias(k) for k, ok in sorted((k, ok) for own, k, ok in found if own == kind)]
        tables.append(cls(df.withColumn("_texts", texts).select(*cols, *props)))
    return PropertyGraph(spark, [tables[0]], [tables[1]])


def loads(spark: SparkSession, text: str) -> PropertyGraph:
    value = json.loads(text)
    s = lambda x: None if x is None else str(x)
    nodes = [(k, s(n["id"]), n.get("labels", []), json.dumps(n.get("properties", {}))) for k, n in enumerate(value["nodes"])]
    edges = [(k, s(e.get("id")), s(e["from"]), s(e["to"]), e.get("labels", []), json.dumps(e.get("properties", {}))) for k, e in enumerate(value["edges"])]
    return graph_of(
        spark, spark.createDataFrame(nodes, "seq long, id string, labels array<string>, properties string"), spark.createDataFrame(edges, "seq long, id string, `from` string, `to` string, labels array<string>, properties string")
    )


def _fields(elements: DataFrame, *ends: str) -> DataFrame:
    """elements: seq, x (an element's text).  They are dealt out before they are parsed, since one file or row group is one task's; a text
    that is cut off gives what comes before the cut."""
    names = ["id", *ends, "labels", "properties"]
    parsed = elements.select("seq", "x").repartition("seq", "x").select("seq", "x", F.json_tuple("x", *names).alias(*names))
    fields = {k: F.coalesce(k, F.get_json_object("x", f"$.{k}")) for k in names}
    return parsed.select("seq", *((F.from_json(v, "array<string>") if k == "labels" else v).alias(k) for k, v in fields.items()))


def load(spark: SparkSession, path: str) -> PropertyGraph:
    """From files; a file is one graph document."""
    raw = spark.read.text(path, wholetext=True)
    part = lambda key: raw.select(F.posexplode(F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>")).alias("seq", "x")).select(F.col("seq").cast("long").alias("seq"), "x")
    return graph_of(spark, _fields(part("nodes")), _fields(part("edges"), "from", "to"))


def from_rows(rows: DataFrame) -> PropertyGraph:
    """The graph of json_rows: kind, seq, json."""
    part = lambda kind: rows.filter(F.col("kind") == kind).select("seq", F.col("json").alias("x"))
    return graph_of(rows.sparkSession, _fields(part("node")), _fields(part("edge"), "from", "to"))


def json_rows(graph: PropertyGraph) -> DataFrame:
    """kind, seq, json: each element's text in the format."""
    out = None
    for kind, tables in (("node", graph.vertex_tables), ("edge", graph.edge_tables)):
        for t in tables:
            props = F.struct(*((F.col(c) if t.df.schema[c].dataType.typeName() == "array" else F.when(F.col(c).isNotNull(), F.array(c))).alias(c) for c in t.props)) if t.props else F.create_map().cast("map<string,string>")
            ends = [] if kind == "node" else [F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(False).alias("undirected")]
            df = t.df.select(F.lit(kind).alias("kind"), "seq", F.to_json(F.struct("id", *ends, "labels", props.alias("properties"))).alias("json"))
            out = df if out is None else out.unionByName(df)
    return out


def to_json(graph: PropertyGraph, id: str) -> str | None:
    """One element's text, or null."""
    row = json_rows(graph).filter(F.get_json_object("json", "$.id") == F.lit(id)).select("json").first()
    return None if row is None else row[0]


def dumps(graph: PropertyGraph) -> str:
    """One text, for graphs that fit into the driver; json_rows(graph).write.text is for those that don't."""
    rows = json_rows(graph).orderBy("seq").collect()
    part = lambda kind: "[" + ",".join(r["json"] for r in rows if r["kind"] == kind) + "]"
    return f'{{"nodes":{part("node")},"edges":{part("edge")}}}'
