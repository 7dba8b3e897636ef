"""Live queries: a traversal run again for each version of a graph, or for each batch of a mutation log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..graph import PropertyGraph


class Live:
    """The latest result of fn(graph.traversal()); listeners hear of it only when it differs from the one before."""

    def __init__(self, graph: PropertyGraph, fn: Callable):
        self.fn, self.listeners = fn, []
        self.graph, self.value = graph, fn(graph.traversal()).toArray()
        self.stop = graph.subscribe(self.update)

    def update(self, graph: PropertyGraph) -> None:
        self.graph, new = graph, self.fn(graph.traversal()).toArray()
        if new != self.value:
            self.value = new
            for listener in self.listeners:
                listener(new)


#: Operations of a mutation log.
OPERATIONS = frozenset("addVertex removeVertex addEdge removeEdge addLabelToVertex removeLabelFromVertex addLabelToEdge removeLabelFromEdge setVertexProperty removeVertexProperty setEdgeProperty removeEdgeProperty".split())


def apply_log(graph: PropertyGraph, log: DataFrame) -> PropertyGraph:
    """graph after a batch of mutations: op, id, and labels, src, dst, key, value (text) and version, as far as the operations need them.

    Set operations on the tables, not a loop over rows.  Adds come first, then labels and properties, then removes; of several
    values for one property that of the greatest version counts.  What exists stays as it is,
    edges without both ends are left out, and a vertex takes its edges with it.  An unknown operation raises.
    """
    from pyspark.sql import functions as F

    from ..schema import EdgeTable, VertexTable

    unknown = [r[0] for r in log.select("op").distinct().limit(len(OPERATIONS) + 1).collect() if r[0] not in OPERATIONS]
    if unknown:
        raise ValueError(f"unknown operations {unknown}")
    for c, kind in (("labels", "array<string>"), ("src", "string"), ("dst", "string"), ("key", "string"), ("value", "string"), ("version", "long")):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast(kind))
    v, e = graph.vertices, graph.edges
    seq = F.xxhash64("id").alias("seq")

    def changed(df: DataFrame, kind: str) -> DataFrame:
        labels = log.filter(F.col("op").isin(f"addLabelTo{kind}", f"removeLabelFrom{kind}"))
        labels = labels.groupBy(F.col("id").alias("_id")).agg(*(F.flatten(F.collect_list(F.when(F.col("op").startswith(w), F.col("labels")))).alias(n) for w, n in (("add", "_more"), ("remove", "_less"))))
        df = df.join(labels, F.col("id") == F.col("_id"), "left").withColumn("labels", F.when(F.col("_id").isNull(), F.col("labels")).otherwise(F.array_except(F.array_union("labels", "_more"), "_less"))).drop("_id", "_more", "_less")
        props = log.filter(F.col("op").isin(f"set{kind}Property", f"remove{kind}Property"))
        for key in [r[0] for r in props.select("key").distinct().collect()]:  # columns of the result
            last = props.filter(F.col("key") == key).groupBy(F.col("id").alias("_id")).agg(F.max_by(F.when(F.col("op").startswith("set"), F.col("value")), "version").alias("_v"))
            old = F.col(key) if key in df.columns else F.lit(None).cast("string")
            new = F.col("_v").cast(df.schema[key].dataType) if key in df.columns else F.col("_v")
            df = df.join(last, F.col("id") == F.col("_id"), "left").withColumn(key, F.when(F.col("_id").isNull(), old).otherwise(new)).drop("_id", "_v")
        return df

    new_v = log.filter("op = 'addVertex'").select("id", seq, "labels").dropDuplicates(["id"]).join(v.select("id"), "id", "left_anti")
    gone_v, gone_e = (log.filter(f"op = '{op}'").select("id").distinct() for op in ("removeVertex", "removeEdge"))
    v = changed(v.unionByName(new_v, allowMissingColumns=True), "Vertex").join(gone_v, "id", "left_anti")
    new_e = log.filter("op = 'addEdge'").select("id", seq, "src", "dst", "labels").dropDuplicates(["id"]).join(e.select("id"), "id", "left_anti")
    ids = v.select(F.col("id").alias("_id"))
    e = changed(e.unionByName(new_e, allowMissingColumns=True), "Edge").join(gone_e, "id", "left_anti")
    for end in ("src", "dst"):
        e = e.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return PropertyGraph(graph.spark, [VertexTable(v)], [EdgeTable(e)], graph.emitter, graph.version + 1, graph.log)


def follow(graph: PropertyGraph, stream: DataFrame, on_version: Callable[[PropertyGraph], None], checkpoint: str, **options):
    """Structured Streaming: each micro-batch of a mutation log makes a version.  Returns the started query."""
    state = {"graph": graph}

    def batch(df: DataFrame, _: int) -> None:
        state["graph"] = apply_log(state["graph"], df)
        on_version(state["graph"])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
