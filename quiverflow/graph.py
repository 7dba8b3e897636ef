"""Immutable property graphs: tables of vertices and edges, lookups, new versions by mutation, events."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, VariantType

from .plans.traversal import Traversal
from .schema import EdgeTable, VertexTable
from .streaming.events import Emitter, Event


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


class PropertyGraph:
    """A version of a graph.  Mutations return a new version; this one stays as it is, so a snapshot is the graph itself."""

    def __init__(self, spark: SparkSession, vertices: list[VertexTable], edges: list[EdgeTable], emitter: Emitter | None = None, version: int = 0, log: tuple[Event, ...] = ()):
        self.spark, self.vertex_tables, self.edge_tables = spark, list(vertices), list(edges)
        self.emitter, self.version, self.log = emitter or Emitter(enabled=True), version, log

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        """vertices: id, seq, labels, properties.  edges: id, seq, src, dst, labels, properties."""
        return cls(vertices.sparkSession, [VertexTable(vertices)], [EdgeTable(edges)])

    # Traversals

    def traversal(self, compat: bool = False) -> Traversal:
        return Traversal(self, compat=compat)

    def V(self, *x) -> Traversal:
        return self.traversal().V(*x)

    def E(self, *x) -> Traversal:
        return self.traversal().E(*x)

    def traverse(self, *fns: Callable, compat: bool = False):
        """The functions' composition, applied to an empty traversal; anonymous traversals are appended."""
        t = self.traversal(compat)
        for fn in fns:
            t = Traversal(self, (*t.steps, *fn.steps), compat) if isinstance(fn, Traversal) else fn(t)
        return t

    # Lookups

    @property
    def vertices(self) -> DataFrame:
        return _union([t.df.drop("_key") for t in self.vertex_tables])

    @property
    def edges(self) -> DataFrame:
        return _union([t.df for t in self.edge_tables])

    def getVerticesByLabel(self, label: str) -> DataFrame:
        return self.vertices.filter(F.array_contains("labels", label))

    def getEdgesByLabel(self, label: str) -> DataFrame:
        return self.edges.filter(F.array_contains("labels", label))

    def getVertexById(self, i):
        """Only the tables whose ids may be such are read."""
        parts = [t.df.filter(F.col("id") == F.lit(i)).drop("_key") for t in self.vertex_tables if t.prefix is None or isinstance(i, str) and i.startswith(t.prefix)]
        return next(iter(_union(parts).take(1)), None) if parts else None

    def getEdgeById(self, i):
        return next(iter(self.edges.filter(F.col("id") == F.lit(i)).take(1)), None)

    def hasVertex(self, i) -> bool:
        return self.getVertexById(getattr(i, "id", i)) is not None

    def owns(self, element) -> bool:
        return self.hasVertex(element.id) or self.getEdgeById(element.id) is not None

    def edgesFromByLabel(self, i: str, label: str) -> DataFrame:
        return self.getEdgesByLabel(label).filter(F.col("src") == i)

    def edgesToByLabel(self, i: str, label: str) -> DataFrame:
        return self.getEdgesByLabel(label).filter(F.col("dst") == i)

    def hasLabel(self, i: str, *labels: str) -> bool:
        row = self.getVertexById(i) or self.getEdgeById(i)
        return row is not None and bool(set(labels) & set(row["labels"]))

    def getProperty(self, i: str, key: str):
        row = self.getVertexById(i) or self.getEdgeById(i)
        return None if row is None or key not in row.asDict() else row[key]

    def hasProperty(self, i: str, key: str) -> bool:
        return self.getProperty(i, key) is not None

    def vertexCount(self) -> int:
        return sum(t.df.count() for t in self.vertex_tables)

    def edgeCount(self) -> int:
        return sum(t.df.count() for t in self.edge_tables)

    def size(self) -> int:
        return self.vertexCount() + self.edgeCount()

    def stats(self) -> DataFrame:
        """kind, label, n: elements of each label (an element with several counts for each)."""
        parts = [t.df.select(F.lit(kind).alias("kind"), F.explode("labels").alias("label")) for kind, ts in (("vertex", self.vertex_tables), ("edge", self.edge_tables)) for t in ts]
        return _union(parts).groupBy("kind", "label").agg(F.count("*").alias("n"))

    # Versions

    def snapshot(self) -> PropertyGraph:
        return self

    clone = snapshot

    def on(self, kind: str, fn: Callable[[Event], None]) -> Callable[[], None]:
        return self.emitter.on(kind, fn)

    def once(self, kind: str, fn: Callable[[Event], None]) -> Callable[[], None]:
        return self.emitter.once(kind, fn)

    def subscribe(self, fn: Callable[[PropertyGraph], None]) -> Callable[[], None]:
        """fn gets each new version."""
        return self.emitter.on("@graph/version", lambda e: fn(e.value))

    def _next(self, kind: str, value: dict, build: Callable[[], tuple[list[VertexTable], list[EdgeTable]]]) -> PropertyGraph:
        """The version after a mutation, or this one if a listener vetoes it."""
        event = self.emitter.emit(kind, value)
        if event.defaultPrevented:
            return self
        vertices, edges = build()
        new = PropertyGraph(self.spark, vertices, edges, self.emitter, self.version + 1, (*self.log, event))
        self.emitter.emit("@graph/mutate", event)
        self.emitter.emit("@graph/version", new)
        return new

    def _row(self, tables: list, key: str, values: dict, properties: dict) -> list:
        """tables with one more row, in the table that holds elements without a fixed label."""
        k = next((k for k, t in enumerate(tables) if t.label is None), None)
        top = -1 if k is None else (tables[k].df.agg(F.max("seq")).first()[0] if not tables[k].df.isEmpty() else -1)
        fields = {**values, "seq": top + 1}
        schema = ", ".join(f"{c} {'long' if c == 'seq' else 'array<string>' if c == 'labels' else 'string'}" for c in fields)
        row = self.spark.createDataFrame([tuple(fields.values())], schema)
        for c, v in properties.items():
            row = row.withColumn(c, F.lit(v))
        if k is None:
            return [*tables, type(tables[0])(row) if tables else VertexTable(row)]
        return [type(t)(_union([t.df, row]), t.label) if j == k else t for j, t in enumerate(tables)]

    def addVertex(self, labels: list[str], properties: dict | None = None, id: str | None = None) -> PropertyGraph:
        """An id that exists leaves the graph as it is."""
        if id and self.hasVertex(id):
            return self
        value = {"id": id or str(uuid.uuid4()), "labels": list(labels), "properties": properties or {}}
        return self._next("@vertex/add", value, lambda: (self._row(self.vertex_tables, "id", {"id": value["id"], "labels": value["labels"]}, value["properties"]), self.edge_tables))

    def addEdge(self, src: str, dst: str, labels: list[str], properties: dict | None = None, id: str | None = None) -> PropertyGraph:
        """An id that exists, or an end that doesn't, leaves the graph as it is."""
        if id and self.getEdgeById(id) is not None or not (self.hasVertex(src) and self.hasVertex(dst)):
            return self
        value = {"id": id or str(uuid.uuid4()), "from": src, "to": dst, "labels": list(labels), "properties": properties or {}}
        return self._next("@edge/add", value, lambda: (self.vertex_tables, self._row(self.edge_tables, "id", {"id": value["id"], "src": src, "dst": dst, "labels": value["labels"]}, value["properties"])))

    def _map(self, tables: list, fn: Callable[[DataFrame], DataFrame]) -> list:
        return [type(t)(*(fn(t.df) if k == "df" else getattr(t, k) for k in t.__dataclass_fields__)) for t in tables]

    def removeVertex(self, id: str) -> PropertyGraph:
        """Its edges go too; an unknown id leaves the graph as it is."""
        if not self.hasVertex(id):
            return self
        return self._next("@vertex/remove", {"id": id}, lambda: (self._map(self.vertex_tables, lambda d: d.filter(F.col("id") != id)), self._map(self.edge_tables, lambda d: d.filter((F.col("src") != id) & (F.col("dst") != id)))))

    def removeEdge(self, id: str) -> PropertyGraph:
        if self.getEdgeById(id) is None:
            return self
        return self._next("@edge/remove", {"id": id}, lambda: (self.vertex_tables, self._map(self.edge_tables, lambda d: d.filter(F.col("id") != id))))

    def _change(self, kind: str, what: str, id: str, value: dict, fn: Callable[[DataFrame], DataFrame]) -> PropertyGraph:
        v, e = self.vertex_tables, self.edge_tables
        return self._next(f"@{kind}/{what}", {"id": id, **value}, lambda: (self._map(v, fn), e) if kind == "vertex" else (v, self._map(e, fn)))

    def _loose(self, tables: list) -> list:
        """Tables whose labels may change have no fixed label any more."""
        return [type(t)(t.df.drop("_key")) for t in tables]

    def _label(self, kind: str, what: str, id: str, label: str, fn) -> PropertyGraph:
        g = PropertyGraph(self.spark, self._loose(self.vertex_tables), self._loose(self.edge_tables), self.emitter, self.version, self.log)
        new = g._change(kind, what, id, {"label": label}, lambda d: d.withColumn("labels", F.when(F.col("id") == id, fn("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))))
        return self if new is g else new

    def addLabelToVertex(self, id: str, label: str) -> PropertyGraph:
        return self._label("vertex", "addLabel", id, label, F.array_union)

    def removeLabelFromVertex(self, id: str, label: str) -> PropertyGraph:
        return self._label("vertex", "removeLabel", id, label, F.array_except)

    def addLabelToEdge(self, id: str, label: str) -> PropertyGraph:
        return self._label("edge", "addLabel", id, label, F.array_union)

    def removeLabelFromEdge(self, id: str, label: str) -> PropertyGraph:
        return self._label("edge", "removeLabel", id, label, F.array_except)

    @staticmethod
    def _put(d: DataFrame, id: str, key: str, value) -> DataFrame:
        """key of one element becomes value; a column takes the wider type if value is a number of another one, and variants otherwise."""
        new = F.lit(value)
        if key not in d.columns:
            return d.withColumn(key, F.when(F.col("id") == id, new))
        old, kind, own = F.col(key), d.schema[key].dataType, d.select(new.alias("v")).schema["v"].dataType
        if value is not None and kind != own and not isinstance(kind, VariantType):
            if isinstance(kind, NumericType) and isinstance(own, NumericType):
                old, new = old.cast("double") if isinstance(value, float) else old, new if isinstance(value, float) else new.cast(kind)
            else:
                old, new = old.cast(VariantType()), new.cast(VariantType())
        elif isinstance(kind, VariantType):
            new = new.cast(VariantType())
        return d.withColumn(key, F.when(F.col("id") == id, new).otherwise(old))

    def setProperty(self, kind: str, id: str, key: str, value) -> PropertyGraph:
        """kind: vertex or edge."""
        return self._change(kind, "setProperty", id, {"key": key, "value": value}, lambda d: self._put(d, id, key, value))

    def setProperties(self, kind: str, id: str, values: dict) -> PropertyGraph:
        """values are added to the element's properties; others stay."""
        return self._change(kind, "setProperties", id, {"properties": values}, lambda d: reduce(lambda x, k: self._put(x, id, k, values[k]), values, d))

    def removeProperty(self, kind: str, id: str, key: str) -> PropertyGraph:
        return self._change(kind, "removeProperty", id, {"key": key}, lambda d: self._without(d, id, [key]))

    def removeProperties(self, kind: str, id: str, keys: list[str]) -> PropertyGraph:
        """One event for all keys."""
        return self._change(kind, "removeProperties", id, {"keys": list(keys)}, lambda d: self._without(d, id, keys))

    @staticmethod
    def _without(d: DataFrame, id: str, keys: list[str]) -> DataFrame:
        return d.withColumns({k: F.when(F.col("id") != id, F.col(k)) for k in keys if k in d.columns})

    def truncate(self) -> PropertyGraph:
        return self._next("@graph/truncate", {}, lambda: (self._map(self.vertex_tables, lambda d: d.limit(0)), self._map(self.edge_tables, lambda d: d.limit(0))))

    # JSON

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> PropertyGraph:
        from .sources.pg_json import loads

        return loads(spark, text)

    def to_json(self) -> str:
        from .sources.pg_json import dumps

        return dumps(self)
