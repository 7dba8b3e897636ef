"""Ordered trees as a table (id, parent_id, pos, value), walked by recursive SQL."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels that a recursive query may have; a tree that is deeper raises.
DEEPEST = 1_000_000
SCHEMA = "id string, parent_id string, pos int, value string"


@dataclass(frozen=True)
class Tree:
    df: DataFrame

    @classmethod
    def from_(cls, spark: SparkSession, value, id: str = "root") -> Tree:
        return cls(spark.createDataFrame([(id, None, 0, value)], SCHEMA))

    @classmethod
    def deserialize(cls, spark: SparkSession, text: str) -> Tree:
        """A list of {id, parentId, value}, parents first; there must be one root."""
        rows, count = [], {}
        for r in json.loads(text):
            p = r.get("parentId")
            rows.append((r["id"], p, count.get(p, 0), r["value"]))
            count[p] = count.get(p, 0) + 1
        if count.get(None, 0) != 1:
            raise ValueError(f"a tree has one root, not {count.get(None, 0)}")
        return cls(spark.createDataFrame(rows, SCHEMA))

    def _recursive(self, start: str, step: str, select: str, **args) -> DataFrame:
        """A recursive query over {t}, this tree's table, as deep as the tree is; args: values for its :names."""
        spark, name = self.df.sparkSession, f"tree_{uuid.uuid4().hex}"
        self.df.createOrReplaceTempView(name)
        try:
            return spark.sql(f"WITH RECURSIVE w MAX RECURSION LEVEL {DEEPEST} AS ({start} UNION ALL {step}) {select}".replace("{t}", name), args)
        finally:
            spark.catalog.dropTempView(name)

    def walk(self, id: str | None = None) -> DataFrame:
        """id, parent_id, value, depth, path of the subtree at id (or of all)."""
        return self._recursive(
            f"SELECT id, parent_id, value, 0 AS depth, CAST(array(pos) AS array<int>) AS path FROM {{t}} WHERE {'parent_id IS NULL' if id is None else 'id = :id'}",
            "SELECT c.id, c.parent_id, c.value, w.depth + 1, concat(w.path, array(c.pos)) FROM {t} c JOIN w ON c.parent_id = w.id",
            "SELECT * FROM w",
            **({} if id is None else {"id": id}),
        )

    def depthFirst(self, id: str | None = None) -> list:
        return [r["value"] for r in self.walk(id).orderBy("path").collect()]

    def breadthFirst(self, id: str | None = None) -> list:
        return [r["value"] for r in self.walk(id).orderBy("depth", "path").collect()]

    def filterDepthFirst(self, p, id: str | None = None) -> list:
        return [r["value"] for r in self.walk(id).filter(p(F.col("value"))).orderBy("path").collect()]

    def filterBreadthFirst(self, p, id: str | None = None) -> list:
        return [r["value"] for r in self.walk(id).filter(p(F.col("value"))).orderBy("depth", "path").collect()]

    toList = depthFirst

    def ancestors(self, id: str) -> DataFrame:
        """id, value, distance; nearest first by distance."""
        return self._recursive(
            "SELECT id, parent_id, value, 0 AS distance FROM {t} WHERE id = :id",
            "SELECT p.id, p.parent_id, p.value, w.distance + 1 FROM {t} p JOIN w ON w.parent_id = p.id",
            "SELECT id, value, distance FROM w WHERE distance > 0",
            id=id,
        )

    def root(self) -> str:
        return self.df.filter("parent_id IS NULL").first()["id"]

    def isRoot(self, id: str) -> bool:
        return self.root() == id

    def parent(self, id: str) -> str | None:
        row = self.df.filter(F.col("id") == id).first()
        return row and row["parent_id"]

    def children(self, id: str) -> DataFrame:
        return self.df.filter(F.col("parent_id") == id)

    def childCount(self, id: str) -> int:
        return self.children(id).count()

    def hasChild(self, id: str, child: str) -> bool:
        return self.parent(child) == id

    def depth(self, id: str) -> int:
        return self.ancestors(id).count()

    def contains(self, id: str, other: str) -> bool:
        """Whether other lies below id."""
        return not self.ancestors(other).filter(F.col("id") == id).isEmpty()

    def getDescendantById(self, id: str, other: str):
        row = self.walk(id).filter((F.col("id") == other) & (F.col("depth") > 0)).first()
        return row and row["value"]

    def addChild(self, parent: str, value, id: str | None = None) -> Tree:
        last = self.children(parent).agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
        row = self.df.sparkSession.createDataFrame([(id or str(uuid.uuid4()), parent, last + 1, value)], self.df.schema)
        return Tree(self.df.union(row))

    createChild = addChild

    def move(self, id: str, parent: str) -> Tree:
        """id with its subtree becomes the last child of parent, which may not lie in it."""
        if id == parent or self.contains(id, parent):
            raise ValueError("a node can't lie below itself")
        last = self.children(parent).agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
        own = F.col("id") == id
        return Tree(self.df.withColumn("parent_id", F.when(own, F.lit(parent)).otherwise(F.col("parent_id"))).withColumn("pos", F.when(own, F.lit(last + 1)).otherwise(F.col("pos"))))

    def detach(self, id: str) -> Tree:
        """Without the whole subtree."""
        return Tree(self.df.join(self.walk(id).select("id"), "id", "left_anti").select(self.df.columns))

    removeChild = detach

    def remove(self, id: str) -> Tree:
        """Without the node; its children go to its parent."""
        parent = self.parent(id)
        if parent is None:
            if self.childCount(id) > 1:
                raise ValueError("a root with several children can't be removed")
            return Tree(self.df.filter(F.col("id") != id).withColumn("parent_id", F.when(F.col("parent_id") != id, F.col("parent_id"))))
        last = self.children(parent).agg(F.max("pos")).first()[0]
        own = F.col("parent_id") == id
        df = self.df.filter(F.col("id") != id).withColumn("pos", F.when(own, F.col("pos") + last + 1).otherwise(F.col("pos")).cast("int"))
        return Tree(df.withColumn("parent_id", F.when(own, F.lit(parent)).otherwise(F.col("parent_id"))))

    def setValue(self, id: str, value) -> Tree:
        return Tree(self.df.withColumn("value", F.when(F.col("id") == id, F.lit(value)).otherwise(F.col("value"))))

    def clone(self, id: str | None = None) -> Tree:
        """The subtree at id as a tree of its own."""
        if id is None:
            return self
        df = self.df.join(self.walk(id).select("id"), "id", "left_semi").select(self.df.columns)
        return Tree(df.withColumn("parent_id", F.when(F.col("id") != id, F.col("parent_id"))))

    def equals(self, other: Tree) -> bool:
        """Same shape and values."""
        a, b = self.walk().select("path", "value"), other.walk().select("path", "value")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def serialize(self) -> str:
        rows = self.walk().orderBy("depth", "path").collect()
        return json.dumps([{"id": r["id"], "parentId": r["parent_id"], "value": r["value"]} for r in rows])
