"""A trie as a table (seq long, key string, value): a prefix search is a filter that reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trie:
    df: DataFrame

    @classmethod
    def fromArray(cls, spark: SparkSession, pairs: list[tuple]) -> Trie:
        """Pairs of key and value in order; a later value replaces an earlier one."""
        rows = [(k, *p) for k, p in enumerate(pairs)]
        return cls(spark.createDataFrame(rows, ["seq", "key", "value"])).unique() if rows else cls(spark.createDataFrame([], "seq long, key string, value long"))

    @classmethod
    def fromMap(cls, spark: SparkSession, pairs: dict) -> Trie:
        return cls.fromArray(spark, list(pairs.items()))

    def unique(self) -> Trie:
        return Trie(self.df.groupBy("key").agg(F.min("seq").alias("seq"), F.max_by("value", "seq").alias("value")).select("seq", "key", "value"))

    def add(self, key: str, value) -> Trie:
        last = self.df.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        row = self.df.sparkSession.createDataFrame([(last + 1, key, value)], self.df.schema)
        return Trie(self.df.union(row)).unique()

    def remove(self, key: str) -> Trie:
        return Trie(self.df.filter(F.col("key") != key))

    def has(self, key: str) -> bool:
        return not self.df.filter(F.col("key") == key).isEmpty()

    def hasPartial(self, prefix: str) -> bool:
        return not self.startingWith(prefix).isEmpty()

    def get(self, key: str):
        row = self.df.filter(F.col("key") == key).first()
        return None if row is None else row["value"]

    def keyHasValue(self, key: str, value) -> bool:
        return not self.df.filter((F.col("key") == key) & (F.col("value") == value)).isEmpty()

    def startingWith(self, prefix: str) -> DataFrame:
        return self.df.filter(F.col("key").startswith(prefix))

    def descendantsOf(self, prefix: str) -> DataFrame:
        """Keys strictly below the prefix."""
        return self.startingWith(prefix).filter(F.col("key") != prefix)

    def _prefixes(self) -> DataFrame:
        return self.df.filter("key <> ''").select("seq", "key", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("depth", "prefix"))

    def entries(self) -> DataFrame:
        """seq, key, value, place: depth first, branches in the order of their first insertion."""
        firsts = self._prefixes().groupBy("prefix").agg(F.min("seq").alias("first"))
        place = self._prefixes().join(firsts, "prefix").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "first"))), lambda x: x["first"]).alias("place"))
        return self.df.join(place, "key", "left").select("seq", "key", "value", F.coalesce("place", F.array()).alias("place"))

    def toArray(self) -> list[tuple]:
        return [(r["key"], r["value"]) for r in self.entries().orderBy("place").collect()]

    def keys(self) -> list:
        return [k for k, _ in self.toArray()]

    def values(self) -> list:
        return [v for _, v in self.toArray()]

    def toMap(self) -> dict:
        return dict(self.toArray())

    @property
    def words(self) -> int:
        return self.df.count()

    @property
    def nodes(self) -> int:
        """Distinct prefixes and the root."""
        return self._prefixes().select("prefix").distinct().count() + 1
