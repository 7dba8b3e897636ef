"""Ordered sequences as DataFrames (pos long, v); every function returns another one, lazily."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


class Seq:
    """Positions ascend, but need not be dense."""

    def __init__(self, df: DataFrame):
        self.df = df.select("pos", "v")

    @classmethod
    def of(cls, spark: SparkSession, *values) -> Seq:
        return cls.from_(spark, values)

    @classmethod
    def from_(cls, spark: SparkSession, values) -> Seq:
        rows = list(enumerate(values))
        return cls(spark.createDataFrame(rows, ["pos", "v"])) if rows else cls.empty(spark)

    @classmethod
    def empty(cls, spark: SparkSession) -> Seq:
        return cls(spark.createDataFrame([], "pos long, v string"))

    @classmethod
    def range(cls, spark: SparkSession, a: int, b: int | None = None) -> Seq:
        """From a to b, both included, up or down; one argument: from 0 to a."""
        a, b = (0, a) if b is None else (a, b)
        step = 1 if b >= a else -1
        return cls(spark.range(abs(b - a) + 1).select(F.col("id").alias("pos"), (F.lit(a) + F.lit(step) * F.col("id")).alias("v")))

    def _first(self, p: Test) -> DataFrame:
        """One row: `m`, the first position whose value passes, or null."""
        return self.df.filter(p(F.col("v"))).agg(F.min("pos").alias("m"))

    def _cut(self, p: Test, test: Callable[[Column], Column]) -> Seq:
        return Seq(self.df.join(F.broadcast(self._first(p)), test(F.col("m"))))  # one row is broadcast

    def after(self, p: Test) -> Seq:
        return self._cut(p, lambda m: F.col("pos") > m)

    def before(self, p: Test) -> Seq:
        return self._cut(p, lambda m: m.isNull() | (F.col("pos") < m))

    def skipWhile(self, p: Test) -> Seq:
        return self._cut(lambda v: ~p(v), lambda m: F.col("pos") >= m)

    def takeWhile(self, p: Test) -> Seq:
        return self._cut(lambda v: ~p(v), lambda m: m.isNull() | (F.col("pos") < m))

    def filter(self, p: Test) -> Seq:
        return Seq(self.df.filter(p(F.col("v"))))

    select = filter

    def reject(self, p: Test) -> Seq:
        return Seq(self.df.filter(~p(F.col("v"))))

    def map(self, fn: Callable[[Column, Column], Column]) -> Seq:
        """fn(value, position)."""
        return Seq(self.df.select("pos", fn(F.col("v"), F.col("pos")).alias("v")))

    def sideEffect(self, name: str) -> Seq:
        """Counts what passes, as the named observation's `n`."""
        return Seq(self.df.observe(name, F.count(F.lit(1)).alias("n")))

    def distinct(self) -> Seq:
        return Seq(self.df.groupBy("v").agg(F.min("pos").alias("pos")))

    def sort(self, key: Test = lambda v: v) -> Seq:
        """Sorted by key, ties by position; a range-partitioned sort."""
        df = self.df.orderBy(key(F.col("v")), "pos").select(F.monotonically_increasing_id().alias("pos"), "v")
        return Seq(df)

    def take(self, n: int) -> Seq:
        return Seq(self.df.orderBy("pos").limit(max(0, n)))

    def skip(self, n: int) -> Seq:
        return Seq(self.df.orderBy("pos").offset(max(0, n)))

    def slice(self, start: int, end: int) -> Seq:
        return Seq(self.df.orderBy("pos").offset(start).limit(max(0, end - start)))

    def tail(self) -> Seq:
        return self.skip(1)

    def pipe(self, *fns: Callable[[Seq], Seq]) -> Seq:
        out = self
        for fn in fns:
            out = fn(out)
        return out

    # Values

    def _one(self, agg: Column):
        return self.df.agg(agg.alias("x")).first()["x"]

    def count(self) -> int:
        return self.df.count()

    def every(self, p: Test) -> bool:
        return self._one(F.coalesce(F.bool_and(p(F.col("v"))), F.lit(True)))

    def some(self, p: Test) -> bool:
        return self._one(F.coalesce(F.bool_or(p(F.col("v"))), F.lit(False)))

    def head(self):
        return self._one(F.min_by("v", "pos"))

    def last(self):
        return self._one(F.max_by("v", "pos"))

    def equals(self, other: Seq) -> bool:
        """Equal values in order; positions are counted anew by rank only if they differ in density."""
        n = F.row_number().over(Window.orderBy("pos"))
        a, b = (s.df.select(n.alias("n"), F.struct("v").alias(c)) for s, c in ((self, "a"), (other, "b")))
        return a.join(b, "n", "full").filter("not a <=> b").isEmpty()

    def toArray(self) -> list:
        return [r["v"] for r in self.df.orderBy("pos").collect()]

    def __iter__(self):
        return (r["v"] for r in self.df.orderBy("pos").toLocalIterator())

    def __str__(self) -> str:
        return f"Seq({', '.join(map(str, self.df.orderBy('pos').limit(20).toPandas()['v']))})"


def pick(keys: list[str], column: str = "v") -> Column:
    """A struct of some of a struct's fields."""
    return F.struct(*(F.col(f"{column}.{k}").alias(k) for k in keys))


def arrays_are_equal(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
