"""What several operators share: lineage cuts, worker-side caches, word hashes, components."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker handles at once, so that long texts don't add up.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, longer where a column of the frames begins with it (Spark's names ignore case)."""
    while any(c.lower().startswith(name.lower()) for df in frames for c in df.columns):
        name += "_"
    return name


@functools.cache
def _own_folder() -> str:
    """A folder of this process, for local masters only; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="quiverflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.  Without it only a local master, where all share a disk, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there from now on."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that nothing refers to any more, and with spark.cleaner.referenceTracking.cleanCheckpoints
    those of checkpoints too; it does so only once the driver's garbage is collected, which a loop of small jobs may never bring about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def worker_state() -> dict:
    """A dict that lives as long as the Python worker; tasks come and go."""
    return sys.__dict__.setdefault("_quiverflow_worker", {})


class WordTable(dict):
    """word -> fn(word), remembered; forgets everything once it holds `most` words, and never remembers words of more than `LONG`
    letters, so that its size is bounded in bytes."""

    LONG = 64

    def __init__(self, fn, most: int = 100_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, word):
        value = self.fn(word)
        if len(word) <= self.LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def word_hash(word: str) -> int:
    """63 bits, equal on every machine."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def slices(batches, rows: int = SLICE):
    """Arrow batches in pieces of a few rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node reaches over the links a-b.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until nothing
    changes: O(log n) rounds, each a grouped minimum and an equi-join.  A hub's
    minimum is combined before the shuffle, and its rows in the join are split
    by the adaptive planner.  Every round is written to the shared folder.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        tidy(edges.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
