"""Tables of a property graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VertexTable:
    """df: id string, seq long, labels array<string>, and properties.  label: the one label of all rows, if there is one.
    prefix, key: ids are prefix + key, so that a filter on an id becomes one on the key column."""

    df: DataFrame
    label: str | None = None
    prefix: str | None = None
    key: str | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "seq", "labels") and not c.startswith("_")]


@dataclass(frozen=True)
class EdgeTable:
    """df: id string, seq long, src string, dst string, labels array<string>, and properties.  ends: the labels of
    source and target, where they are known."""

    df: DataFrame
    label: str | None = None
    ends: tuple[str | None, str | None] = (None, None)

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "seq", "src", "dst", "labels") and not c.startswith("_")]


def vertex_table(df: DataFrame, label: str, key: str, props: list[str], prefix: str | None = None) -> VertexTable:
    """A table of one label over a native key; the id is made from it only where a query asks for it."""
    prefix = prefix or f"{label.lower()}:"
    cols = [F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(key).cast("long").alias("seq"), F.array(F.lit(label)).alias("labels"), F.col(key).alias("_key")]
    return VertexTable(df.select(*cols, *props), label, prefix, "_key")


def edge_table(df: DataFrame, label: str, src: tuple[str, str], dst: tuple[str, str], seq: str, props: list[str] = ()) -> EdgeTable:
    """src, dst: (vertex label, key column); seq: SQL for the order of insertion."""
    end = lambda e: F.concat(F.lit(f"{e[0].lower()}:"), F.col(e[1]).cast("string"))
    cols = [F.concat(F.lit(f"{label.lower()}:"), F.expr(seq).cast("string")).alias("id"), F.expr(seq).cast("long").alias("seq"), end(src).alias("src"), end(dst).alias("dst"), F.array(F.lit(label)).alias("labels")]
    return EdgeTable(df.select(*cols, *props), label, (src[0], dst[0]))
