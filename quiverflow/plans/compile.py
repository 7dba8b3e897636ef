"""From steps to a DataFrame.

A traverser is a row: `cur` (an element's id, or a value), for edges `src` and `dst` too, `ord` where order or
identity matters, `tag_<k>` for as(k), `p<i>` for the places of a path where one is asked for.  Hops are equi-joins,
filtering sub-traversals semi- and anti-joins on `ord`, aggregates reset everything.  Properties are joined where a step asks for
them, with those columns only, from the tables whose labels are possible there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType, VariantType

from ..functions.predicates import Predicate
from .traversal import FailStep, Step, Traversal

#: Steps for which rows need an identity and an order.
ORDERED = {"range", "tail", "dedup", "fold", "order", "and_", "or_", "not_", "where", "choose", "coalesce", "optional"}


#: Columns of an element that was read with its properties: `_own_labels` and `_own:<key>`.  The optimizer drops those that no step asks for.
OWN = "_own"


@dataclass(frozen=True)
class State:
    """kind: none, vertex, edge, value, record (a struct of tags), path.  labels: possible labels of a vertex, or None."""

    df: DataFrame | None = None
    kind: str = "none"
    labels: frozenset | None = None
    ord: bool = False
    track: bool = False
    path: tuple[tuple[str, str], ...] = ()
    tags: dict = field(default_factory=dict)
    keys: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    last: str = ""
    #: The rows that a sub-traversal began with, by their keys, so that an aggregate of nothing has a row too.
    outer: DataFrame | None = None

    def carry(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("cur", "src", "dst") and not c.startswith(OWN)]

    def to(self, df: DataFrame, kind: str, labels=None, grow: bool = True, fields=()) -> State:
        s = replace(self, df=df, kind=kind, labels=labels, fields=tuple(fields))
        if self.track and grow and kind in ("vertex", "edge", "value"):
            name = f"p{len(self.path)}"
            s = replace(s, df=df.withColumn(name, F.col("cur")), path=(*self.path, (name, kind)))
        return s


def plain(x):
    """Python value of a result."""
    if hasattr(x, "toPython"):
        return plain(x.toPython())
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items() if v is not None}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x


def _needs(steps: tuple[Step, ...], names: set[str]) -> bool:
    return any(s.name in names or any(isinstance(a, Traversal) and _needs(a.steps, names) for a in s.args) for s in steps)


def run(t: Traversal, ordered: bool) -> DataFrame:
    if t.graph is None:
        raise ValueError("this traversal belongs to no graph")
    s = State(ord=ordered or _needs(t.steps, ORDERED), track=_needs(t.steps, {"path"}))
    s = Compiler(t.graph, t.compat).steps(t.steps, s)
    if s.df is None:
        raise ValueError("a traversal begins with V, E or inject")
    df = s.df.orderBy("ord") if ordered and "ord" in s.df.columns else s.df
    return df.select(F.col("cur").alias("value"))



def _same(cols: list[tuple[Column, object]]) -> list[Column]:
    """Columns of one type: as they are, as doubles if they are numbers, or as variants."""
    kinds = {str(t) for _, t in cols}
    if len(kinds) <= 1:
        return [c for c, _ in cols]
    if all(isinstance(t, NumericType) for _, t in cols):
        return [c.cast("double") for c, _ in cols]
    return [c if isinstance(t, VariantType) else c.cast(VariantType()) for c, t in cols]


def flat(labels: tuple) -> tuple:
    return tuple(x for label in labels for x in (label if isinstance(label, (list, tuple)) else [label]))


def part(kind: str, c: str = "cur") -> Column:
    """The values of a kind (double, string or boolean) in a variant column, null for others."""
    names = {"double": "'BIGINT', 'DOUBLE', 'FLOAT', 'INT', 'SMALLINT', 'TINYINT'", "string": "'STRING'", "boolean": "'BOOLEAN'"}[kind]
    more = f" or schema_of_variant({c}) like 'DECIMAL%'" if kind == "double" else ""
    return F.expr(f"case when schema_of_variant({c}) in ({names}){more} then try_variant_get({c}, '$', '{kind}') end")


def kind_of(x) -> str:
    return "boolean" if isinstance(x, bool) else "double" if isinstance(x, (int, float)) else "string"


class Compiler:
    def __init__(self, graph, compat: bool):
        self.graph, self.compat = graph, compat

    def steps(self, steps: tuple[Step, ...], s: State) -> State:
        k = 0
        while k < len(steps):
            step, after = steps[k], []
            while k + 1 < len(steps) and steps[k + 1].name == "by" and step.name != "by":
                after.append(steps[k + 1].args)
                k += 1
            method = getattr(self, "_" + step.name)
            if step.name == "V" and not step.args and s.df is None:  # labels asked for at once: only their tables are read
                follow = steps[k + 1] if k + 1 < len(steps) else None
                wanted = flat(follow.args) if follow and follow.name == "hasLabel" else (follow.args[0],) if follow and follow.name == "has" and len(follow.args) == 3 else None
                if wanted and all(isinstance(x, str) for x in wanted):
                    s = self._V(s, labels=frozenset(wanted))
                    k += 1 + (follow.name == "hasLabel" and not after and not (k + 2 < len(steps) and steps[k + 2].name == "by"))
                    continue
            if step.name == "order" and not s.keys and k + 1 < len(steps) and steps[k + 1].name == "range" and steps[k + 1].args[1] > 0:
                s = method(s, by=after, top=steps[k + 1].args[1])
            elif step.name in ("path", "select", "order"):
                s = method(s, *(step.args if step.name == "select" else ()), by=after)
            else:
                s = method(s, *step.args)
                for args in after:
                    s = self._by(s, *args)
            k += 1
        return s

    # Tables

    def vertices(self, labels=None, ids: list[str] | None = None, prop: str | None = None, cols: list[str] = ()) -> DataFrame | None:
        """id, seq, labels, tbl and cols of the vertices that can have a label, an id or a property; a filter on
        ids goes to the native key where the table has one."""
        parts = []
        for k, t in enumerate(self.graph.vertex_tables):
            if labels is not None and t.label is not None and t.label not in labels or prop is not None and prop not in t.props:
                continue
            df = t.df
            if ids is not None and t.key:
                own = [i[len(t.prefix) :] for i in ids if isinstance(i, str) and i.startswith(t.prefix)]
                if not own:
                    continue
                kind = df.schema[t.key].dataType
                df = df.filter(F.col(t.key).isin([int(x) for x in own if x.lstrip("-").isdigit()] if isinstance(kind, NumericType) else own))
            elif ids is not None:
                df = df.filter(F.col("id").isin(list(ids)))
            if labels is not None and t.label is None:
                df = df.filter(F.arrays_overlap("labels", F.array(*map(F.lit, sorted(labels)))) if labels else F.lit(False))
            if ids is not None and t.key:  # an id that the key can't be made from
                df = df.filter(F.col("id").isin([i for i in ids if isinstance(i, str)]))
            parts.append(df.select("id", F.lit(k).cast("long").alias("tbl"), "seq", "labels", *(c for c in cols if c in t.props)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def edges(self, labels: tuple[str, ...] | None = None, cols: list[str] = (), prop: str | None = None) -> DataFrame | None:
        """id, tbl, seq, src, dst, label, cols; an edge with several labels is a row for each."""
        parts = []
        for k, t in enumerate(self.graph.edge_tables):
            if labels and t.label is not None and t.label not in labels or prop is not None and prop not in t.props:
                continue
            label = F.lit(t.label) if t.label else F.explode("labels")
            df = t.df.select("id", F.lit(k).cast("long").alias("tbl"), "seq", "src", "dst", "labels", label.alias("label"), *(c for c in cols if c in t.props))
            parts.append(df.filter(F.col("label").isin(*labels)) if labels and t.label is None else df)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def ends(self, labels: tuple[str, ...], side: int) -> frozenset | None:
        """Possible labels of the vertices that these edges lead to."""
        out = set()
        for t in self.graph.edge_tables:
            if not labels or t.label is None or t.label in labels:
                if t.label is None or t.ends[side] is None:
                    return None
                out.add(t.ends[side])
        return frozenset(out)

    # Sources

    def _start(self, s: State, df: DataFrame, kind: str, labels=None) -> State:
        if s.df is not None:  # rows are added to the stream
            new = replace(s, df=None)
            more = self._start(replace(new, path=()), df, kind, labels)
            return self._concat([s, more], None)
        fixed = {"id", "tbl", "seq", "labels", "src", "dst", "label"}
        own = [F.col("labels").alias(f"{OWN}_labels"), *(F.col(c).alias(f"{OWN}:{c}") for c in df.columns if c not in fixed)] if "labels" in df.columns else []
        cols = [F.col("id").alias("cur"), *own] + (["src", "dst"] if kind == "edge" else [])
        if s.ord:
            cols.append(F.array("tbl", "seq").alias("ord"))
        return s.to(df.select(*cols), kind, labels)

    def common(self, tables: list) -> list[str]:
        """Properties that have one type in all these tables, so that these can be read as one."""
        kinds: dict[str, set] = {}
        for t in tables:
            for k in t.props:
                kinds.setdefault(k, set()).add(t.df.schema[k].dataType.simpleString())
        return [k for k, v in kinds.items() if len(v) == 1]

    def _V(self, s: State, *x, labels: frozenset | None = None) -> State:
        ids = None if not x else [getattr(x[0], "id", x[0])]
        cols = self.common([t for t in self.graph.vertex_tables if labels is None or t.label is None or t.label in labels])
        df = self.vertices(labels, ids=ids, cols=cols)
        if df is None:
            return s if s.df is not None else self._start(s, self.vertices().filter(F.lit(False)), "vertex")
        return self._start(s, df, "vertex", labels)

    def _E(self, s: State, *x) -> State:
        if not self.graph.edge_tables:
            df = self.graph.spark.createDataFrame([], "id string, tbl long, seq long, src string, dst string, labels array<string>")
            return self._start(s, df, "edge")
        cols, parts = self.common(self.graph.edge_tables), []
        for k, t in enumerate(self.graph.edge_tables):
            df = t.df.select("id", F.lit(k).cast("long").alias("tbl"), "seq", "src", "dst", "labels", *(c for c in cols if c in t.props))
            parts.append(df.filter(F.col("id") == F.lit(getattr(x[0], "id", x[0]))) if x else df)
        return self._start(s, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "edge")

    def _inject(self, s: State, *values) -> State:
        spark = self.graph.spark
        kinds = {type(v) for v in values if v is not None}
        mixed = len(kinds) > 1
        if mixed and kinds <= {int, float}:
            values, mixed = [None if v is None else float(v) for v in values], False
        if mixed:
            df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k long, v string").select("k", F.parse_json("v").alias("cur"))
        elif not kinds:
            df = spark.createDataFrame([(k, None) for k in range(len(values))], "k long, cur double")
        else:
            kind = {int: "long", float: "double", str: "string", bool: "boolean"}.get(next(iter(kinds)))
            rows = [(k, v) for k, v in enumerate(values)]
            df = spark.createDataFrame(rows, f"k long, cur {kind}") if kind else spark.createDataFrame(rows, ["k", "cur"])
        cols = ["cur"] + ([F.array(F.lit(0).cast("long"), "k").alias("ord")] if s.ord else [])
        new = replace(s, df=None, path=(), tags={}).to(df.select(*cols), "value")
        return new if s.df is None else self._concat([new, s], "inject")

    def _concat(self, parts: list[State], _why) -> State:
        """One stream after the other; columns that one lacks are null there."""
        first = parts[0]
        kind = first.kind if len({p.kind for p in parts}) == 1 else "value"
        dfs = []
        if kind not in ("vertex", "edge") or not all(f"{OWN}_labels" in p.df.columns for p in parts):
            parts = [replace(p, df=p.df.drop(*(c for c in p.df.columns if c.startswith(OWN)))) for p in parts]
        types = [(F.col("cur"), p.df.schema["cur"].dataType) for p in parts]
        for k, (p, c) in enumerate(zip(parts, _same(types), strict=True)):
            df = p.df.withColumn("cur", c)
            if any("rid" in q.df.columns for q in parts) and "rid" not in df.columns:
                df = df.withColumn("rid", F.col("ord"))
            for c in ("ord", "rid"):
                if c in df.columns:
                    df = df.withColumn(c, F.concat(F.array(F.lit(k).cast("long")), F.col(c)))
            dfs.append(df)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
        labels = None if any(p.labels is None for p in parts) else frozenset().union(*(p.labels for p in parts))
        longest = max(parts, key=lambda p: len(p.path))
        tags = reduce(lambda a, p: {**a, **p.tags}, parts, {})
        return replace(first, df=df, kind=kind, labels=labels, path=longest.path, tags=tags, fields=first.fields)

    # Hops

    def _hop(self, s: State, labels: tuple[str, ...], dirs: tuple[int, ...], edge: bool) -> State:
        if s.kind != "vertex":
            return self._none(s)
        props = self.common([t for t in self.graph.edge_tables if not labels or t.label is None or t.label in labels]) if edge else []
        e = self.edges(labels or None, props)
        if e is None:
            return self._none(s).to(self._none(s).df, "vertex", grow=True) if not edge else self._none(s)
        sides = []
        for d in dirs:
            near, far = ("src", "dst") if d == 0 else ("dst", "src")
            cols = [F.col(near).alias("_near"), F.col(far).alias("_far"), F.lit(d).cast("long").alias("_d"), F.col("label").alias("_l"), F.col("tbl").alias("_t"), F.col("seq").alias("_s")]
            sides.append(e.select(*cols, *([F.col("id").alias("_e"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("labels").alias(f"{OWN}_labels"), *(F.col(c).alias(f"{OWN}:{c}") for c in props)] if edge else [])))
        e = reduce(lambda a, b: a.unionByName(b), sides)
        if labels and len(set(labels)) < len(labels):  # a label that is given again gives its edges again
            e = reduce(lambda a, b: a.unionByName(b), [e.filter(F.col("_l") == l).withColumn("_rank", F.lit(k).cast("long")) for k, l in enumerate(labels)])
        elif labels and s.ord:
            e = e.withColumn("_rank", reduce(lambda a, kl: a.when(F.col("_l") == kl[1], F.lit(kl[0]).cast("long")), list(enumerate(labels))[1:], F.when(F.col("_l") == labels[0], F.lit(0).cast("long"))))
        carry = s.carry()
        if s.ord:
            if labels:
                rank = [F.col("_rank")]
            else:  # labels in the order in which a vertex first had them, outgoing ones first
                w = Window.partitionBy("_near", "_l")
                e = e.withColumn("_d0", F.min("_d").over(w)).withColumn("_s0", F.min(F.when(F.col("_d") == F.col("_d0"), F.struct("_t", "_s"))).over(Window.partitionBy("_near", "_l")))
                rank = [F.col("_d0"), F.col("_s0._t"), F.col("_s0._s")]
            e = e.withColumn("_o", F.array(*rank, "_d", "_t", "_s"))
        own = [f"{OWN}_labels", *(f"{OWN}:{c}" for c in props)] if edge else []
        keep = ["_near", "_far"] + (["_o"] if s.ord else []) + (["_e", "_src", "_dst", *own] if edge else [])
        df = s.df.select("cur", *carry).join(e.select(*keep), F.col("cur") == F.col("_near"))
        cols = [F.concat(c, "_o").alias(c) if c in ("ord", "rid") else F.col(c) for c in carry]
        if edge:
            df = df.select(F.col("_e").alias("cur"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.col("_near").alias("_prev"), *own, *(c for c, n in zip(cols, carry, strict=True) if n != "_prev"))
            return s.to(df, "edge", frozenset(labels) or None)
        df = df.select(F.col("_far").alias("cur"), *(c for c, n in zip(cols, carry, strict=True) if n != "_prev"))
        far = [self.ends(labels, 1 - d) for d in dirs]
        return s.to(df, "vertex", None if any(f is None for f in far) else frozenset().union(*far))

    def _out(self, s, *labels):
        return self._hop(s, labels, (0,), False)

    def _in_(self, s, *labels):
        return self._hop(s, labels, (1,), False)

    def _both(self, s, *labels):
        return self._hop(s, labels, (0, 1), False)

    def _outE(self, s, *labels):
        return self._hop(s, labels, (0,), True)

    def _inE(self, s, *labels):
        return self._hop(s, labels, (1,), True)

    def _bothE(self, s, *labels):
        return self._hop(s, labels, (0, 1), True)

    def _end(self, s: State, cur: Column) -> State:
        if s.kind != "edge":
            return self._none(s)
        return s.to(s.df.select(cur.alias("cur"), *(c for c in s.carry() if c != "_prev")).filter("cur is not null"), "vertex")

    def _outV(self, s):
        return self._end(s, F.col("src"))

    def _inV(self, s):
        return self._end(s, F.col("dst"))

    def _bothV(self, s):
        if s.kind != "edge":
            return self._none(s)
        df = s.df.select(F.posexplode(F.array("src", "dst")).alias("_k", "_v"), *s.carry())
        cols = [F.concat(c, F.array(F.col("_k").cast("long"))).alias(c) if c in ("ord", "rid") else F.col(c) for c in s.carry() if c != "_prev"]
        return s.to(df.select(F.col("_v").alias("cur"), *cols), "vertex")

    def _otherV(self, s):
        if s.kind != "edge" or "_prev" not in s.df.columns:
            return self._none(s)
        return self._end(s, F.when(F.col("dst") == F.col("_prev"), F.col("src")).when(F.col("src") == F.col("_prev"), F.col("dst")))

    # Properties

    def table(self, kind: str, labels, keys: list[str], prop: str | None = None) -> DataFrame | None:
        if kind == "vertex":
            df = self.vertices(labels, prop=prop, cols=keys)
        else:
            parts = [t.df.select("id", "labels", *(k for k in keys if k in t.props)) for t in self.graph.edge_tables if (prop is None or prop in t.props) and (labels is None or t.label is None or t.label in labels)]
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
        return None if df is None else df.select(F.col("id").alias("_id"), F.col("labels").alias("_labels"), *(F.col(k).alias(f"_v_{k}") for k in keys if k in df.columns))

    def keys(self, kind: str, labels) -> list[str]:
        tables = self.graph.vertex_tables if kind == "vertex" else self.graph.edge_tables
        return list(dict.fromkeys(k for t in tables if labels is None or t.label is None or t.label in labels for k in t.props))

    def with_props(self, s: State, keys: list[str], at: str = "cur", kind: str | None = None, labels="own", one: bool = False) -> DataFrame | None:
        """s.df with `_labels` and `_v_<key>` of the element in column `at`.  one: only rows that can have the key."""
        kind = kind or s.kind
        if at == "cur" and f"{OWN}_labels" in s.df.columns:
            known = {k for t in (self.graph.vertex_tables if kind == "vertex" else self.graph.edge_tables) if s.labels is None or t.label is None or t.label in s.labels for k in t.props}
            have = [k for k in keys if f"{OWN}:{k}" in s.df.columns]
            if all(k in have or k not in known for k in keys):
                if one and not have:
                    return None
                return s.df.select("*", F.col(f"{OWN}_labels").alias("_labels"), *(F.col(f"{OWN}:{k}").alias(f"_v_{k}") for k in have))
        t = self.table(kind, s.labels if labels == "own" else labels, keys, keys[0] if one else None)
        if t is None:
            return None
        if kind == "edge":  # ids of edges need not be unique, so a join could repeat rows
            t = t.dropDuplicates(["_id"])
        return s.df.join(t, F.col(at) == F.col("_id")).drop("_id")

    def _filter_props(self, s: State, keys: list[str], test, one: bool = False) -> State:
        if s.kind not in ("vertex", "edge"):
            return self._none(s)
        df = self.with_props(s, keys, one=one)
        if df is None:
            return self._none(s)
        value = lambda k: F.col(f"_v_{k}") if f"_v_{k}" in df.columns else F.lit(None)
        return replace(s, df=df.filter(test(value)).select(s.df.columns))

    def _has(self, s, *args):
        if len(args) == 1:
            return self._filter_props(s, [args[0]], lambda v: v(args[0]).isNotNull(), one=True)
        label, (key, x) = (None, args) if len(args) == 2 else (args[0], args[1:])
        if key is None:
            return self._none(s)
        if label is not None:
            s = self._hasLabel(s, label)
        p = x if isinstance(x, Predicate) else None
        strict = lambda v: F.lit(x) == v if x is not None else F.lit(False)
        present = len(args) == 2  # with a label there is no test for the key
        test = lambda v: (v(key).isNotNull() if present else F.lit(True)) & (p.to_column(v(key)) if p else x(v(key)) if callable(x) else strict(v(key)))
        return self._filter_props(s, [key], test, one=present or p is None or not p.missing)

    def _hasId(self, s, *ids):
        ids = [getattr(i, "id", i) for i in ids]
        if s.kind not in ("vertex", "edge"):
            return self._none(s)
        return replace(s, df=s.df.filter(F.col("cur").isin(ids) if ids else F.lit(False)))

    def _hasKey(self, s, *keys):
        return self._filter_props(s, list(keys), lambda v: reduce(lambda a, k: a | v(k).isNotNull(), keys, F.lit(False)))

    def _hasNot(self, s, key):
        return self._filter_props(s, [key], lambda v: v(key).isNull())

    def _hasLabel(self, s, *labels):
        if s.kind not in ("vertex", "edge"):
            return self._none(s)
        labels = flat(labels)
        known = frozenset(labels) if s.labels is None else s.labels & frozenset(labels) or frozenset(labels)
        hit = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, labels))) if labels else F.lit(False)
        if f"{OWN}_labels" in s.df.columns:
            return replace(s, df=s.df.filter(hit(f"{OWN}_labels")), labels=known)
        t = self.table(s.kind, frozenset(labels), [])
        if t is None:
            return self._none(s)
        return replace(s, df=s.df.join(t.filter(hit("_labels")).select("_id"), F.col("cur") == F.col("_id"), "left_semi"), labels=known)

    def _hasValue(self, s, *values):
        if s.kind != "record":
            return self._none(s)
        names = [f for f, _ in s.fields]
        ok = lambda f: reduce(lambda a, v: a | F.col(f"cur.{f}").cast("string").eqNullSafe(F.lit(v).cast("string")), values, F.lit(False))
        df = s.df.withColumn("cur", F.struct(*(F.when(ok(f), F.col(f"cur.{f}")).alias(f) for f in names)))
        return replace(s, df=df)

    def _is(self, s, x):
        c, plain_ = F.col("cur"), isinstance(x, (str, int, float))
        if isinstance(s.df.schema["cur"].dataType, VariantType):
            sample = next((a for a in x.args if a is not None), "") if isinstance(x, Predicate) else x
            c = part(kind_of(sample))
        if isinstance(x, Predicate):
            return replace(s, df=s.df.filter(x.to_column(c)))
        return replace(s, df=s.df.filter(F.coalesce(c == F.lit(x), F.lit(False)) if plain_ and not isinstance(x, bool) else F.lit(False)))

    def called(self, s: State, fn, returns: str) -> Column:
        """fn of a Column, or else of Python values, in Arrow batches; without a type for its results these are variants."""
        try:
            c = fn(F.col("cur"))
        except Exception as e:  # a Column can't be used as a value; an error of fn itself comes up again where it runs
            c = e
        if isinstance(c, Column):
            return c
        if returns != "variant":
            return F.udf(lambda v: fn(plain(v)), returns, useArrow=not isinstance(s.df.schema["cur"].dataType, VariantType))("cur")
        text = F.udf(lambda v: json.dumps(fn(plain(v))), "string", useArrow=not isinstance(s.df.schema["cur"].dataType, VariantType))("cur")
        return F.parse_json(text)

    def _filter(self, s, fn):
        if isinstance(fn, Predicate):
            return replace(s, df=s.df.filter(fn.to_column(F.col("cur"))))
        return replace(s, df=s.df.filter(self.called(s, lambda v: fn(v) if isinstance(v, Column) else bool(fn(v)), "boolean")))

    def _none(self, s):
        return replace(s, df=s.df.filter(F.lit(False)))

    def _fail(self, s, *message):
        raise FailStep(*message)

    def _dedup(self, s, *_):
        key = F.col("cur")
        if isinstance(s.df.schema["cur"].dataType, VariantType):
            key = F.concat_ws("|", F.schema_of_variant("cur"), F.to_json(F.struct("cur")))
        w = Window.partitionBy(*s.keys, "_key").orderBy("ord")
        df = s.df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")
        return replace(s, df=df)

    # Sub-traversals

    def row(self, s: State) -> str:
        """The column that names a row; after a sort `ord` is only a place."""
        return "rid" if "rid" in s.df.columns else "ord"

    def sub(self, t, s: State) -> State:
        """t over s's rows; `_k<depth>` names the row that each result comes from."""
        name = f"_k{len(s.keys)}"
        outer = s.df.select(*s.keys, F.col(self.row(s)).alias(name))
        inner = replace(s, df=s.df.withColumn(name, F.col(self.row(s))), keys=(*s.keys, name), outer=outer)
        if callable(t) and not isinstance(t, Traversal):
            t = t(Traversal())
        return self.steps(t.steps, inner)

    def matching(self, t, s: State, how: str) -> State:
        done = self.sub(t, s)
        ids = done.df.select(F.col(done.keys[-1]).alias("_m")).distinct()
        return replace(s, df=s.df.join(ids, F.col(self.row(s)) == F.col("_m"), how))

    def _and_(self, s, *subs):
        return reduce(lambda a, t: self.matching(t, a, "left_semi"), subs, s)

    def _where(self, s, sub):
        return self.matching(sub, s, "left_semi")

    def _not_(self, s, sub):
        return self.matching(sub, s, "left_anti")

    def _or_(self, s, *subs):
        ids = []
        for t in subs:
            done = self.sub(t, s)
            ids.append(done.df.select(F.col(done.keys[-1]).alias("_m")))
        any_ = reduce(lambda a, b: a.union(b), ids).distinct()
        return replace(s, df=s.df.join(any_, F.col(self.row(s)) == F.col("_m"), "left_semi"))

    def apart(self, s: State) -> State:
        return replace(s, df=s.df.drop(*[c for c in s.df.columns if c.startswith("_k") and c not in s.keys]))

    def branch(self, s: State, parts: list[State]) -> State:
        """Results of several branches in the order of the rows that they come from."""
        out = self._concat([self.apart(replace(p, keys=s.keys)) for p in parts], None)
        df = out.df
        for c in ("ord", "rid"):
            if c in df.columns:
                df = df.withColumn(c, F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1)))
        return replace(out, df=df, keys=s.keys)

    def _choose(self, s, cond, a, b=None):
        yes, no = self.matching(cond, s, "left_semi"), self.matching(cond, s, "left_anti")
        return self.branch(s, [self.sub(a, yes), self.sub(b, no) if b is not None else no])

    def _optional(self, s, sub):
        return self.branch(s, [self.sub(sub, s), self.matching(sub, s, "left_anti")])

    def _coalesce(self, s, *subs):
        if self.compat:  # one branch for the whole stream
            for t in subs:
                done = self.sub(t, s)
                if not done.df.isEmpty():
                    return self.apart(replace(done, keys=s.keys))
            return self._none(s)
        parts, rest = [], s
        for t in subs:
            parts.append(self.sub(t, rest))
            rest = self.matching(t, rest, "left_anti")
        return self.branch(s, parts)

    def _union(self, s, *subs):
        """Each branch sees the whole stream; their results follow one another."""
        out = self._concat([self.steps((t(Traversal()) if not isinstance(t, Traversal) else t).steps, s) for t in subs], None)
        return replace(out, keys=s.keys, outer=s.outer)

    # Maps

    def _set(self, s: State, df: DataFrame, kind: str = "value", fields=()) -> State:
        return s.to(df.drop("src", "dst", "_prev"), kind, fields=fields)

    def _id(self, s):
        return self._set(s, s.df) if s.kind in ("vertex", "edge") else self._none(s)

    def exploded(self, s: State, df: DataFrame, arr: Column) -> DataFrame:
        """A row for each item of arr as cur, in their order."""
        carry = [c for c in s.carry() if c != "_prev"]
        df = df.select(F.posexplode(arr).alias("_i", "_v"), *carry)
        return df.select(F.col("_v").alias("cur"), *(F.concat(c, F.array(F.col("_i").cast("long"))).alias(c) if c in ("ord", "rid") else F.col(c) for c in carry))

    def _label(self, s):
        if s.kind in ("record",):
            return s.to(self.exploded(s, s.df, F.array_compact(F.array(*(F.when(F.col(f"cur.{f}").isNotNull(), F.lit(f)) for f, _ in s.fields)))), "value")
        if s.kind not in ("vertex", "edge"):
            return self._none(s)
        return s.to(self.exploded(s, self.with_props(s, []), F.col("_labels")), "value")

    def _values(self, s, *keys):
        if s.kind == "record":
            keys = keys or tuple(f for f, _ in s.fields)
            cols = _same([(F.col(f"cur.{k}"), s.df.schema["cur"].dataType[k].dataType) for k in keys if k in dict(s.fields)])
            return s.to(self.exploded(s, s.df, F.array_compact(F.array(*cols))), "value")
        if s.kind not in ("vertex", "edge"):
            return self._none(s)
        keys = list(keys) or self.keys(s.kind, s.labels)
        df = self.with_props(s, keys, one=len(keys) == 1)
        if df is None:
            return self._set(s, s.df.filter(F.lit(False)).withColumn("cur", F.lit(None).cast("string")))
        if len(keys) == 1:
            df = df.filter(F.col(f"_v_{keys[0]}").isNotNull()).withColumn("cur", F.col(f"_v_{keys[0]}")).select("cur", *(c for c in s.carry() if c != "_prev"))
            return s.to(df, "value")
        have = [k for k in keys if f"_v_{k}" in df.columns]
        cols = _same([(F.col(f"_v_{k}"), df.schema[f"_v_{k}"].dataType) for k in have])
        return s.to(self.exploded(s, df, F.array_compact(F.array(*cols))), "value")

    def _valueMap(self, s, *keys):
        if s.kind not in ("vertex", "edge"):
            return self._none(s)
        keys = [k for k in keys or self.keys(s.kind, s.labels)]
        df = self.with_props(s, keys)
        have = [k for k in keys if f"_v_{k}" in df.columns]
        df = df.withColumn("cur", F.struct(*(F.col(f"_v_{k}").alias(k) for k in have)) if have else F.create_map().cast("map<string,string>"))
        return self._set(s, df.select("cur", *s.carry()), "record", [(k, "value") for k in have])

    _properties = _valueMap

    def _map(self, s, fn, returns: str = "variant"):
        """fn of a Column, or of Python values; returns: the type of the latter's results."""
        return self._set(s, s.df.withColumn("cur", self.called(s, fn, returns)))

    def _identity(self, s):
        return s

    def _sideEffect(self, s, fn=None):
        if fn is None:
            return s

        def tap(batches):
            for b in batches:
                for v in b["cur"]:
                    fn(v)
                yield b

        df = s.df.drop(*(c for c in s.df.columns if c.startswith(OWN)))
        return replace(s, df=df.mapInPandas(tap, df.schema))

    def _as(self, s, *keys):
        df, tags = s.df, dict(s.tags)
        for k in keys:
            df, tags[k] = df.withColumn(f"tag_{k}", F.col("cur")), (s.kind, s.labels)
        out = replace(s, df=df, tags=tags)
        if self.compat and len(keys) != 1:  # a copy for each key
            return self._none(out) if not keys else reduce(lambda a, b: replace(a, df=a.df.unionByName(b.df)), [out] * len(keys))
        return out

    def prop_of(self, df: DataFrame, at: str, kind: str, labels, key: str, out: str) -> DataFrame:
        """df with column out: the property of the element in column at; rows without it go."""
        if at == "cur" and f"{OWN}:{key}" in df.columns:
            return df.withColumn(out, F.col(f"{OWN}:{key}")).filter(F.col(out).isNotNull())
        t = self.table(kind, labels, [key], key) if kind in ("vertex", "edge") else None
        if t is None:
            return df.withColumn(out, F.lit(None).cast("string")).filter(F.lit(False))
        t = t.select(F.col("_id").alias(f"{out}_id"), F.col(f"_v_{key}").alias(out)).filter(F.col(out).isNotNull())
        t = t.dropDuplicates([f"{out}_id"]) if kind == "edge" else t
        return df.join(t, F.col(at) == F.col(f"{out}_id")).drop(f"{out}_id")

    def _select(self, s, *keys, by=()):
        keys = list(keys) or list(s.tags)
        known = [k for k in keys if k in s.tags]
        if len(keys) == 1:
            if not known:
                return self._none(s)
            kind, labels = s.tags[keys[0]]
            df = s.df.drop(*(c for c in s.df.columns if c.startswith(OWN)))
            new = replace(s, df=df.withColumn("cur", F.col(f"tag_{keys[0]}")).filter("cur is not null"), kind=kind, labels=labels)
            for args in by:
                new = self._by(new, *args)
            return new
        df, fields = s.df, []
        key = by[0][0] if by and by[0] else None
        for k in known:
            if key is not None:
                df = self.prop_of(df, f"tag_{k}", *s.tags[k], key, f"_s_{k}")
                fields.append(F.col(f"_s_{k}").alias(k))
            else:
                fields.append(F.col(f"tag_{k}").alias(k))
        df = df.withColumn("cur", F.struct(*fields)).select("cur", *s.carry())
        return self._set(s, df, "record", [(k, "value" if key else s.tags[k][0]) for k in known])

    def _path(self, s, by=()):
        df, cols = s.df, []
        key = by[0][0] if by and by[0] else None
        for name, kind in s.path:
            if key is not None:
                df = self.prop_of(df, name, kind, None, key, f"_y_{name}")
                name = f"_y_{name}"
            cols.append((F.col(name), df.schema[name].dataType))
        df = df.withColumn("cur", F.array_compact(F.array(*_same(cols)))).select("cur", *s.carry())
        return self._set(s, df, "path")

    def _by(self, s, key=None, *_):
        return self._values(s, key) if isinstance(key, str) else s

    def _unfold(self, s):
        t = s.df.schema["cur"].dataType
        if isinstance(t, VariantType):
            arr = F.expr("if(startswith(schema_of_variant(cur), 'ARRAY'), cast(cur as array<variant>), array(cur))")
            return s.to(self.exploded(s, s.df, arr), "value")
        if isinstance(t, ArrayType):
            return s.to(self.exploded(s, s.df, F.coalesce("cur", F.array(F.lit(None).cast(t.elementType)))), "value")
        if isinstance(t, MapType):
            return s.to(self.exploded(s, s.df, F.map_entries("cur")), "value")
        return s

    # Barriers

    def _agg(self, s: State, value: Column, empty=None) -> State:
        fresh = replace(s, path=(), tags={}, labels=None)
        order = [F.array(F.lit(0).cast("long")).alias("ord")] if s.ord else []
        if not s.keys:
            return fresh.to(s.df.agg(value.alias("cur")).select("cur", *order), "value")
        df = s.outer.join(s.df.groupBy(*s.keys).agg(value.alias("_c")), list(s.keys), "left")
        kind = df.schema["_c"].dataType
        empty = F.lit(None) if empty is None else empty
        df = df.select(F.coalesce("_c", empty.cast(kind)).alias("cur"), *s.keys, *([F.col(s.keys[-1]).alias("ord")] if s.ord else []))
        return fresh.to(df, "value")

    def numbers(self, s: State) -> Column:
        t = s.df.schema["cur"].dataType
        if isinstance(t, VariantType):
            return part("double")
        return F.col("cur") if isinstance(t, NumericType) else F.lit(None).cast("double")

    def _count(self, s):
        return self._agg(s, F.count("*"), F.lit(0))

    def _sum(self, s):
        return self._agg(s, F.sum(self.numbers(s)))

    def _mean(self, s):
        return self._agg(s, F.avg(self.numbers(s)))

    def extreme(self, s: State, fn) -> Column:
        """Of values of mixed types that of the numbers, or of the strings if there are no numbers."""
        if not isinstance(s.df.schema["cur"].dataType, VariantType):
            return fn("cur")
        return F.coalesce(*(fn(part(k)).cast(VariantType()) for k in ("double", "string")))

    def _max(self, s):
        return self._agg(s, self.extreme(s, F.max))

    def _min(self, s):
        return self._agg(s, self.extreme(s, F.min))

    def _fold(self, s, *args):
        all_ = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cur"))), lambda x: x["cur"])
        if not args:
            return self._agg(s, all_, F.array())
        seed, fn = args
        kind = "double" if isinstance(s.df.schema["cur"].dataType, NumericType) and isinstance(seed, float) else s.df.schema["cur"].dataType
        return self._agg(s, F.aggregate(all_, F.lit(seed).cast(kind), fn), F.lit(seed))

    # Order

    def _order(self, s, by=(), top=None):
        """Sorted by range partitions; `ord` becomes the place and `rid` keeps the row's name.  top: only so many rows."""
        df, keys = s.df, []
        for args in by:
            key, way = (*args, "asc")[:2] if args and isinstance(args[0], str) and args[0] not in ("asc", "desc") else (None, args[0] if args else "asc")
            if key is None:
                c, t = F.col("cur"), df.schema["cur"].dataType
            elif s.kind in ("vertex", "edge"):
                df = self.prop_of(df, "cur", s.kind, s.labels, key, f"_by_{len(keys)}")
                c, t = F.col(f"_by_{len(keys)}"), df.schema[f"_by_{len(keys)}"].dataType
            else:
                c, t = F.col(f"cur.{key}"), df.schema["cur"].dataType[key].dataType
            c = F.collate(c, "UNICODE") if isinstance(t, StringType) else c
            keys.append(c.desc() if way == "desc" else c.asc())
        if not by:
            t = df.schema["cur"].dataType
            keys = [F.collate("cur", "UNICODE") if isinstance(t, StringType) else F.col("cur")] if s.kind not in ("vertex", "edge") and not isinstance(t, (VariantType, StructType)) else []
            if isinstance(t, VariantType):  # numbers, strings, the rest
                number, text = part("double"), part("string")
                keys = [F.when(number.isNotNull(), 0).when(text.isNotNull(), 1).otherwise(2), number, F.collate(text, "UNICODE")]
        if not keys:
            return s
        df = df.orderBy(*keys, "ord")
        df = (df if top is None else df.limit(top)).withColumn("_r", F.monotonically_increasing_id())
        if "rid" not in s.df.columns:
            df = df.withColumn("rid", F.col("ord"))
        return replace(s, df=df.withColumn("ord", F.array("_r")).select(*s.df.columns, *(() if "rid" in s.df.columns else ("rid",))))

    def _range(self, s, lo, hi):
        lo = max(0, lo)
        if s.keys:
            n = F.row_number().over(Window.partitionBy(*s.keys).orderBy("ord"))
            return replace(s, df=s.df.withColumn("_n", n).filter((F.col("_n") > lo) & (F.lit(hi == -1) | (F.col("_n") <= max(lo, hi)))).drop("_n"))
        if hi != -1 and hi <= lo:
            return self._none(s)
        df = s.df.orderBy("ord")
        df = df.offset(lo) if lo else df
        return replace(s, df=df if hi == -1 else df.limit(hi - lo))

    def _tail(self, s, n=1):
        if n < 1:
            return self._none(s)
        if s.keys:
            k = F.row_number().over(Window.partitionBy(*s.keys).orderBy(F.col("ord").desc()))
            return replace(s, df=s.df.withColumn("_n", k).filter(F.col("_n") <= n).drop("_n"))
        return replace(s, df=s.df.orderBy(F.col("ord").desc()).limit(n))
