"""Immutable traversals: a tuple of steps, and the fluent methods that add to it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame


class FailStep(Exception):
    """Raised when a traversal with a fail() step runs."""


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()


#: Steps that a query language of this kind declares, without an implementation here.
UNIMPLEMENTED = (
    "aggregate barrier branch cap constant elementMap flatMap group groupCount key match option project propertyMap addE addV call coin "
    "connectedComponent cyclicPath drop element emit explain from_ index IO local loops math mergeEdge mergeVertex pageRank peerPressure profile program "
    "property read repeat sack sample shortestPath simplePath subgraph timeLimit to tree until value with_ write"
).split()


@dataclass(frozen=True)
class Traversal:
    """A chain of steps over a graph (or, without one, a part of another traversal)."""

    graph: Any = field(default=None, compare=False)
    steps: tuple[Step, ...] = ()
    compat: bool = False

    def _add(self, name: str, *args) -> Traversal:
        return replace(self, steps=(*self.steps, Step(name, args)))

    # Sources
    def V(self, x=()) -> Traversal:
        return self if x is None else self._add("V", *([x] if x != () else []))

    def E(self, x=()) -> Traversal:
        return self if x is None else self._add("E", *([x] if x != () else []))

    def as_(self, *keys: str) -> Traversal:
        return self._add("as", *keys)

    def fold(self, *args) -> Traversal:
        if len(args) not in (0, 2):
            raise TypeError("fold() takes no argument, or a seed and a function")
        return self._add("fold", *args)

    def limit(self, n: int) -> Traversal:
        return self._add("range", 0, n)

    def skip(self, n: int) -> Traversal:
        return self._add("range", n, -1)

    def tail(self, n: int = 1) -> Traversal:
        return self._add("tail", n)

    # Terminals
    def to_df(self, ordered: bool = False) -> DataFrame:
        """The result as a DataFrame with its value in `value` (for select and valueMap a struct, for path an array)."""
        from .compile import run

        return run(self, ordered)

    def toArray(self) -> list:
        from .compile import plain

        return [plain(r["value"]) for r in self.to_df(ordered=True).collect()]

    def toList(self):
        """A lazy sequence that runs the traversal anew each time it is iterated."""
        from .compile import plain

        class Rows:
            def __iter__(rows):
                return (plain(r["value"]) for r in self.to_df(ordered=True).toLocalIterator())

        return Rows()

    def toSet(self) -> set:
        return {tuple(x) if isinstance(x, list) else x for x in self.toArray()}

    def clone(self) -> Traversal:
        return replace(self)

    def isEqual(self, other: Traversal) -> bool:
        return self == other


def _plain(name: str):
    def method(self, *args) -> Traversal:
        return self._add(name, *args)

    method.__name__ = name
    return method


def _stub(name: str):
    def method(self, *args, **kw):
        raise NotImplementedError(name)

    method.__name__ = name
    return method


for _n in (
    "inject out in_ both outE inE bothE outV inV bothV otherV has hasId hasKey hasLabel hasNot hasValue filter none dedup fail and_ or_ not_ where choose coalesce optional "
    "union id label values valueMap properties map identity path select by unfold sideEffect count sum mean max min order range"
).split():
    setattr(Traversal, _n, _plain(_n))
Traversal.is_ = _plain("is")
Traversal.dedupe = _plain("dedup")
for _n in UNIMPLEMENTED:
    setattr(Traversal, _n, _stub(_n))


class _Anonymous:
    """`__.out('x')`: a traversal without a graph, for use inside another one."""

    def __getattr__(self, name: str):
        return getattr(Traversal(), name)


__ = _Anonymous()
