"""Predicates on values, as Column expressions that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    name: str
    args: tuple
    build: Callable[[Column], Column]
    #: Whether a missing value passes.
    missing: bool = False

    def to_column(self, c: Column) -> Column:
        """For filters: null where a missing value does not pass, as a scan can take that over."""
        return F.coalesce(self.build(c), F.lit(True)) if self.missing else self.build(c)

    def __eq__(self, other) -> bool:
        return isinstance(other, Predicate) and (self.name, self.args) == (other.name, other.args)

    def __hash__(self) -> int:
        return hash((self.name, self.args))


def _flat(xs: tuple) -> list:
    return list(xs[0]) if len(xs) == 1 and isinstance(xs[0], (list, tuple, set)) else list(xs)


def _in(c: Column, xs: list) -> Column:
    known = [x for x in xs if x is not None]
    hit = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return hit | c.isNull() if len(known) < len(xs) else hit


def _order(name: str, op) -> Callable:
    """Comparisons are false for a missing value and for NaN, which Spark would order last."""

    def make(*xs) -> Predicate:
        return Predicate(name, xs, lambda c: op(c, *xs) & ~c.cast("string").eqNullSafe(F.lit("NaN")))

    return make


class P:
    """eq neq gt gte lt lte between inside outside within without startingWith."""

    eq = staticmethod(lambda x: Predicate("eq", (x,), lambda c: c.eqNullSafe(F.lit(x)), x is None))
    neq = staticmethod(lambda x: Predicate("neq", (x,), lambda c: ~c.eqNullSafe(F.lit(x)), x is not None))
    gt = staticmethod(_order("gt", lambda c, x: c > x))
    gte = staticmethod(_order("gte", lambda c, x: c >= x))
    lt = staticmethod(_order("lt", lambda c, x: c < x))
    lte = staticmethod(_order("lte", lambda c, x: c <= x))
    between = staticmethod(_order("between", lambda c, x, y: (c >= x) & (c < y)))
    inside = staticmethod(_order("inside", lambda c, x, y: (c > x) & (c < y)))
    outside = staticmethod(_order("outside", lambda c, x, y: (c < x) | (c > y)))

    @staticmethod
    def within(*xs) -> Predicate:
        xs = _flat(xs)
        return Predicate("within", tuple(xs), lambda c: _in(c, xs), None in xs)

    @staticmethod
    def without(*xs) -> Predicate:
        xs = _flat(xs)
        return Predicate("without", tuple(xs), lambda c: ~_in(c, xs), None not in xs)

    @staticmethod
    def startingWith(s: str) -> Predicate:
        return Predicate("startingWith", (s,), lambda c: c.cast("string").startswith(s))
