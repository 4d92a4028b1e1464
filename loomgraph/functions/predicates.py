"""Value predicates for ``has`` and ``is_``, on properties and on numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class P:
    """A test on one column; a null value never passes, not even negated."""

    test: Callable[[Column], Column]
    text: str = ""

    def __call__(self, c: Column) -> Column:
        return F.coalesce(self.test(c), F.lit(False))

    def __and__(self, other: P) -> P:
        return P(lambda c: self.test(c) & other.test(c))

    def __or__(self, other: P) -> P:
        return P(lambda c: self.test(c) | other.test(c))

    def __invert__(self) -> P:
        return P(lambda c: ~self.test(c))


def eq(x: Any) -> P:
    return P(lambda c: c == x)


def neq(x: Any) -> P:
    return P(lambda c: c != x)


def lt(x: Any) -> P:
    return P(lambda c: c < x)


def lte(x: Any) -> P:
    return P(lambda c: c <= x)


def gt(x: Any) -> P:
    return P(lambda c: c > x)


def gte(x: Any) -> P:
    return P(lambda c: c >= x)


def between(a: Any, b: Any) -> P:
    """From ``a`` inclusive to ``b`` exclusive."""
    return P(lambda c: (c >= a) & (c < b))


def inside(a: Any, b: Any) -> P:
    return P(lambda c: (c > a) & (c < b))


def outside(a: Any, b: Any) -> P:
    return P(lambda c: (c < a) | (c > b))


def within(*xs: Any) -> P:
    return P(lambda c: c.isin(list(xs)))


def without(*xs: Any) -> P:
    return P(lambda c: ~c.isin(list(xs)))


def starting_with(x: str) -> P:
    return P(lambda c: c.startswith(x))


def ending_with(x: str) -> P:
    return P(lambda c: c.endswith(x))


def containing(x: str) -> P:
    return P(lambda c: c.contains(x))


def regex(x: str) -> P:
    return P(lambda c: c.rlike(x))


def predicate(x: Any) -> P:
    return x if isinstance(x, P) else eq(x)


#: Names that query texts may use.
NAMED = {"eq": eq, "neq": neq, "lt": lt, "lte": lte, "gt": gt, "gte": gte, "between": between, "inside": inside, "outside": outside, "within": within, "without": without,
         "startingWith": starting_with, "endingWith": ending_with, "containing": containing, "regex": regex}

#: Python predicates that a program registered by name: (batch of a vertex property) -> booleans.
_REGISTERED: dict[str, Callable] = {}


def register_predicate(name: str, test: Callable) -> None:
    """Make an Arrow-batched Python predicate usable as ``has(key, call(name))``; ``test`` maps a pandas Series to booleans."""
    _REGISTERED[name] = F.pandas_udf(test, "boolean")


def call(name: str) -> P:
    return P(lambda c: _REGISTERED[name](c))
