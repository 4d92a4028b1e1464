"""Quantifiers over vertices, planned as joins and counts.

A filter becomes a relation of variable bindings, stored either by its true or by its false tuples, whichever is
sparse. Connectives join, union or anti-join relations; a quantifier groups one variable away. All candidate sets go through
one plan, keyed by ``set_id``; no product of a set with itself is formed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators.traversal import VERTEX, Compared, Reduced, Source, Traversal
from loomgraph.plans.language import Atom, Const, Not, Op, Test, Var, as_steps, variables

EXIST, FORALL = "exist", "forall"


@dataclass(frozen=True)
class Relation:
    """Bindings of ``names``: exactly the rows of ``df`` if ``positive``, else all but them. ``df`` None has no rows."""

    names: tuple[str, ...]
    df: DataFrame | None
    positive: bool

    def negated(self) -> Relation:
        return Relation(self.names, self.df, not self.positive)


TRUE, FALSE = Relation((), None, False), Relation((), None, True)


def _scope(bound: list[str]) -> tuple[str, ...]:
    """A filter is asked once per binding, so ``dedup`` and ``limit`` act within one."""
    return tuple(f"as:{n}" for n in bound)


def _atom(graph: PropertyGraph, atom: Atom) -> Relation:
    g = Source(graph)
    bound: list[str] = []
    t = None
    if atom.source == "V":
        if len(atom.start) == 1 and isinstance(atom.start[0], Var):
            t = g.V().as_(atom.start[0].name)
            bound.append(atom.start[0].name)
            t = t._new(t.df, scope=_scope(bound))
        elif any(isinstance(a, Var) for a in atom.start):
            raise ValueError("g.V takes one variable or ids")
        else:
            t = g.V(*atom.start)
    else:
        t = g.E(*atom.start)
    reduced: Reduced | None = None
    for name, args in atom.steps:
        if name == "next":
            continue
        if reduced is not None:
            if name != "is" or len(args) != 1:
                raise ValueError(f"{name} cannot follow a reducing step")
            test = args[0] if isinstance(args[0], Test) else Test("eq", (args[0],))
            return _counted(reduced, test, tuple(bound))
        if name == "is" and isinstance(args[0], Var):
            var = args[0].name
            if t.kind != VERTEX:
                return FALSE  # an edge or a value is never a vertex
            if var in bound:
                t = t._new(t.df.where(F.col("_v") == F.col(f"`as:{var}`")))
            else:
                t = t.as_(var)
                bound.append(var)
                t = t._new(t.df, scope=_scope(bound))
            continue
        inner = {v for a in args if isinstance(a, tuple) and a[:1] == ("steps",) for _, x in a[1] for v in x if isinstance(v, Var)}
        if {v.name for v in inner} - set(bound):
            raise ValueError("a nested traversal may only compare with variables that are bound before it")
        t = as_steps(((name, args),)).on(t)
        if isinstance(t, Reduced):
            reduced = t
    if reduced is not None:
        return TRUE  # a number is there whatever it counts
    return _tuples(t, tuple(bound))


def _tuples(t: Traversal, names: tuple[str, ...]) -> Relation:
    if not names:
        return FALSE if t.df.isEmpty() else TRUE
    return Relation(names, t.df.select(*[F.col(f"`as:{n}`").alias(n) for n in names]).distinct(), True)


def _counted(r: Reduced, test: Test, names: tuple[str, ...]) -> Relation:
    check = test.predicate()
    if not names:
        return FALSE if Compared(r, check)._whole().isEmpty() else TRUE
    rows = r.of.df.groupBy(*[F.col(f"`as:{n}`").alias(n) for n in names]).agg(r.agg.alias("_x"))
    if r.name == "count" and test.holds(0):  # also true of all bindings that have no row at all
        return Relation(names, rows.where(~check(F.col("_x"))).select(*names), False)
    return Relation(names, rows.where(check(F.col("_x"))).select(*names), True)


def _pad(graph: PropertyGraph, df: DataFrame, have: tuple[str, ...], want: tuple[str, ...]) -> DataFrame:
    """Bind the variables of ``want`` that ``df`` lacks to all vertices, if that stays small."""
    new = [n for n in want if n not in have]
    if new:
        size = df.count() * graph.vertices.count() ** len(new)
        if size > graph.options.max_bindings:
            raise ValueError(f"the filter leaves {', '.join(new)} unrestricted in {size} bindings; the limit is {graph.options.max_bindings}")
    for n in new:
        df = df.crossJoin(graph.vertices.select(F.col("vid").alias(n)))
    return df.select(*want)


def _and(graph: PropertyGraph, a: Relation, b: Relation) -> Relation:
    if a.df is None or b.df is None:
        first, other = (a, b) if a.df is None else (b, a)
        return FALSE if first.positive else other
    if a.positive and b.positive:
        shared = [n for n in b.names if n in a.names]
        names = (*a.names, *[n for n in b.names if n not in a.names])
        if shared:
            return Relation(names, a.df.join(b.df, shared).select(*names), True)
        if a.df.count() * b.df.count() > graph.options.max_bindings:
            raise ValueError("two conditions without a common variable have too many bindings together")
        return Relation(names, a.df.crossJoin(b.df).select(*names), True)
    if a.positive != b.positive:
        pos, neg = (a, b) if a.positive else (b, a)
        names = (*pos.names, *[n for n in neg.names if n not in pos.names])
        return Relation(names, _pad(graph, pos.df, pos.names, names).join(neg.df, list(neg.names), "left_anti").select(*names), True)
    names = (*a.names, *[n for n in b.names if n not in a.names])
    return Relation(names, _pad(graph, a.df, a.names, names).union(_pad(graph, b.df, b.names, names)).distinct(), False)


def relation(graph: PropertyGraph, expr: object) -> Relation:
    """The bindings for which a parsed filter holds on the whole graph."""
    if isinstance(expr, Const):
        return TRUE if expr.value else FALSE
    if isinstance(expr, Not):
        return relation(graph, expr.of).negated()
    if isinstance(expr, Op):
        parts = [relation(graph, p) for p in expr.parts]
        if expr.name == "and":
            return reduce(lambda x, y: _and(graph, x, y), parts)
        if all(p.positive and p.df is not None for p in parts) and len({frozenset(p.names) for p in parts}) == 1:
            return Relation(parts[0].names, reduce(DataFrame.union, [p.df.select(*parts[0].names) for p in parts]).distinct(), True)
        return reduce(lambda x, y: _and(graph, x, y), [p.negated() for p in parts]).negated()
    return _atom(graph, expr)


def holding_sets(graph: PropertyGraph, prefix: list[tuple[str, str]], expr: object, members: DataFrame) -> DataFrame:
    """``(set_id)`` of the non-empty sets of ``members (set_id, vid)`` for which the sentence holds.

    ``prefix`` is a list of (variable, quantifier), outermost first, each ranging over the set; the filter itself sees the
    whole graph.
    """
    loose = variables(expr) - {v for v, _ in prefix}
    if loose:
        raise ValueError(f"{', '.join(sorted(loose))} in the filter has no quantifier")
    rel = relation(graph, expr)
    sets = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("_size"))
    if rel.df is None:
        return sets.select("set_id") if not rel.positive else sets.select("set_id").limit(0)
    rows, names, positive = rel.df, list(rel.names), rel.positive
    for i, n in enumerate(names):
        m = members.select("set_id", F.col("vid").alias(n))
        rows = rows.join(m, n if i == 0 else ["set_id", n])
    rows = rows.select("set_id", *names)
    for var, quantifier in reversed(prefix):
        if var not in names:
            continue
        rest = ["set_id", *[n for n in names if n != var]]
        if (quantifier == EXIST) == positive:
            # a true tuple is enough for "exist", a false one against "forall"
            rows = rows.select(*rest).distinct()
        else:
            # "forall" needs as many true tuples as the set has members; "exist" fails if as many are false
            full = rows.distinct().groupBy(*rest).agg(F.count(F.lit(1)).alias("_n")).join(sets, "set_id")
            rows = full.where(F.col("_n") == F.col("_size")).select(*rest)
        names.remove(var)
    rows = rows.select("set_id").distinct()
    return rows if positive else sets.select("set_id").join(rows, "set_id", "left_anti")


def holds(graph: PropertyGraph, prefix: list[tuple[str, str]], expr: object) -> DataFrame:
    """One row ``(holds BOOLEAN)``: the sentence over all vertices. On no vertices the outermost quantifier decides."""
    members = graph.vertices.select(F.lit(0).alias("set_id"), "vid")
    true = holding_sets(graph, prefix, expr, members)
    state = graph.vertices.agg((F.count(F.lit(1)) > 0).alias("some")).join(true.agg((F.count(F.lit(1)) > 0).alias("yes")))
    return state.select(F.when(F.col("some"), F.col("yes")).otherwise(F.lit(prefix[0][1] == FORALL)).alias("holds"))


