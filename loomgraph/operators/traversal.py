"""Path-style traversals compiled to joins and filters.

A :class:`Traversal` holds one row per traverser. While it stands on vertices, ``_v`` is the vertex; on edges, ``_src`` and
``_dst`` (and ``_from``, the end it came from); on values, ``_x``. Everything else in the frame is carried along: labelled
steps, paths, the origin of a nested traversal. Multiplicity is that of the bag semantics of the traversal language:
``out``/``in_``/``both`` visit a neighbour once per traverser, ``both`` skips the vertex itself, edge steps keep every edge.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.functions.predicates import P, predicate
from loomgraph.functions.values import VALUE_STEPS
from loomgraph.model import EDGE_CORE, VERTEX_CORE, PropertyGraph
from loomgraph.storage import materialize, n_rows

VERTEX, EDGE, VALUE = "vertex", "edge", "value"


class Steps:
    """A nested traversal, recorded and applied later: ``__.out("knows").has("age", gt(30))``."""

    def __init__(self, steps: tuple = ()):
        self.steps = steps

    def __getattr__(self, name: str) -> Callable[..., Steps]:
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *a, **k: Steps((*self.steps, (name, a, k)))

    def on(self, t: Traversal) -> Traversal:
        for name, args, kwargs in self.steps:
            t = getattr(t, name)(*args, **kwargs)
        return t


__ = Steps()

#: Steps that see more than one traverser at a time.
BARRIERS = {"dedup", "limit", "skip", "range", "tail", "sample", "order"}


def _barrier(nested: Steps) -> bool:
    return any(name in BARRIERS or any(isinstance(a, Steps) and _barrier(a) for a in (*args, *kwargs.values())) for name, args, kwargs in nested.steps)


#: Steps that an existence test may run from the far end.
MOVES, TESTS = {"out", "in_", "both"}, {"has", "hasLabel", "hasId", "hasNot", "hasKey", "where", "filter", "not_", "and_", "or_"}


def _closed(nested: Steps, allowed: set[str]) -> bool:
    """Whether ``nested`` has only ``allowed`` steps and refers to nothing outside of it."""
    for name, args, kwargs in nested.steps:
        if name not in allowed or kwargs or any(isinstance(a, Column) for a in args) or not all(_closed(a, MOVES | TESTS) for a in args if isinstance(a, Steps)):
            return False
    return True


class Source:
    """Where traversals start: ``g.V()``, ``g.V(1)``, ``g.E()``, ``g.inject(...)``."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def V(self, *ids: Any) -> Traversal:
        rows = self.graph.vertices_by_id(ids) if ids else self.graph.vertices
        return Traversal(self.graph, _prefixed(rows, "vid", "_v"), VERTEX, loaded=True)

    def E(self, *ids: Any) -> Traversal:
        rows = self.graph.edges_by_id(ids) if ids else self.graph.edges
        return Traversal(self.graph, _prefixed_edges(rows), EDGE, loaded=True)

    def inject(self, *values: Any) -> Traversal:
        return Traversal(self.graph, self.graph.spark.createDataFrame([(v,) for v in values], ["_x"]), VALUE)


def _prefixed(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(F.col(key).alias(name), *[F.col(c).alias(f"p:{c}") for c in rows.columns])


def _prefixed_edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), *[F.col(c).alias(f"p:{c}") for c in rows.columns])


@dataclass(frozen=True)
class Traversal:
    graph: PropertyGraph
    df: DataFrame
    kind: str
    loaded: bool = False
    #: Labelled steps: name -> kind; their columns are ``as:<name>`` (vertices and values) or ``as:<name>.src/.dst``.
    tags: dict[str, str] = field(default_factory=dict)
    tracked: bool = False
    #: Columns that tell one evaluation of a nested traversal or filter from another; ``dedup``, ``limit`` and the like act within one.
    scope: tuple[str, ...] = ()
    #: What ``aggregate`` kept: name -> traversal.
    sides: dict[str, Any] = field(default_factory=dict)

    # -- plumbing ----------------------------------------------------------------------------------------------------------

    def _new(self, df: DataFrame, kind: str | None = None, loaded: bool | None = None, **more: Any) -> Traversal:
        return Traversal(self.graph, df, kind or self.kind, self.loaded if loaded is None else loaded, more.get("tags", self.tags), more.get("tracked", self.tracked), more.get("scope", self.scope), more.get("sides", self.sides))

    def _here(self) -> list[str]:
        return {VERTEX: ["_v"], EDGE: ["_src", "_dst", "_from"], VALUE: ["_x"]}[self.kind]

    def _carried(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_v", "_src", "_dst", "_from", "_x") and not c.startswith("p:")]

    def _load(self) -> Traversal:
        if self.loaded or self.kind == VALUE:
            return self
        if self.kind == VERTEX:
            rows = _prefixed(self.graph.vertices, "vid", "_k")
            return self._new(self.df.join(rows, F.col("_v") == F.col("_k")).drop("_k"), loaded=True)
        rows = _prefixed_edges(self.graph.edges).withColumnsRenamed({"_src": "_ks", "_dst": "_kd"})
        return self._new(self.df.join(rows, (F.col("_src") == F.col("_ks")) & (F.col("_dst") == F.col("_kd"))).drop("_ks", "_kd"), loaded=True)

    def _names(self) -> list[str]:
        core = VERTEX_CORE if self.kind == VERTEX else EDGE_CORE
        own = self.graph.vertices if self.kind == VERTEX else self.graph.edges
        return [c for c in own.columns if c not in core]

    def _property(self, key: str) -> Column:
        return F.col(f"`p:{key}`") if key in self._names() else F.lit(None).cast("string")

    def _step(self, df: DataFrame, now: Column) -> DataFrame:
        return df.withColumn("_path", F.array_append("_path", now.cast("string"))) if self.tracked else df

    # -- moves ---------------------------------------------------------------------------------------------------------------

    def _labelled(self, labels: tuple) -> DataFrame:
        e = self.graph.edges
        return e.where(F.col("label").isin(list(labels))) if labels else e

    def _hop(self, pairs: DataFrame) -> Traversal:
        base = self.df.select("_v", *[f"`{c}`" for c in self._carried()])
        moved = base.join(pairs, F.col("_v") == F.col("_a")).drop("_v", "_a").withColumnRenamed("_b", "_v")
        return self._new(self._step(moved, F.col("_v")), VERTEX, False)

    def out(self, *labels: str) -> Traversal:
        return self._hop(self._labelled(labels).select(F.col("src").alias("_a"), F.col("dst").alias("_b")))

    def in_(self, *labels: str) -> Traversal:
        return self._hop(self._labelled(labels).select(F.col("dst").alias("_a"), F.col("src").alias("_b")))

    def both(self, *labels: str) -> Traversal:
        e = self._labelled(labels).where("src <> dst")
        pairs = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).union(e.select("dst", "src")).distinct()
        return self._hop(pairs)

    def _edges(self, labels: tuple, ends: tuple[str, ...]) -> Traversal:
        rows = _prefixed_edges(self._labelled(labels))
        sides = [rows.withColumn("_a", F.col(end)) for end in ends]
        rows = reduce(DataFrame.unionByName, sides)
        base = self.df.select("_v", *[f"`{c}`" for c in self._carried()])
        moved = base.join(rows, F.col("_v") == F.col("_a")).drop("_a").withColumnRenamed("_v", "_from")
        return self._new(self._step(moved, F.concat_ws("->", "_src", "_dst")), EDGE, True)

    def outE(self, *labels: str) -> Traversal:
        return self._edges(labels, ("_src",))

    def inE(self, *labels: str) -> Traversal:
        return self._edges(labels, ("_dst",))

    def bothE(self, *labels: str) -> Traversal:
        """Out- and in-edges; a self-loop comes twice."""
        return self._edges(labels, ("_src", "_dst"))

    def _end(self, end: Column) -> Traversal:
        moved = self.df.select(end.alias("_v"), *[f"`{c}`" for c in self._carried()])
        return self._new(self._step(moved, F.col("_v")), VERTEX, False)

    def inV(self) -> Traversal:
        return self._end(F.col("_dst"))

    def outV(self) -> Traversal:
        return self._end(F.col("_src"))

    def bothV(self) -> Traversal:
        return self._end(F.explode(F.array("_src", "_dst")))

    def otherV(self) -> Traversal:
        if "_from" not in self.df.columns:
            raise ValueError("otherV needs an edge that was reached from a vertex")
        return self._end(F.when(F.col("_src") == F.col("_from"), F.col("_dst")).otherwise(F.col("_src")))

    def V(self, *ids: Any) -> Traversal:
        """Mid-traversal start: every traverser goes to every vertex of ``ids``; the ids are needed."""
        if not ids:
            raise ValueError("a traversal in its middle needs the ids of the vertices to go to")
        rows = self.graph.vertices_by_id(ids).select(F.col("vid").alias("_b"))
        base = self.df.select(*[f"`{c}`" for c in self._carried()])
        moved = base.join(F.broadcast(rows)).withColumnRenamed("_b", "_v")  # as many rows as ids were written
        return self._new(self._step(moved, F.col("_v")), VERTEX, False)

    # -- filters -------------------------------------------------------------------------------------------------------------

    def has(self, key: str, value: Any = None, third: Any = None) -> Traversal:
        """``has(key)``, ``has(key, value or P)`` or ``has(label, key, value)``; a missing property never passes."""
        if third is not None:
            return self.hasLabel(key).has(value, third)
        t = self._load()
        if key in ("id", "label"):
            return t._new(t.df.where(predicate(value)(F.col(f"`p:{key}`"))))
        test = t._property(key).isNotNull() if value is None else predicate(value)(t._property(key)) if key in t._names() else F.lit(False)
        return t._new(t.df.where(test))

    def hasNot(self, key: str) -> Traversal:
        t = self._load()
        return t._new(t.df.where(t._property(key).isNull()))

    def hasLabel(self, *labels: str) -> Traversal:
        t = self._load()
        return t._new(t.df.where(F.col("`p:label`").isin(list(labels))))

    def hasId(self, *ids: Any) -> Traversal:
        if self.kind == VERTEX and not self.loaded:  # as many vertices as ids were written
            rows = self.graph.vertices.where(F.col("id").isin([str(i) for i in ids])).select(F.col("vid").alias("_k"))
            return self._new(self.df.join(F.broadcast(rows), F.col("_v") == F.col("_k"), "left_semi"))
        t = self._load()
        return t._new(t.df.where(F.col("`p:id`").isin([str(i) for i in ids])))

    def hasKey(self, *keys: str) -> Traversal:
        t = self._load()
        return t._new(t.df.where(reduce(lambda a, b: a | b, [t._property(k).isNotNull() for k in keys])))

    def is_(self, value: Any) -> Traversal:
        """On values a comparison. On vertices identity with a vertex id; an edge is never a vertex."""
        if self.kind == VALUE:
            return self._new(self.df.where(predicate(value)(F.col("_x"))))
        return self._new(self.df.where(F.col("_v") == value if self.kind == VERTEX else F.lit(False)))

    def _key(self) -> list[str]:
        return ["_v"] if self.kind == VERTEX else ["_src", "_dst"] if self.kind == EDGE else ["_x"]

    def _from_far_end(self, nested: Steps) -> DataFrame:
        """``(_v)``: the vertices from which ``nested``, moves and tests, has a result."""
        last = max(i for i, (name, _, _) in enumerate(nested.steps) if name in MOVES)
        name, labels, _ = nested.steps[last]
        after, before = nested.steps[last + 1 :], nested.steps[:last]
        e = self._labelled(labels).select("src", "dst")
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = e if name == "out" else back if name == "in_" else e.unionByName(back).where("src <> dst")
        if after:
            ends = Steps(after).on(Source(self.graph).V()).df.select(F.col("_v").alias("dst"))
            pairs = pairs.join(ends, "dst", "left_semi")
        while True:
            here = pairs.select(F.col("src").alias("_v")).distinct()
            at = max((i for i, (step, _, _) in enumerate(before) if step in MOVES), default=-1)
            tests, before = before[at + 1 :], before[: at + 1]
            if tests:
                here = Steps(tests).on(Traversal(self.graph, here, VERTEX)).df.select("_v")
            if not before:
                return here
            step, labels, _ = before[-1]
            before = before[:-1]
            e = self._labelled(labels).select("src", "dst")
            back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            pairs = e if step == "out" else back if step == "in_" else e.unionByName(back).where("src <> dst")
            pairs = pairs.join(here.withColumnRenamed("_v", "dst"), "dst", "left_semi")

    def _passing(self, nested: Steps, far: bool = True) -> tuple[DataFrame, list[str]]:
        """Keys of the current elements for which ``nested`` has a result. Evaluated once per element, not per traverser.

        Moves between vertices and tests that refer to nothing outside run from the far end, as semi-joins: no row is multiplied.
        """
        keys = self._key()
        if far and self.kind == VERTEX and _closed(nested, MOVES | TESTS) and any(name in MOVES for name, _, _ in nested.steps):
            return self._from_far_end(nested).select("_v"), ["_v"]
        origin = [f"_o{len([c for c in self.df.columns if c.startswith('_o')])}{k}" for k in keys]
        refs = [c for c in self.df.columns if c.startswith("as:") or c == "_loops"]
        base = self.df.select(*keys, *[f"`{c}`" for c in refs]).distinct().withColumns({o: F.col(k) for o, k in zip(origin, keys)})
        inner = nested.on(Traversal(self.graph, base, self.kind, tags=self.tags, scope=(*origin, *refs)))
        if isinstance(inner, Reduced):
            inner = inner.per(origin + refs, base.select(*origin, *[f"`{c}`" for c in refs]))
        return inner.df.select(*[F.col(o).alias(k) for o, k in zip(origin, keys)], *[f"`{c}`" for c in refs]).distinct(), keys + refs

    def _semi(self, nested: Steps, how: str) -> Traversal:
        rows, keys = self._passing(nested)
        rows = rows.toDF(*[f"_m{i}" for i in range(len(keys))])
        match = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)])
        return self._new(self.df.join(rows, match, how))

    def where(self, nested: Steps) -> Traversal:
        return self._semi(nested, "left_semi")

    filter = where

    def not_(self, nested: Steps) -> Traversal:
        return self._semi(nested, "left_anti")

    def and_(self, *nested: Steps) -> Traversal:
        return reduce(lambda t, n: t.where(n), nested, self)

    def or_(self, *nested: Steps) -> Traversal:
        far = all(_closed(n, MOVES | TESTS) and any(name in MOVES for name, _, _ in n.steps) for n in nested)
        parts = [self._passing(n, far) for n in nested]
        keys = parts[0][1]
        rows = reduce(DataFrame.union, [p[0] for p in parts]).distinct().toDF(*[f"_m{i}" for i in range(len(keys))])
        match = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)])
        return self._new(self.df.join(rows, match, "left_semi"))

    def dedup(self, *by: str) -> Traversal:
        """One traverser per element, or per value of a property."""
        if not by:
            return self._new(self.df.dropDuplicates([*self.scope, *self._key()]))
        t = self._load()
        return t._new(t.df.dropDuplicates([*self.scope, *[f"p:{k}" for k in by]]))

    def simplePath(self) -> Traversal:
        t = self._tracked()
        return t._new(t.df.where(F.size("_path") == F.size(F.array_distinct("_path"))))

    def cyclicPath(self) -> Traversal:
        t = self._tracked()
        return t._new(t.df.where(F.size("_path") > F.size(F.array_distinct("_path"))))

    def coin(self, share: float, seed: int = 1) -> Traversal:
        return self._new(self.df.where(F.rand(seed) < share))

    def sample(self, n: int, seed: int = 1) -> Traversal:
        return self._ranked([F.rand(seed)]).limit(n) if self.scope else self._new(self.df.orderBy(F.rand(seed)).limit(n))

    # -- order ---------------------------------------------------------------------------------------------------------------

    def order(self, *by: tuple[str, str] | str) -> Traversal:
        """``order(("age", "desc"), "name")``; on values, ``order()`` or ``order("desc")``. Ends with the element's key."""
        t = self._load()
        if t.kind == VALUE:
            now = F.col("_x").desc() if by == ("desc",) else F.col("_x")
            return t._ranked([now]) if t.scope else t._new(t.df.orderBy(now))
        keys = [(b, "asc") if isinstance(b, str) else b for b in by]
        column = lambda k: F.col(f"`p:{k}`") if k in (*t._names(), "id", "label") else t._property(k)
        cols = [column(k).desc() if d == "desc" else F.rand(1) if d == "shuffle" else column(k).asc() for k, d in keys]
        return t._ranked([*cols, *t._key()]) if t.scope else t._new(t.df.orderBy(*cols, *t._key()))

    def _scoped(self) -> Window:
        return Window.partitionBy(*[f"`{c}`" for c in self.scope])

    def _ranked(self, by: list[Column]) -> Traversal:
        """The order of the traversers of each evaluation, as a column that later steps carry along."""
        return self._new(self.df.withColumn("_rank", F.row_number().over(self._scoped().orderBy(*by))))

    def _cut(self, a: int, b: int | None = None) -> Traversal:
        """Traversers ``a`` to ``b - 1`` of each evaluation, in the order of ``order`` if there was one, then of the elements' keys."""
        by = [c for c in ("_rank", *self._key()) if c in self.df.columns]
        df = self.df.withColumn("_at", F.row_number().over(self._scoped().orderBy(*by)))
        return self._new(df.where(F.col("_at") > a if b is None else (F.col("_at") > a) & (F.col("_at") <= b)).drop("_at"))

    def limit(self, n: int) -> Traversal:
        return self._cut(0, n) if self.scope else self._new(self.df.limit(n))

    def skip(self, n: int) -> Traversal:
        return self._cut(n) if self.scope else self._new(self.df.offset(n))

    def range(self, a: int, b: int) -> Traversal:
        if self.scope:
            return self._cut(a, b if b >= 0 else None)
        return self._new(self.df.offset(a).limit(max(0, b - a)) if b >= 0 else self.df.offset(a))

    def tail(self, n: int = 1) -> Traversal:
        if self.scope:
            by = [F.col(c).desc() for c in ("_rank", *self._key()) if c in self.df.columns]
            return self._new(self.df.withColumn("_at", F.row_number().over(self._scoped().orderBy(*by))).where(F.col("_at") <= n).drop("_at"))
        return self.skip(max(0, self.df.count() - n))

    # -- values --------------------------------------------------------------------------------------------------------------

    def _value(self, x: Column, df: DataFrame | None = None) -> Traversal:
        df = self.df if df is None else df
        return self._new(df.select(x.alias("_x"), *[f"`{c}`" for c in self._carried()]), VALUE, False)

    def values(self, *keys: str) -> Traversal:
        t = self._load()
        keys = keys or tuple(t._names())
        one = len(keys) == 1
        cols = [t._property(k) if one else t._property(k).cast("string") for k in keys]
        got = t._value(F.explode(F.array_compact(F.array(*cols))) if not one else cols[0])
        return got._new(got.df.where(F.col("_x").isNotNull()))

    def value(self, key: str) -> Traversal:
        return self.values(key)

    def id(self) -> Traversal:
        t = self._load()
        return t._value(F.col("`p:id`"))

    def label(self) -> Traversal:
        t = self._load()
        return t._value(F.col("`p:label`"))

    def constant(self, x: Any) -> Traversal:
        return self._value(F.lit(x))

    def map(self, expr: Callable[[Column], Column] | Column) -> Traversal:
        """A column expression of the current value; no arbitrary code runs."""
        return self._value(expr(F.col("_x")) if callable(expr) else expr)

    math = map

    def unfold(self) -> Traversal:
        return self._value(F.explode("_x"))

    def valueMap(self, *keys: str, tokens: bool = False) -> DataFrame:
        """One row per element: ``properties``, a JSON object of its present properties as lists (flat values for edges)."""
        t = self._load()
        names = [k for k in (keys or t._names()) if k in t._names()]
        cells = [F.when(F.col(f"`p:{k}`").isNotNull(), F.array(F.col(f"`p:{k}`")) if t.kind == VERTEX else F.col(f"`p:{k}`")).alias(k) for k in names]
        lead = [F.col("`p:id`").alias("id"), F.col("`p:label`").alias("label")] if tokens else []
        return t.df.select(*lead, (F.to_json(F.struct(*cells)) if cells else F.lit("{}")).alias("properties"))

    def elementMap(self, *keys: str) -> DataFrame:
        """``id``, ``label``, the ends of an edge, and a column per property."""
        t = self._load()
        names = [k for k in (keys or t._names()) if k in t._names()]
        ends = [] if t.kind == VERTEX else [F.col("_src").alias("out_vertex"), F.col("_dst").alias("in_vertex")]
        return t.df.select(F.col("`p:id`").alias("id"), F.col("`p:label`").alias("label"), *ends, *[F.col(f"`p:{k}`").alias(k) for k in names])

    def project(self, **by: str) -> DataFrame:
        """``project(name="name", where="label", from_="out.id")``: one row per element.

        A value is a property, ``id`` or ``label``; on edges also ``out.<x>`` and ``in.<x>`` for the end vertices.
        """
        t = self._load()
        df, cols = t.df, []
        for side, key in (("out", "_src"), ("in", "_dst")):
            if t.kind == EDGE and any(x.startswith(side + ".") for x in by.values()):
                v = self.graph.vertices.select(*[F.col(c).alias(f"{side}:{c}") for c in self.graph.vertices.columns])
                df = df.join(v, F.col(key) == F.col(f"`{side}:vid`"))
        for name, x in by.items():
            side, _, rest = x.partition(".")
            col = F.col(f"`{side}:{rest}`") if rest and side in ("out", "in") else F.col(f"`p:{x}`") if x in (*t._names(), "id", "label") else F.lit(None).cast("string")
            cols.append(col.alias(name.rstrip("_")))
        return df.select(*cols)

    # -- labelled steps and paths ------------------------------------------------------------------------------------------------

    def as_(self, name: str) -> Traversal:
        now = F.col("_x") if self.kind == VALUE else F.col("_v") if self.kind == VERTEX else F.struct("_src", "_dst")
        return self._new(self.df.withColumn(f"as:{name}", now), tags={**self.tags, name: self.kind})

    def select(self, *names: str, by: str | None = None) -> DataFrame | Traversal:
        """Back to one labelled vertex, or a frame with a column per name: vertex ids, or their property ``by``."""
        if len(names) == 1 and by is None and self.tags[names[0]] == VERTEX:
            return self._new(self.df.select(F.col(f"`as:{names[0]}`").alias("_v"), *[f"`{c}`" for c in self._carried()]), VERTEX, False)
        if by is None:
            return self.df.select(*[F.col(f"`as:{n}`").alias(n) for n in names])
        df = self.df
        for n in names:
            v = self.graph.vertices.select(F.col("vid").alias(f"_k{n}"), F.col(by).alias(f"by:{n}"))
            df = df.join(v, F.col(f"`as:{n}`") == F.col(f"_k{n}"))
        return df.select(*[F.col(f"`by:{n}`").alias(n) for n in names])

    def where_same(self, a: str, b: str, same: bool = True) -> Traversal:
        """Keep traversers whose labelled steps ``a`` and ``b`` are the same element, or are not."""
        test = F.col(f"`as:{a}`") == F.col(f"`as:{b}`")
        return self._new(self.df.where(test if same else ~test))

    def _tracked(self) -> Traversal:
        if not self.tracked:
            raise ValueError("call with_path() at the start to record paths")
        return self

    def with_path(self) -> Traversal:
        return self._new(self.df.withColumn("_path", F.array((F.col("_v") if self.kind == VERTEX else F.concat_ws("->", "_src", "_dst")).cast("string"))), tracked=True)

    def path(self) -> DataFrame:
        t = self._tracked()
        return t.df.select(F.col("_path").alias("path"))

    # -- branches ------------------------------------------------------------------------------------------------------------

    def _merge(self, parts: list[Traversal]) -> Traversal:
        kind = parts[0].kind
        if any(p.kind != kind for p in parts):
            raise ValueError("the branches end on different kinds of elements")
        names = [n for n in parts[0]._here() if all(n in p.df.columns for p in parts)] + [c for c in parts[0]._carried() if all(c in p.df.columns for p in parts)]
        rows = reduce(DataFrame.union, [p.df.select(*[f"`{n}`" for n in names]) for p in parts])
        return parts[0]._new(rows, kind, False)

    def union(self, *nested: Steps) -> Traversal:
        return self._merge([n.on(self) for n in nested])

    def coalesce(self, *nested: Steps) -> Traversal:
        """Per traverser the first branch that has a result."""
        rest, parts = self, []
        for n in nested:
            parts.append(rest.local(n))
            rest = rest.not_(n)
        return self._merge(parts)

    def choose(self, test: Steps, then: Steps, other: Steps | None = None) -> Traversal:
        return self._merge([then.on(self.where(test)), (other or Steps()).on(self.not_(test))])

    def optional(self, nested: Steps) -> Traversal:
        return self.coalesce(nested, Steps())

    def local(self, nested: Steps) -> Traversal:
        """``nested`` for every traverser by itself."""
        if not _barrier(nested):
            return nested.on(self)
        own = f"_t{sum(c.startswith('_t') for c in self.df.columns)}"
        inner = nested.on(self._new(self.df.withColumnRenamed("_rank", f"{own}r").withColumn(own, F.monotonically_increasing_id()), scope=(own,)))
        return inner._new(inner.df.drop(own, "_rank").withColumnRenamed(f"{own}r", "_rank"), scope=self.scope) if isinstance(inner, Traversal) else inner

    flatMap = local

    def repeat(self, nested: Steps, times: int | None = None, until: Steps | None = None, emit: bool = False, limit: int | None = None) -> Traversal:
        """``times`` rounds, or rounds ``until`` a test holds; ``emit`` also keeps what every round reaches. A test may ask for ``loops``.

        Without ``times`` rounds go on until no traverser is left, each written once. On a cycle that never happens: after more rounds than
        there are elements to stand on, ValueError is raised. A ``limit`` ends the rounds before that, with a warning if it leaves traversers.
        """
        outer = f"_loops{sum(c.startswith('_loops') for c in self.df.columns)}"
        now, done, most, left = self._new(self.df.withColumnRenamed("_loops", outer).withColumn("_loops", F.lit(0))), 0, None, None
        out: list[Traversal] = []
        while times is None or done < times:
            if times is None:
                if (left == 0) if left is not None else now.df.isEmpty():
                    break
                if limit is not None and done >= limit:
                    warnings.warn(f"repeat stopped after {limit} rounds with traversers left", stacklevel=2)
                    break
                most = self._elements() if most is None and done >= 8 else most
                if most is not None and done > most:
                    raise ValueError(f"repeat goes round a cycle: traversers are left after {done} rounds")
            now, done = nested.on(now), done + 1
            now = now._new(now.df.withColumn("_loops", F.lit(done)))
            if until is not None:
                rows, keys = now._passing(until)
                rows = rows.toDF(*[f"_m{i}" for i in range(len(keys))]).withColumn("_hit", F.lit(True))
                match = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)])
                now = now._new(now.df.join(rows, match, "left").drop(*[f"_m{i}" for i in range(len(keys))]))
            if times is None:
                now = now._new(materialize(now.df, "repeat"))
                left = n_rows(now.df) if until is None or not n_rows(now.df) else None
            hit = F.col("_hit").isNotNull() if until is not None else F.lit(True)
            if emit or until is not None:
                out.append(now._new((now.df if emit else now.df.where(hit)).drop("_hit")))
            if until is not None:
                now = now._new(now.df.where(~hit).drop("_hit"))
            if times is None and len(out) > 8:  # what has come out so far, as one table
                out = [self._merge(out)]
                out = [out[0]._new(materialize(out[0].df, "repeat"))]
        got = now if until is None and not emit else self._merge(out) if out else self
        return got._new(got.df.drop("_loops").withColumnRenamed(outer, "_loops"))

    def loops(self) -> Traversal:
        """How many rounds of the ``repeat`` around it a traverser has made; 0 outside of one."""
        return self._value(F.col("_loops") if "_loops" in self.df.columns else F.lit(0))

    def _elements(self) -> int | None:
        """How many places a traverser can stand on; None for values, which have no bound."""
        return {VERTEX: self.graph.vertices.count, EDGE: lambda: 2 * self.graph.edges.count(), VALUE: lambda: None}[self.kind]()

    def match(self, *patterns: tuple[str, str, str]) -> Traversal:
        """Conjunction of edge patterns ``(a, label, b)`` over names; the first name is the current vertex."""
        t = self.as_(patterns[0][0])
        for a, label, b in patterns:
            have_a, have_b = a in t.tags, b in t.tags
            if not (have_a or have_b):
                raise ValueError("patterns must be connected")
            e = t._labelled((label,) if label else ()).select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
            on = [F.col(f"`as:{n}`") == F.col(c) for n, c, have in ((a, "_s", have_a), (b, "_d", have_b)) if have]
            df = t.df.join(e, reduce(lambda x, y: x & y, on))
            for n, c, have in ((a, "_s", have_a), (b, "_d", have_b)):
                if not have:
                    df = df.withColumn(f"as:{n}", F.col(c))
            t = t._new(df.drop("_s", "_d"), tags={**t.tags, a: VERTEX, b: VERTEX})
        return t

    # -- reducers ------------------------------------------------------------------------------------------------------------

    def count(self) -> Reduced:
        return Reduced(self, "count", F.count(F.lit(1)))

    def _number(self, name: str, agg: Callable[[Column], Column]) -> Reduced:
        return Reduced(self, name, agg(F.col("_x")))

    def sum(self) -> Reduced:
        return self._number("sum", F.sum)

    def min(self) -> Reduced:
        return self._number("min", F.min)

    def max(self) -> Reduced:
        return self._number("max", F.max)

    def mean(self) -> Reduced:
        return self._number("mean", F.avg)

    def fold(self) -> Reduced:
        return Reduced(self, "fold", F.sort_array(F.collect_list(F.col(self._key()[0]))))

    def groupCount(self, by: str | None = None) -> DataFrame:
        """``(key, n)`` by a property, ``label``, or the element itself; a missing property makes no group."""
        t = self._load() if by else self
        key = t._by(by)
        return t.df.select(key.alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def _by(self, by: str | None) -> Column:
        return F.col(self._key()[0]) if by is None else F.col(f"`p:{by}`") if by in (*self._names(), "id", "label") else F.lit(None).cast("string")

    def group(self, by: str, value: str, how: str = "list") -> DataFrame:
        """``(key, value)``: a property of the elements of each group, as sorted list or by ``sum/min/max/mean/count``."""
        t = self._load()
        agg = {"list": lambda c: F.sort_array(F.collect_list(c)), "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count}[how]
        return t.df.select(t._by(by).alias("key"), t._by(value).alias("v")).where(F.col("key").isNotNull()).groupBy("key").agg(agg("v").alias("value"))

    # -- mutations: see loomgraph.operators.mutation ----------------------------------------------------------------------------

    def drop(self) -> PropertyGraph:
        """The graph without the current elements; edges of dropped vertices go too."""
        from loomgraph.operators import mutation

        if self.kind == VERTEX:
            return mutation.drop_vertices(self.graph, self.df.select(F.col("_v").alias("vid")))
        return mutation.drop_edges(self.graph, self.df.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))

    def property(self, key: str, value: Any) -> PropertyGraph:
        """The graph with a property of the current elements set."""
        from loomgraph.operators import mutation

        if self.kind == VERTEX:
            return mutation.set_vertex_property(self.graph, self.df.select(F.col("_v").alias("vid")), key, value)
        return mutation.set_edge_property(self.graph, self.df.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")), key, value)

    def subgraph(self) -> PropertyGraph:
        """The graph of the current edges and their ends."""
        e = self.df.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
        ends = e.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        return self.graph.with_(self.graph.vertices.join(ends, "vid", "left_semi"), self.graph.edges.join(e, ["src", "dst"], "left_semi"))

    # -- side effects --------------------------------------------------------------------------------------------------------

    def aggregate(self, name: str) -> Traversal:
        """Keep the current elements under ``name`` and go on with them."""
        return self._new(self.df, sides={**self.sides, name: self})

    store = aggregate

    def cap(self, name: str) -> Reduced:
        """The list of what was kept under ``name``; ``side(name)`` is the same as traversers, for lists of any size."""
        return self.sides[name].fold()

    def side(self, name: str) -> Traversal:
        return self.sides[name]

    def _among(self, name: str, how: str) -> Traversal:
        kept = self.sides[name]
        if kept.kind != self.kind:
            raise ValueError(f"{name} holds another kind of elements")
        rows = kept.df.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(kept._key())])
        return self._new(self.df.join(rows, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_m{i}") for i, k in enumerate(self._key())]), how))

    def within(self, name: str) -> Traversal:
        """Traversers on an element kept under ``name``."""
        return self._among(name, "left_semi")

    def without(self, name: str) -> Traversal:
        """Traversers on an element not kept under ``name``."""
        return self._among(name, "left_anti")

    def tree(self) -> DataFrame:
        """``(depth, path, n)``: every beginning of a recorded path, once, with the number of traversers that went through it."""
        starts = F.transform(F.sequence(F.lit(1), F.size("_path")), lambda k: F.slice("_path", 1, k))
        return self._tracked().df.select(F.explode(starts).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select((F.size("path") - 1).alias("depth"), "path", "n")

    # -- terminals -----------------------------------------------------------------------------------------------------------

    def frame(self) -> DataFrame:
        """``vid`` per vertex traverser, ``(src, dst)`` per edge, ``value`` per value."""
        names = {"_v": "vid", "_src": "src", "_dst": "dst", "_x": "value"}
        return self.df.select(*[F.col(k).alias(names[k]) for k in self._key()])

    def toList(self) -> list:
        """Collect to the driver, as the caller asks."""
        rows = self.frame().collect()
        return [r[0] if len(r) == 1 else tuple(r) for r in rows]

    def next(self) -> Any:
        row = self.frame().first()
        if row is None:
            raise StopIteration
        return row[0] if len(row) == 1 else tuple(row)

    def iterate(self) -> Traversal:
        """Compute all rows and return none of them."""
        self.df.write.format("noop").mode("overwrite").save()
        return self

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def profile(self) -> DataFrame:
        """One row ``(rows, seconds, plan)`` of a run whose rows go nowhere."""
        seen, began = Observation(), time.time()
        self.df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        plan = self.df._jdf.queryExecution().executedPlan().toString()
        return self.graph.spark.createDataFrame([(seen.get["rows"], time.time() - began, plan)], "rows long, seconds double, plan string")


class Reduced:
    """A reducing step: one value over all traversers, or one per origin inside a nested traversal."""

    def __init__(self, of: Traversal, name: str, agg: Column):
        self.of, self.name, self.agg = of, name, agg

    def _whole(self) -> DataFrame:
        rows = self.of.df.agg(self.agg.alias("_x"), F.count(F.lit(1)).alias("_n"))
        return rows.select("_x") if self.name in ("count", "fold") else rows.where("_n > 0").select("_x")

    def frame(self) -> DataFrame:
        return self._whole().select(F.col("_x").alias(self.name))

    def is_(self, value: Any) -> Compared:
        return Compared(self, predicate(value))

    def next(self) -> Any:
        row = self.frame().first()
        if row is None:
            raise StopIteration
        return row[0]

    def toList(self) -> list:
        return [r[0] for r in self.frame().collect()]

    def per(self, keys: list[str], domain: DataFrame) -> Traversal:
        """One value for every key of ``domain``; ``count`` and ``fold`` have one even without traversers."""
        got = self.of.df.groupBy(*[f"`{k}`" for k in keys]).agg(self.agg.alias("_x"))
        if self.name == "count":
            on = reduce(lambda a, b: a & b, [F.col(f"d.`{k}`").eqNullSafe(F.col(f"g.`{k}`")) for k in keys])
            got = domain.alias("d").join(got.alias("g"), on, "left").select(*[F.col(f"d.`{k}`").alias(k) for k in keys], F.coalesce("g._x", F.lit(0)).alias("_x"))
        return Traversal(self.of.graph, got, VALUE)


class Compared(Reduced):
    """``count().is_(...)``: a filter on the reduced value."""

    def __init__(self, of: Reduced, test: P):
        super().__init__(of.of, of.name, of.agg)
        self.inner, self.test = of, test

    def _whole(self) -> DataFrame:
        return self.inner._whole().where(self.test(F.col("_x")))

    def per(self, keys: list[str], domain: DataFrame) -> Traversal:
        t = self.inner.per(keys, domain)
        return t._new(t.df.where(self.test(F.col("_x"))))


def together(**parts: Reduced) -> DataFrame:
    """One row with a column per reduced traversal, such as ``together(people=g.V().count(), ties=g.E().count())``."""
    out = None
    for name, r in parts.items():
        one = r.frame().toDF(name)
        out = one if out is None else out.join(one)  # one row each
    return out


def _value_step(expr: Callable[..., Column]) -> Callable[..., Traversal]:
    def step(self: Traversal, *args: Any) -> Traversal:
        if self.kind != VALUE:
            raise ValueError("this step works on values")
        return self._value(expr(F.col("_x"), *args))

    return step


for _name, _expr in VALUE_STEPS.items():
    setattr(Traversal, _name, _value_step(_expr))
