"""Second-order queries: sentences over all vertices, over every subset, or over communities and components."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators import algorithms
from loomgraph.operators.result import serialize
from loomgraph.plans import subsets as enumerate_
from loomgraph.plans.language import parse_filter, parse_having, parse_query
from loomgraph.plans.quantify import EXIST, FORALL, holding_sets, holds


@dataclass(frozen=True)
class _Query:
    graph: PropertyGraph
    prefix: tuple[tuple[str, str], ...] = ()
    text: str | None = None
    size: str = "true"

    def exist(self, name: str):
        return replace(self, prefix=(*self.prefix, (name, EXIST)))

    def forall(self, name: str):
        return replace(self, prefix=(*self.prefix, (name, FORALL)))

    def filter(self, text: str):
        """The last call counts."""
        return replace(self, text=text)

    def having(self, text: str):
        """A condition on ``size``; the last call counts."""
        return replace(self, size=text)


class Sentence(_Query):
    """``execute()`` is one row ``(holds)``."""

    def execute(self) -> DataFrame:
        if self.text is None or not self.prefix:
            raise ValueError("a sentence needs a filter and at least one quantifier")
        return holds(self.graph, list(self.prefix), parse_filter(self.text))


class _Sets(_Query):
    def executeForWeb(self) -> DataFrame:
        return serialize(self.graph, self.execute())


class VertexSubsets(_Sets):
    """``execute()`` is ``(subset_id, vids, size)``: all subsets of the vertices."""

    def execute(self) -> DataFrame:
        found = enumerate_.subsets(self.graph, list(self.prefix), parse_filter(self.text or "true"), parse_having(self.size))
        return enumerate_.numbered(found)


@dataclass(frozen=True)
class Candidates(_Sets):
    """``execute()`` is ``(subset_id, vids, size)`` of the candidate sets that pass; ``subset_id`` is the set's smallest vertex,
    or its community. ``members()`` gives ``(subset_id, vid)`` without building arrays, for sets of any size."""

    parts: DataFrame | None = None

    def members(self) -> DataFrame:
        rows = self.parts.select(F.col("component").alias("set_id"), "vid")
        sizes = rows.groupBy("set_id").agg(F.count(F.lit(1)).cast("int").alias("size")).where(parse_having(self.size))
        rows = rows.join(sizes.select("set_id"), "set_id", "left_semi")
        if self.prefix or self.text not in (None, "true"):
            good = holding_sets(self.graph, list(self.prefix), parse_filter(self.text or "true"), rows)
            rows = rows.join(good, "set_id", "left_semi")
        return rows.select(F.col("set_id").alias("subset_id"), "vid")

    def sizes(self) -> DataFrame:
        return self.members().groupBy("subset_id").agg(F.count(F.lit(1)).alias("size"))

    def execute(self) -> DataFrame:
        return self.members().groupBy("subset_id").agg(F.array_sort(F.collect_list("vid")).alias("vids"), F.count(F.lit(1)).cast("int").alias("size"))


class Reach(_Sets):
    start: int = 0

    def execute(self) -> DataFrame:
        found = self.found().groupBy().agg(F.array_sort(F.collect_list("vid")).alias("vids"), F.count(F.lit(1)).cast("int").alias("size")).where("size > 0")
        return found.select(F.lit(0).cast("long").alias("subset_id"), "vids", "size")

    def found(self) -> DataFrame:
        """``(vid)``: what the start reaches, itself included."""
        return algorithms.bfs(self.graph, self.start).select("vid")


class SecondOrder:
    """``SecondOrder(graph).Vset().forall("x").forall("y").filter("...").having("size > 1").execute()``.

    A filter is parsed by :mod:`loomgraph.plans.language`. Unknown steps and bad syntax raise; an absent property is false.
    """

    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def SecondOrder(self) -> Sentence:
        return Sentence(self.graph)

    def Vset(self) -> VertexSubsets:
        return VertexSubsets(self.graph)

    def Community(self) -> Candidates:
        return Candidates(self.graph, parts=algorithms.communities(self.graph))

    def WCC(self) -> Candidates:
        return Candidates(self.graph, parts=algorithms.wcc(self.graph))

    def SCC(self) -> Candidates:
        return Candidates(self.graph, parts=algorithms.scc(self.graph))

    def BFS(self, start: int) -> Reach:
        q = Reach(self.graph)
        object.__setattr__(q, "start", int(start))
        return q

    def run(self, text: str) -> DataFrame:
        """A whole query as text, such as ``g.WCC().forall('x').filter('...').execute()``."""
        calls = parse_query(text)
        if not calls or calls[0][0] not in ("SecondOrder", "Vset", "Community", "WCC", "SCC", "BFS"):
            raise ValueError("a query starts with g.SecondOrder(), g.Vset(), g.Community(), g.WCC(), g.SCC() or g.BFS(id)")
        query = getattr(self, calls[0][0])(*calls[0][1])
        for name, args in calls[1:]:
            if name not in ("exist", "forall", "filter", "having", "execute", "executeForWeb"):
                raise ValueError(f"{name!r} is not known")
            query = getattr(query, name)(*args)
        return query if isinstance(query, DataFrame) else query.execute()
