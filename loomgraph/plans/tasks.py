"""Graph tasks by name, with their arguments as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators import algorithms as A


def _analysis(graph: PropertyGraph) -> DataFrame:
    return A.boundary_vertices(graph).agg(F.countDistinct("vid").alias("n_boundary"))


#: Task -> what it runs, and how many vertex ids it takes.
TASKS = {
    "bfs": (lambda g, start: A.bfs(g, start).select("vid", "distance"), 1),
    "wcc": (lambda g: A.wcc(g), 0),
    "wccn": (lambda g: A.component_stats(A.wcc(A.quotient(g))), 0),
    "scc": (lambda g: A.scc(g), 0),
    "analysis": (_analysis, 0),
    "path": (lambda g, source, target: A.shortest_path(g, source, target), 2),
}


def run_task(graph: PropertyGraph, text: str) -> DataFrame:
    """``"bfs 3"``, ``"wcc"``, ``"wccn"``, ``"scc"``, ``"analysis"`` or ``"path 0 10"``. Others, and wrong arguments, raise ValueError."""
    name, *args = text.split() or [""]
    if name not in TASKS:
        raise ValueError(f"the task {name!r} is not supported; known are {', '.join(TASKS)}")
    task, n = TASKS[name]
    if len(args) != n or not all(a.lstrip("-").isdigit() for a in args):
        raise ValueError(f"{name} takes {n} vertex ids")
    return task(graph, *map(int, args))
