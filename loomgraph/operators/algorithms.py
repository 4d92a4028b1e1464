"""Breadth-first search, components, condensation, paths, communities and their boundaries.

Each iterative algorithm has one definition and two executions: an edge list of at most ``local_edges`` edges (by default that of
the graph's options) is finished by a vectorised kernel in one executor task; a larger one runs in distributed rounds, with each round's
state written to the shared folder and hub vertices spread over salts. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators.local import Csr, for_each_start, forests, in_groups, in_one_task
from loomgraph.operators.skew import Spread, lookup
from loomgraph.operators.sweep import running_totals
from loomgraph.storage import Grown, materialize, n_rows, release, width


def _bound(graph: PropertyGraph, local_edges: int | None) -> int:
    return graph.options.local_edges if local_edges is None else local_edges


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    e = edges.select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": e, "in": back, "both": e.unionByName(back).distinct()}[direction]


def _frontiers(edges: DataFrame, begin: DataFrame, most: int = 8) -> Grown:
    """The parts ``(origin, vid, distance, parent)`` of a search from ``begin (origin, vid)``; the last part is empty.

    With ``most`` above the depth, every part holds one distance. Edges with a column ``origin`` are those of that origin alone.
    """
    own = ["origin", "src"] if "origin" in edges.columns else ["src"]
    out = Spread(edges, own)
    none = F.lit(None).cast("long")
    seen = Grown("reached", most)
    frontier, level = seen.add(begin.select("origin", "vid", F.lit(0).cast("long").alias("distance"), none.alias("parent"))), 0
    while n_rows(frontier):
        level += 1
        step = out.join(frontier.select("origin", F.col("vid").alias("src"))).groupBy("origin", F.col("dst").alias("vid")).agg(F.min("src").alias("parent"))
        step = step.join(seen.frame().select("origin", "vid"), ["origin", "vid"], "left_anti")
        frontier = seen.add(step.select("origin", "vid", F.lit(level).cast("long").alias("distance"), "parent"))
    out.release()
    return seen


def bfs(graph: PropertyGraph, starts: int | Iterable[int] | DataFrame, direction: str = "out", community: int | None = None, local_edges: int | None = None) -> DataFrame:
    """``(origin, vid, distance, parent)``: what each start reaches in hops, itself at 0 with a null parent.

    ``parent`` is the smallest vertex one hop nearer. ``community`` restricts the search to one community. A start that
    is no vertex (of the community) reaches nothing. ``starts`` may also be a frame ``(vid)`` of any size: over at most ``local_edges``
    edges they are spread over tasks that each hold the graph, else all are searched at once in distributed rounds.
    """
    spark = graph.spark
    inside = graph.vertices.where(F.col("community") == community) if community is not None else graph.vertices
    edges = _oriented(graph.edges, direction)
    if community is not None:
        m = inside.select("vid")
        edges = edges.join(m.withColumnRenamed("vid", "src"), "src", "left_semi").join(m.withColumnRenamed("vid", "dst"), "dst", "left_semi")
    schema = "origin long, vid long, distance long, parent long"
    many = isinstance(starts, DataFrame)
    if many:
        begin = starts.select("vid").distinct().join(inside.select("vid"), "vid", "left_semi")
    else:
        wanted = sorted({int(s) for s in ([starts] if isinstance(starts, int) else starts)})
        known = [r["vid"] for r in inside.where(F.col("vid").isin(wanted)).select("vid").collect()]
        if not known:
            return spark.createDataFrame([], schema)
        begin = spark.createDataFrame([(k,) for k in known], "vid long")
    small = edges.count() <= _bound(graph, local_edges)
    if small and many:
        def search(csr: Csr, start: int) -> dict:
            at = csr.code(start)
            if at < 0:
                return {"origin": [start], "vid": [start], "distance": [0], "parent": pa.array([None], pa.int64())}
            code, distance, parent = csr.bfs(at)
            return {"origin": np.full(len(code), start), "vid": csr.ids[code], "distance": distance, "parent": pa.array(csr.ids[parent], mask=parent < 0)}

        begin = materialize(begin, "starts")
        return for_each_start(edges, begin, max(min(width(spark), n_rows(begin)), -(-n_rows(begin) // 1000), 1), search, schema)
    if small:
        def kernel(src: np.ndarray, dst: np.ndarray) -> dict:
            csr, parts = Csr(src, dst, np.array(known, np.int64)), []
            for s in known:
                code, distance, parent = csr.bfs(csr.code(s))
                parts.append((np.full(len(code), s), csr.ids[code], distance, np.where(parent < 0, np.iinfo(np.int64).min, csr.ids[parent])))
            return dict(zip(("origin", "vid", "distance", "parent"), map(np.concatenate, zip(*parts))))

        return in_one_task(edges, kernel, schema).withColumn("parent", F.when(F.col("distance") > 0, F.col("parent")))
    return _frontiers(edges, begin.select(F.col("vid").alias("origin"), "vid")).frame()


def bfs_samples(graph: PropertyGraph, starts: DataFrame, local_edges: int | None = None, depth: bool = True) -> DataFrame:
    """One row ``(samples, least, most, average, depth)``: how many vertices the searches from ``starts (vid)`` visit, and the farthest hop.

    All searches run at once. A start that is no vertex is no sample. Only ``depth`` needs the distances of every search; without it
    vertices are counted by :func:`reach_counts`.
    """
    if depth:
        found = bfs(graph, starts, local_edges=local_edges).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    else:
        found = reach_counts(graph, starts, local_edges)
    return found.agg(F.count(F.lit(1)).alias("samples"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("average"), *[F.max("d").alias("depth")] * depth)


def reach_counts(graph: PropertyGraph, starts: DataFrame, local_edges: int | None = None) -> DataFrame:
    """``(origin, n)``: how many vertices each of ``starts (vid)`` reaches, itself included. A start that is no vertex is left out.

    Vertices of one strong component reach the same, so each component of a start is searched once on the component graph, where
    components count with their size: over at most ``local_edges`` edges 64 at once pass every edge once, else in distributed rounds.
    """
    parts = materialize(scc(graph, local_edges), "scc")
    dag = written(condensed(graph, parts))
    begin = materialize(starts.select(F.col("vid").alias("origin")).distinct().join(parts.toDF("origin", "component"), "origin"), "starts")
    keys = materialize(begin.select("component").distinct(), "keys")
    weights = parts.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    if n_rows(dag.edges) <= _bound(graph, local_edges):
        def kernel(csr: Csr, weight: np.ndarray, keys: np.ndarray, *_: np.ndarray) -> dict:
            mask = csr.reached(csr.codes(keys))
            at = np.flatnonzero(mask)
            mask, weight = mask[at], weight[at]
            return {"component": keys, "n": np.array([weight[(mask >> np.uint64(i)) & np.uint64(1) == 1].sum() for i in range(len(keys))], np.int64)}

        tasks = max(1, min(width(graph.spark), -(-n_rows(keys) // 64)))
        counts = in_groups(dag.edges, keys.select(F.col("component").alias("a"), F.lit(0).cast("long").alias("b")), tasks, kernel, "component long, n long", weights.select(F.col("component").alias("vid"), "weight"))
    else:
        found = bfs(dag, keys.select(F.col("component").alias("vid")), local_edges=local_edges).select(F.col("origin").alias("key"), F.col("vid").alias("component"))
        counts = found.join(weights, "component").groupBy(F.col("key").alias("component")).agg(F.sum("weight").alias("n"))
    return lookup(begin, materialize(counts, "counts"), "component", "inner").select("origin", "n")


def _stars(edges: DataFrame) -> DataFrame:
    """``(vid, component)`` by alternating large and small stars until nothing moves; only linked vertices come out.

    Every task first contracts its edges to a forest. Neighbours of a hub are looked up by salted copies of its row.
    """
    spark = edges.sparkSession
    state = materialize(forests(edges).distinct(), "stars")

    def star(rows: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = materialize(least, "least")
        return lookup(rows, least, "u", "inner", counts="n_rows"), least

    last = None
    while True:
        both = state.select("u", "v").union(state.select(F.col("v"), F.col("u"))).toDF("u", "n")
        large, a = star(both.where("n > u"), both.groupBy("u").agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("n_rows")).select("u", F.least("u", "m").alias("m"), "n_rows"))
        large = materialize(large.select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small, b = star(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_rows")))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        small = materialize(small.where("u <> v").distinct(), "stars")
        mark = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in (large, state, a, b):
            release(spark, old)
        state = small
        if mark == last:
            break
        last = mark
    roots = state.select(F.col("v").alias("vid")).distinct().withColumn("component", F.col("vid"))
    return state.select(F.col("u").alias("vid"), F.col("v").alias("component")).unionByName(roots)


def wcc(graph: PropertyGraph, local_edges: int | None = None) -> DataFrame:
    """``(vid, component)``: ``component`` is the smallest vertex weakly connected to ``vid``; isolated vertices are their own."""
    edges = graph.edges.select("src", "dst")
    if edges.count() <= _bound(graph, local_edges):
        def kernel(src: np.ndarray, dst: np.ndarray) -> dict:
            csr = Csr(src, dst)
            return {"vid": csr.ids, "component": csr.ids[csr.components()]}

        linked = in_one_task(edges, kernel, "vid long, component long")
    else:
        linked = _stars(edges)
    return graph.vertices.select("vid").join(linked, "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))


def numbered(parts: DataFrame) -> DataFrame:
    """``(vid, component_id)``: components numbered from 0 in the order of their smallest vertex, without one global sort."""
    roots = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(1).cast("long").alias("one"))
    ranks = running_totals(roots, None, ["component"], ["one"]).select("component", "n_rows", (F.col("run_one") - 1).alias("component_id"))
    return lookup(parts, materialize(ranks, "ranks"), "component", "inner", counts="n_rows").select("vid", "component_id")


def _between(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges with ``a`` and ``b``, the ``mark`` of their ends in ``marks (vid, mark, n_out, n_in)``; edges of unmarked ends go."""
    for side, name, n in (("src", "a", "n_out"), ("dst", "b", "n_in")):
        edges = lookup(edges, marks.select(F.col("vid").alias(side), F.col("mark").alias(name), F.col(n).alias("_n")), side, "inner", counts="_n").drop("_n")
    return edges


def _degrees(edges: DataFrame) -> DataFrame:
    """``(vid, n_out, n_in)`` of the ends of edges."""
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), one.alias("o"), no.alias("i")), F.struct(F.col("dst").alias("vid"), no.alias("o"), one.alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("vid").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def _around(edges: DataFrame, pivot: int) -> DataFrame:
    """``(vid, ways)`` of what ``pivot`` reaches (1) and of what reaches it (2), or both (3); both searches share their rounds."""
    ways = [_oriented(edges, way).withColumn("origin", F.lit(k).cast("long")) for k, way in ((1, "out"), (2, "in"))]
    begin = edges.sparkSession.createDataFrame([(1, pivot), (2, pivot)], "origin long, vid long")
    found = _frontiers(ways[0].unionByName(ways[1]), begin)
    return found.frame().groupBy("vid").agg(F.sum("origin").cast("int").alias("ways"))


def _colours(edges: DataFrame) -> DataFrame:
    """``(vid, c)``: the smallest vertex that reaches each end of an edge; only vertices whose colour moved push it on."""
    spark, out = edges.sparkSession, Spread(edges, "src")
    colour = materialize(edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct().withColumn("c", F.col("vid")), "colour")
    moved = colour
    while True:
        pushed = out.join(moved.withColumnRenamed("vid", "src")).groupBy(F.col("dst").alias("vid")).agg(F.min("c").alias("new"))
        moved = materialize(pushed.join(colour, "vid").where("new < c").select("vid", F.col("new").alias("c")), "moved")
        if not n_rows(moved):
            out.release()
            return colour
        changed = colour.join(moved.withColumnRenamed("c", "new"), "vid", "left").select("vid", F.coalesce("new", "c").alias("c"))
        changed = materialize(changed, "colour")
        release(spark, colour)
        colour = changed


def _peel(edges: DataFrame, done: Grown, bound: int) -> DataFrame:
    """Two peelings of strong components, added to ``done (vid, component)``; the edges that may lie inside others are left.

    First that of the vertex with most edges both ways: what it reaches and is reached from. No other component crosses the
    classes "only reached", "only reaching" and "neither". Then vertices are coloured by the smallest vertex that reaches them, and
    what reaches the colour's own vertex inside its colour is a component; none crosses colours. At ``bound`` edges it stops.
    """
    degrees = materialize(_degrees(edges), "degrees")
    pivot = degrees.orderBy(F.desc(F.col("n_out") * F.col("n_in")), "vid").first()["vid"]
    marks = degrees.join(_around(edges, pivot), "vid", "left")
    marks = materialize(marks.select("vid", "n_out", "n_in", F.coalesce("ways", F.lit(0)).alias("mark")), "marks")
    core = marks.where("mark = 3").select("vid")
    done.add(core.join(F.broadcast(core.agg(F.min("vid").alias("component")))))  # one row
    edges = materialize(_between(edges, marks).where("a = b AND a <> 3").select("src", "dst"), "rest")
    if n_rows(edges) <= bound:
        return edges
    colour = _colours(edges)
    marks = materialize(colour.join(_degrees(edges), "vid").select("vid", F.col("c").alias("mark"), "n_out", "n_in"), "marks")
    own = materialize(_between(edges, marks).where("a = b").select("src", "dst"), "own")
    roots = colour.where("vid = c").select(F.col("c").alias("origin"), "vid")
    found = done.add(_frontiers(_oriented(own, "in"), roots).frame().select("vid", F.col("origin").alias("component")))
    left = materialize(marks.join(found.select("vid"), "vid", "left_anti"), "left")
    return materialize(_between(own, left).select("src", "dst"), "rest")


def _trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Without edges into vertices that lead nowhere and out of vertices that nothing leads to, which are components of their own."""
    for _ in range(rounds):
        degrees = _degrees(edges).where("n_out > 0 AND n_in > 0").withColumn("mark", F.lit(0))
        edges = materialize(_between(edges, materialize(degrees, "degrees")).select("src", "dst"), "rest")
    return edges


def scc(graph: PropertyGraph, local_edges: int | None = None) -> DataFrame:
    """``(vid, component)``: ``component`` is the smallest vertex that ``vid`` reaches and is reached from.

    Above ``local_edges`` edges, vertices without an edge in or out are trimmed, and components peeled off until the rest fits one task.
    """
    bound, done = _bound(graph, local_edges), Grown("components")
    rest = graph.edges.select("src", "dst").where("src <> dst")
    if rest.count() > bound:
        rest = _trimmed(materialize(rest, "rest"))
    while (n := n_rows(rest)) > bound:
        rest = _peel(rest, done, bound)

    def kernel(src: np.ndarray, dst: np.ndarray) -> dict:
        csr = Csr(src, dst)
        return {"vid": csr.ids, "component": csr.ids[csr.strong_components()]}

    parts = [in_one_task(rest, kernel, "vid long, component long")] if n else []
    parts += [done.frame()] if done.parts else []
    if not parts:
        return graph.vertices.select("vid", F.col("vid").alias("component"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return graph.vertices.select("vid").join(found, "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))


def component_stats(parts: DataFrame) -> DataFrame:
    """One row: number of components, largest, smallest and average size."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.round(F.avg("n"), 6).alias("average"))


# -- condensation ---------------------------------------------------------------------------------------------------------


def condensation(graph: PropertyGraph, parts: DataFrame) -> DataFrame:
    """``(src, dst)`` between different components of ``parts (vid, component)``, each pair once."""
    a = parts.select(F.col("vid").alias("src"), F.col("component").alias("a"))
    b = parts.select(F.col("vid").alias("dst"), F.col("component").alias("b"))
    return graph.edges.select("src", "dst").join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def condensed(graph: PropertyGraph, parts: DataFrame) -> PropertyGraph:
    """The component graph: a vertex per component."""
    return graph.with_(parts.select(F.col("component").alias("vid")).distinct(), condensation(graph, parts))


def written(graph: PropertyGraph) -> PropertyGraph:
    """The graph read back from the shared folder: what made it is not computed again."""
    return graph.with_(materialize(graph.vertices, "vertices"), materialize(graph.edges, "edges"))


def levels(dag: PropertyGraph, local_edges: int | None = None) -> DataFrame:
    """``(vid, level)``: longest distance from a vertex without incoming edges. The graph must be acyclic."""
    edges = dag.edges.select("src", "dst")
    if edges.count() <= _bound(dag, local_edges):
        def kernel(src: np.ndarray, dst: np.ndarray) -> dict:
            csr = Csr(src, dst)
            return {"vid": csr.ids, "level": csr.levels()}

        linked = in_one_task(edges, kernel, "vid long, level long")
    else:
        rest, level, done = materialize(edges, "rest"), 0, Grown("levels")
        while n_rows(rest):  # peel the sources; what then has no edge left lies one level below
            degrees = materialize(_degrees(rest), "degrees")
            heads = degrees.where("n_in = 0")
            if heads.isEmpty():
                raise ValueError("the graph has a cycle")
            marks = degrees.where("n_in > 0")
            kept = lookup(rest, marks.select(F.col("vid").alias("src"), "n_out"), "src", "inner", counts="n_out")
            kept = materialize(kept.select("src", "dst"), "rest")
            ends = kept.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
            last = marks.select("vid").join(ends, "vid", "left_anti").withColumn("level", F.lit(level + 1).cast("long"))
            done.add(heads.select("vid", F.lit(level).cast("long").alias("level")).unionByName(last))
            for old in (rest, degrees):
                release(dag.spark, old)
            rest, level = kept, level + 1
        linked = done.frame()
    return dag.vertices.select("vid").join(linked, "vid", "left").select("vid", F.coalesce("level", F.lit(0).cast("long")).alias("level"))


def dag_stats(dag: PropertyGraph) -> DataFrame:
    """One row: vertices, edges, levels, the widest level, largest degrees."""
    ranked = levels(dag).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    top = ranked.agg((F.max("level") + 1).alias("n_levels"), F.max("n").alias("widest"))
    degree = dag.degrees().agg(F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"))
    return dag.counts().join(top).join(degree)  # four one-row aggregates side by side


def reachable(graph: PropertyGraph, pairs: Iterable[tuple[int, int]] | DataFrame, local_edges: int | None = None) -> DataFrame:
    """``(src, dst, reachable)`` for the given pairs of vertices, with the reflexive pair reachable.

    Pairs in one component are; pairs whose source lies on a later level than the target are not; the others are searched
    on the component graph, from whichever side has fewer components: over at most ``local_edges`` edges 64 at once pass every edge
    once, and only answers to asked pairs leave the task; else all in distributed rounds. A pair with an unknown vertex is not.
    ``pairs`` may also be a frame ``(src, dst)`` of any size.
    """
    spark = graph.spark
    many = isinstance(pairs, DataFrame)
    asked = pairs.select("src", "dst").distinct() if many else spark.createDataFrame(sorted({(int(a), int(b)) for a, b in pairs}), "src long, dst long")
    parts = materialize(scc(graph, local_edges), "scc")
    dag = written(condensed(graph, parts))
    ranks = levels(dag, local_edges)
    where = materialize(parts.join(ranks.withColumnRenamed("vid", "component"), "component").select("component", "vid", "level"), "places")
    asked = asked.join(where.toDF("sa", "src", "la"), "src", "left").join(where.toDF("sb", "dst", "lb"), "dst", "left")
    asked = materialize(asked.select("src", "dst", "sa", "sb", F.coalesce(F.expr("sa <> sb AND la < lb"), F.lit(False)).alias("open")), "asked")
    open_pairs = materialize(asked.where("open").select("sa", "sb").distinct(), "open")
    n = open_pairs.agg(F.countDistinct("sa").alias("sa"), F.countDistinct("sb").alias("sb")).first()
    key, other, way = ("sa", "sb", "out") if n["sa"] <= n["sb"] else ("sb", "sa", "in")
    if n_rows(dag.edges) <= _bound(graph, local_edges):
        def kernel(csr: Csr, _: np.ndarray, keys: np.ndarray, which: np.ndarray, b: np.ndarray) -> dict:
            mask, at = csr.reached(csr.codes(keys)), csr.codes(b)
            hit = at >= 0
            hit[hit] = (mask[at[hit]] >> which[hit].astype(np.uint64)) & np.uint64(1) == 1
            return {"a": keys[which[hit]], "b": b[hit]}

        tasks = max(1, min(width(spark), -(-n[key] // 64)))
        found = in_groups(_oriented(dag.edges, way), open_pairs.select(F.col(key).alias("a"), F.col(other).alias("b")), tasks, kernel, "a long, b long")
    else:
        found = bfs(dag, open_pairs.select(F.col(key).alias("vid")), way, local_edges=local_edges).select("origin", "vid")
    found = found.toDF(key, other).withColumn("hit", F.lit(True))
    return asked.join(found, ["sa", "sb"], "left").select("src", "dst", (F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)) | (F.col("open") & F.coalesce("hit", F.lit(False)))).alias("reachable"))


def closure(graph: PropertyGraph, sources: Iterable[int] | DataFrame, targets: DataFrame | None = None, local_edges: int | None = None) -> DataFrame:
    """``(src, dst)``: what each of ``sources`` reaches, itself included, kept to ``targets (vid)`` if given.

    ``sources`` may also be a frame ``(vid)`` of any size: its components are searched on the component graph, each once, and their
    members joined at the end.
    """
    if isinstance(sources, DataFrame):
        parts = materialize(scc(graph, local_edges), "scc")
        dag = written(condensed(graph, parts))
        begin = sources.select(F.col("vid").alias("src")).distinct().join(parts.toDF("src", "origin"), "src")
        found = bfs(dag, begin.select(F.col("origin").alias("vid")), local_edges=local_edges).select("origin", F.col("vid").alias("component"))
        ends = parts if targets is None else parts.join(targets.select("vid"), "vid", "left_semi")
        return begin.join(found, "origin").join(ends.select("component", F.col("vid").alias("dst")), "component").select("src", "dst")
    found = bfs(graph, sources, local_edges=local_edges).select(F.col("origin").alias("src"), F.col("vid").alias("dst"))
    return found if targets is None else found.join(targets.select(F.col("vid").alias("dst")), "dst", "left_semi").select("src", "dst")


def shortest_path(graph: PropertyGraph, source: int, target: int, local_edges: int | None = None) -> DataFrame:
    """``(position, vid)`` of a shortest path from ``source`` (0) to ``target``; no rows if there is none.

    Among shortest paths the one whose vertices, read from the target back, are smallest.
    """
    schema = "position long, vid long"
    spark = graph.spark
    both = {r["vid"] for r in graph.vertices.where(F.col("vid").isin([source, target])).select("vid").collect()}
    if not {source, target} <= both:
        return spark.createDataFrame([], schema)
    edges = graph.edges.select("src", "dst")
    if edges.count() <= _bound(graph, local_edges):
        def kernel(src: np.ndarray, dst: np.ndarray) -> dict:
            csr = Csr(src, dst, np.array([source, target], np.int64))
            code, _, parent = csr.bfs(csr.code(source))
            up, at, path = dict(zip(code.tolist(), parent.tolist())), csr.code(target), []
            while at in up:
                path.append(at)
                at = up[at]
            path = csr.ids[np.array(path[::-1], np.int64)]
            return {"position": np.arange(len(path)), "vid": path}

        return in_one_task(edges, kernel, schema)
    begin = spark.createDataFrame([(source, source)], "origin long, vid long")
    tree = _frontiers(edges, begin, most=1 << 30).parts  # one table a distance
    end = _frontier_of(tree, target)
    path, at = [], target
    for first in range(end, -1, -16):  # sixteen hops a job, each reading one distance's table
        row = spark.createDataFrame([(at,)], "v0 long")
        hops = range(first, max(-1, first - 16), -1)
        for k, d in enumerate(hops):
            row = row.join(tree[d].select(F.col("vid").alias(f"v{k}"), F.col("parent").alias(f"v{k + 1}")), f"v{k}")
        got = row.first()
        path += [got[f"v{k}"] for k in range(len(hops))]
        at = got[f"v{len(hops)}"]
    for old in tree:
        release(spark, old)
    return spark.createDataFrame(list(enumerate(path[::-1])), schema)


def _frontier_of(tree: list[DataFrame], target: int) -> int:
    """The distance at which ``target`` was reached, or -1: one job over all tables of a search."""
    hits = None
    for part in tree:
        one = part.where(F.col("vid") == target).select("distance")
        hits = one if hits is None else hits.unionByName(one)
    row = hits.first()
    return -1 if row is None else row["distance"]


def pruned_path(graph: PropertyGraph, source: int, target: int, local_edges: int | None = None) -> DataFrame:
    """As :func:`shortest_path`, searching only the components that lie on a way from the source's to the target's."""
    parts = materialize(scc(graph, local_edges), "scc")
    dag = written(condensed(graph, parts))
    ends = {r["vid"]: r["component"] for r in parts.where(F.col("vid").isin([source, target])).collect()}
    if not {source, target} <= set(ends):
        return graph.spark.createDataFrame([], "position long, vid long")
    ahead = bfs(dag, ends[source], local_edges=local_edges).select(F.col("vid").alias("component"))
    behind = bfs(dag, ends[target], "in", local_edges=local_edges).select(F.col("vid").alias("component"))
    near = parts.join(ahead, "component", "left_semi").join(behind, "component", "left_semi")
    return shortest_path(graph.induced(materialize(near.select("vid"), "near")), source, target, local_edges)


def dag_path(graph: PropertyGraph, parts: DataFrame, source: int, target: int, local_edges: int | None = None) -> DataFrame:
    """``(position, component)``: a shortest path of components of ``parts (vid, component)`` from one to another; no rows if there is none."""
    return shortest_path(condensed(graph, parts), source, target, local_edges).withColumnRenamed("vid", "component")


def dag_bfs(graph: PropertyGraph, parts: DataFrame, source: int, local_edges: int | None = None) -> DataFrame:
    """``(component, distance)``: the components that one reaches, in hops of the component graph."""
    return bfs(condensed(graph, parts), source, local_edges=local_edges).select(F.col("vid").alias("component"), "distance")


# -- communities ------------------------------------------------------------------------------------------------------------


def communities(graph: PropertyGraph) -> DataFrame:
    """``(vid, component)``: the stored community of every vertex that has one."""
    return graph.vertices.where("community IS NOT NULL").select("vid", F.col("community").cast("long").alias("component"))


def community_search(graph: PropertyGraph, vid: int) -> DataFrame:
    """``(vid)``: the members of a vertex's community, itself included."""
    own = graph.vertices.where((F.col("vid") == vid) & F.col("community").isNotNull()).select("community")
    return graph.vertices.join(own, "community", "left_semi").select("vid")


def cross_edges(graph: PropertyGraph) -> DataFrame:
    """``(src, dst, cu, cv)``: edges between different communities."""
    a = graph.vertices.select(F.col("vid").alias("src"), F.col("community").alias("cu"))
    b = graph.vertices.select(F.col("vid").alias("dst"), F.col("community").alias("cv"))
    return graph.edges.select("src", "dst").join(a, "src").join(b, "dst").where("cu <> cv").select("src", "dst", "cu", "cv")


def boundary_vertices(graph: PropertyGraph) -> DataFrame:
    """``(vid, community)``: ends of edges between communities."""
    cross = cross_edges(graph)
    return cross.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.col("cu").alias("community")), F.struct(F.col("dst").alias("vid"), F.col("cv").alias("community")))).alias("x")).select("x.*").distinct()


def boundary_pairs(graph: PropertyGraph) -> DataFrame:
    """``(cu, cv, n_edges)`` per ordered pair of linked communities."""
    return cross_edges(graph).groupBy("cu", "cv").agg(F.count(F.lit(1)).alias("n_edges"))


def quotient(graph: PropertyGraph) -> PropertyGraph:
    """A vertex per community, an edge per linked ordered pair."""
    v = graph.vertices.where("community IS NOT NULL").select(F.col("community").cast("long").alias("vid")).distinct()
    return graph.with_(v, cross_edges(graph).select(F.col("cu").cast("long").alias("src"), F.col("cv").cast("long").alias("dst")).distinct())


def boundary_bfs(graph: PropertyGraph, start: int) -> DataFrame:
    """BFS over the edges between communities only."""
    b = boundary_vertices(graph)
    return bfs(graph.with_(b.select("vid"), cross_edges(graph).select("src", "dst")), start)


def enriched_boundary(graph: PropertyGraph, local_edges: int | None = None) -> DataFrame:
    """``(kind, src, dst)``: the boundary between communities, and how its vertices reach each other within their own.

    ``cross``: an edge between communities. ``member``: a boundary vertex and its class, the smallest vertex of its strong component within its
    community. ``link``: two classes with an edge inside their community. A boundary vertex reaches another inside the
    community if and only if links lead from its class to that of the other, or the classes are one. The rows grow with vertices and edges,
    never with pairs of vertices that reach each other.
    """
    com = graph.vertices.select("vid", "community")
    a = graph.edges.select("src", "dst").join(com.toDF("src", "cu"), "src").join(com.toDF("dst", "cv"), "dst").where("cu = cv").select("src", "dst")
    inner = graph.with_(graph.vertices.select("vid"), materialize(a, "inside"))
    parts = materialize(scc(inner, local_edges), "scc")
    row = lambda kind, df: df.select(F.lit(kind).alias("kind"), "src", "dst")
    member = boundary_vertices(graph).select("vid").distinct().join(parts, "vid").toDF("src", "dst")
    return row("cross", cross_edges(graph)).unionByName(row("member", member)).unionByName(row("link", condensation(inner, parts)))
