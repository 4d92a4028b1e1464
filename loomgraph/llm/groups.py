"""Consolidating pairwise matches into groups on a two-dimensional grid of vertex blocks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import lookup
from loomgraph.storage import materialize, release

#: Edges a worker holds before it folds them into its union-find forest.
_FOLD = 1 << 20


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges ``a-b`` and the smallest vertex of its component."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    x, y = codes[: len(a)], codes[len(a) :]
    while len(x):
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return ids, ids[parent]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one grid cell; only the forest stays in memory."""
    none = np.zeros(0, np.int64)
    v, rep, held, size = none, none, [], 0

    def fold():
        return union(np.concatenate([v, *[h[0] for h in held]]), np.concatenate([rep, *[h[1] for h in held]]))

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size >= _FOLD:
            v, rep = fold()
            held, size = [], 0
    if held:
        v, rep = fold()
    for at in range(0, len(v), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 50_000]), pa.array(rep[at : at + 50_000])], names=["v", "rep"])


def _grid(edges: DataFrame, n: int, edges_per_cell: int) -> DataFrame:
    """Edges laid out by (row block of ``a``, column block of ``b``), one partition a cell, and at most about 40,000 cells."""
    side = max(1, ceil(sqrt(n / max(edges_per_cell, n // 40_000))))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    return edges.select("a", "b").repartitionById(side * side, block("a") * side + block("b"))


def _to_roots(parents: DataFrame) -> DataFrame:
    """``(v, p)`` with every ``p`` a root, by pointer doubling; roots point to themselves.

    Only parents that have a parent themselves are looked up, and vertices that share a parent ask salted copies of it.
    """
    while True:
        children = parents.where("v <> p")
        inner = children.select(F.col("p").alias("m")).distinct().join(children.select(F.col("v").alias("m"), F.col("p").alias("up")), "m")
        inner = materialize(inner, "inner")
        if inner.isEmpty():
            release(parents.sparkSession, inner)
            return parents
        moved = lookup(parents, inner.withColumnRenamed("m", "p"), "p").select("v", F.coalesce("up", "p").alias("p"))
        moved = materialize(moved, "parents")
        release(parents.sparkSession, parents)
        release(parents.sparkSession, inner)
        parents = moved


def connected_groups(pairs: DataFrame, left: str, right: str, edges_per_cell: int = 1 << 15) -> DataFrame:
    """``(vertex, group_id)``: every vertex of a pair and the smallest vertex it is linked to, directly or in chains.

    Ends are LONG. Pairs with a null end link nothing and name no vertex; a pair of a vertex with itself makes a
    group of one; repeated and reversed pairs are one link. No pairs give no rows.

    Each round lays the links out on a grid of vertex blocks and runs union-find inside every cell. The row and
    column cells of a vertex then exchange their representatives: the smallest becomes its parent, and the others are
    linked to that parent in the next, much smaller round, which sees only roots. Rounds end when no cell disagrees.
    A vertex with a third of all links is spread over the cells of its row. Nothing is collected to the driver.
    """
    spark = pairs.sparkSession
    both = pairs.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).where(F.col("l").isNotNull() & F.col("r").isNotNull())
    links = materialize(both.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct(), "links")
    levels: list[DataFrame] = []
    while True:
        n = links.count()
        if not n and levels:
            break
        local = _grid(links, n, edges_per_cell).mapInArrow(_cells, "v long, rep long")
        # a vertex has at most one representative per cell of its row and column
        reps = materialize(local.groupBy("v").agg(F.array_sort(F.collect_set("rep")).alias("reps")), "reps")
        release(spark, links)
        roots = _to_roots(materialize(reps.select("v", F.col("reps")[0].alias("p")), "parents"))
        levels.append(roots)
        apart = reps.where(F.size("reps") > 1).select("v", F.col("reps")[0].alias("a"), F.explode(F.slice("reps", 2, 1 << 30)).alias("b")).where("b <> v").select("a", "b")
        apart = apart.distinct()
        ends = materialize(roots.join(apart.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", "left_semi"), "ends")
        for side in "ab":  # a representative may be that of countless cells
            apart = lookup(apart, ends.select(F.col("v").alias(side), F.col("p").alias(side + "p")), side, "inner")
        apart = apart.select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).where("a <> b").distinct()
        links = materialize(apart, "links")
        release(spark, reps)
        release(spark, ends)
    release(spark, links)
    moves = None  # later levels first: each is much smaller than the one before it
    for roots in reversed(levels[1:]):
        if moves is not None:
            roots = lookup(roots, moves, "p").select("v", F.coalesce("up", "p").alias("p"))
        moves = materialize(roots.where("v <> p").select(F.col("v").alias("p"), F.col("p").alias("up")), "moves")
    out = levels[0].select("v", "p")
    if moves is not None:
        out = lookup(out, moves, "p").select("v", F.coalesce("up", "p").alias("p"))
    return out.select(F.col("v").alias("vertex"), F.col("p").alias("group_id"))


def same_rows(properties: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows of an edge table whose label, without outer spaces and in lower case, states that both ends are the same."""
    label = F.col("label") if label is None else label
    return properties.where(F.lower(F.trim(label)) == "same_as")
