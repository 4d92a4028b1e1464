"""Graph kernels that finish inside one executor task, for edge lists of a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Csr:
    """Dense codes for the vertices of an edge list, and neighbours grouped by source."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, extra: np.ndarray | None = None):
        own = [src, dst] if extra is None else [src, dst, extra]
        self.ids, codes = np.unique(np.concatenate(own), return_inverse=True)
        self.src, self.dst = codes[: len(src)], codes[len(src) : 2 * len(src)]
        order = np.lexsort((self.dst, self.src))
        self.neighbours = self.dst[order]
        self.offsets = np.searchsorted(self.src[order], np.arange(len(self.ids) + 1))
        self.steps = None

    def code(self, vid: int) -> int:
        at = int(np.searchsorted(self.ids, vid))
        return at if at < len(self.ids) and self.ids[at] == vid else -1

    def codes(self, vids: np.ndarray) -> np.ndarray:
        """The code of each of ``vids``, or -1."""
        if not len(self.ids):
            return np.full(len(vids), -1)
        at = np.minimum(np.searchsorted(self.ids, vids), len(self.ids) - 1)
        return np.where(self.ids[at] == vids, at, -1)

    def expand(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of all edges that leave the frontier."""
        first = self.offsets[frontier]
        count = self.offsets[frontier + 1] - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(frontier, count), self.neighbours[at]

    def bfs(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, distance, parent code) of what ``start`` reaches, itself with parent -1."""
        distance = np.full(len(self.ids), -1)
        parent = np.full(len(self.ids), -1)
        distance[start], frontier, level = 0, np.array([start]), 0
        while len(frontier):
            level += 1
            a, b = self.expand(frontier)
            new = distance[b] < 0
            a, b = a[new], b[new]
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            frontier, at = np.unique(b, return_index=True)
            distance[frontier], parent[frontier] = level, a[at]
        found = np.flatnonzero(distance >= 0)
        return found, distance[found], parent[found]

    def components(self) -> np.ndarray:
        """The smallest code that is weakly connected to each code."""
        parent = np.arange(len(self.ids))
        x, y = self.src, self.dst
        while len(x):
            x, y = parent[x], parent[y]
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
        return parent

    def strong_components(self) -> np.ndarray:
        """The smallest code of each code's strongly connected component: one depth-first search with an explicit stack."""
        n = len(self.ids)
        offsets, neighbours = self.offsets.tolist(), self.neighbours.tolist()
        index, low, out = [-1] * n, [0] * n, [-1] * n
        at, stack, count = offsets[:-1], [], 0
        for root in range(n):
            if index[root] >= 0:
                continue
            work = [root]
            while work:
                v = work[-1]
                if index[v] < 0:
                    index[v] = low[v] = count
                    count += 1
                    stack.append(v)
                if at[v] < offsets[v + 1]:
                    w = neighbours[at[v]]
                    at[v] += 1
                    if index[w] < 0:
                        work.append(w)
                    elif out[w] < 0:
                        low[v] = min(low[v], index[w])
                    continue
                work.pop()
                if work:
                    low[work[-1]] = min(low[work[-1]], low[v])
                if low[v] == index[v]:
                    cut = len(stack) - 1
                    while stack[cut] != v:
                        cut -= 1
                    least = min(stack[cut:])
                    for w in stack[cut:]:
                        out[w] = least
                    del stack[cut:]
        return np.array(out, np.int64)

    def levels(self) -> np.ndarray:
        """Longest distance from a source of an acyclic graph."""
        level = np.zeros(len(self.ids), np.int64)
        waiting = np.bincount(self.dst, minlength=len(self.ids))
        frontier = np.flatnonzero(waiting == 0)
        while len(frontier):
            a, b = self.expand(frontier)
            np.maximum.at(level, b, level[a] + 1)
            np.subtract.at(waiting, b, 1)
            frontier = np.unique(b[waiting[b] == 0])
        return level

    def reached(self, starts: np.ndarray) -> np.ndarray:
        """Of an acyclic graph: bit i of a code's mask is set if ``starts[i]``, one of at most 64 codes, reaches it. Every edge is passed once."""
        if self.steps is None:  # edges by the level of their end, then by their end
            level = self.levels()[self.dst]
            order = np.lexsort((self.dst, level))
            dst = self.dst[order]
            heads = np.flatnonzero(np.diff(dst, prepend=-1))
            level = level[order][heads]
            self.steps = self.src[order], dst[heads], np.append(heads, len(dst)), [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(heads)]
        mask, known = np.zeros(len(self.ids), np.uint64), starts >= 0
        np.bitwise_or.at(mask, starts[known], np.uint64(1) << np.flatnonzero(known).astype(np.uint64))
        src, ends, heads, cuts = self.steps
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                mask[ends[lo:hi]] |= np.bitwise_or.reduceat(mask[src[heads[lo] : heads[hi]]], heads[lo:hi] - heads[lo])
        return mask


def forests(edges: DataFrame) -> DataFrame:
    """``(u, v)`` with u > v: every task's edges contracted to stars around the smallest vertex of each of its components.

    Edges are folded into the forest a million at a time, so a task holds its vertices, not its edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        u, v, held, size = none, none, [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            csr = Csr(*(np.concatenate([own, *[h[i] for h in held]]) for i, own in enumerate((u, v))))
            root = csr.ids[csr.components()]
            return csr.ids[root < csr.ids], root[root < csr.ids]

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= 1 << 20:
                u, v = fold()
                held, size = [], 0
        if held:
            u, v = fold()
        for at in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_pydict({"u": u[at : at + 50_000], "v": v[at : at + 50_000]})

    return edges.select("src", "dst").mapInArrow(run, "u long, v long")


def for_each_start(edges: DataFrame, starts: DataFrame, tasks: int, kernel: Callable[[Csr, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Run ``kernel(csr, start)`` for every vertex of ``starts (vid)``, spread over ``tasks`` tasks, each of which holds all edges.

    The caller has checked the number of edges. Starts stream through a task, so it holds the result of one at a time. Starts that
    no edge has are known to the ``Csr``, too.
    """
    none = F.lit(None).cast("long")
    copies = edges.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    asked = starts.select(F.pmod(F.xxhash64("vid"), F.lit(tasks)).cast("int").alias("task"), F.lit(1).alias("kind"), F.col("vid").alias("a"), none.alias("b"))
    rows = copies.unionByName(asked).repartitionById(tasks, F.col("task")).sortWithinPartitions("kind").select("kind", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, csr = [], None
        for batch in batches:
            kind, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut:
                held.append((a[:cut], batch.column(2).slice(0, cut).to_numpy()))
            for start in a[cut:].tolist():
                if csr is None:
                    ends = [np.concatenate([np.zeros(0, np.int64), *[h[i] for h in held]]) for i in (0, 1)]
                    csr, held = Csr(*ends), []
                whole = pa.RecordBatch.from_pydict(kernel(csr, start))
                for at in range(0, whole.num_rows, 50_000):
                    yield whole.slice(at, 50_000)

    return rows.mapInArrow(run, schema)


def in_groups(edges: DataFrame, asked: DataFrame, tasks: int, kernel: Callable[..., dict[str, np.ndarray]], schema: str, weights: DataFrame | None = None, held_rows: int = 1 << 20) -> DataFrame:
    """Run ``kernel(csr, weight, keys, which, b)`` over all rows of ``asked (a, b)``, for at most 64 ``keys`` at a time, spread over ``tasks`` tasks by ``a``.

    ``keys`` are different values of ``a``, and ``which`` says for every ``b`` whose it is. Each task holds all edges, whose number the caller has
    checked, and the rows of ``weights (vid, weight)``, as ``weight`` by code; of ``asked`` it holds ``held_rows`` and a batch.
    """
    def copied(df: DataFrame, kind: int) -> DataFrame:
        return df.toDF("a", "b").select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(kind).alias("kind"), "a", "b")

    rows = copied(edges.select("src", "dst"), 0)
    if weights is not None:
        rows = rows.unionByName(copied(weights.select("vid", "weight"), 1))
    rows = rows.unionByName(asked.select(F.pmod(F.xxhash64("a"), F.lit(tasks)).cast("int").alias("task"), F.lit(2).alias("kind"), "a", "b"))
    rows = rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("kind", "a").select("kind", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, csr, weight = {0: [], 1: [], 2: []}, None, None

        def whole(kind: int) -> list[np.ndarray]:
            none = np.zeros(0, np.int64)
            parts, held[kind] = held[kind], []
            return [np.concatenate([none, *[p[i] for p in parts]]) for i in (0, 1)]

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal csr, weight
            if csr is None:
                (src, dst), (vid, w) = whole(0), whole(1)
                csr = Csr(src, dst, vid)
                weight = np.zeros(len(csr.ids), np.int64)
                weight[csr.codes(vid)] = w
            a, b = whole(2)
            for first in range(0, len(keys := np.unique(a)), 64):
                group = keys[first : first + 64]
                lo, hi = np.searchsorted(a, group[0]), np.searchsorted(a, group[-1], "right")
                out = pa.RecordBatch.from_pydict(kernel(csr, weight, group, np.searchsorted(group, a[lo:hi]), b[lo:hi]))
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

        for batch in batches:
            kind, a, b = (c.to_numpy() for c in batch.columns)
            cuts = np.searchsorted(kind, [0, 1, 2, 3])
            for k in (0, 1, 2):
                if cuts[k] < cuts[k + 1]:
                    held[k].append((a[cuts[k] : cuts[k + 1]], b[cuts[k] : cuts[k + 1]]))
            if sum(len(p[0]) for p in held[2]) >= held_rows:
                yield from answers()
        if held[2]:
            yield from answers()

    return rows.mapInArrow(run, schema)


def in_one_task(edges: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Run ``kernel(src, dst)`` over all edges in one task. The caller has checked their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        none = np.zeros(0, np.int64)
        out = kernel(*(np.concatenate([none, *[h[i] for h in held]]) for i in (0, 1)))
        whole = pa.RecordBatch.from_pydict(out)
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, schema)
