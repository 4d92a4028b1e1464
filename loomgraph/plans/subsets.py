"""Enumeration of all vertex subsets for which a sentence holds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators.sweep import running_totals
from loomgraph.plans.language import variables
from loomgraph.plans.quantify import EXIST, FORALL, Relation, relation
from loomgraph.storage import materialize, n_rows

SCHEMA = "vids array<bigint>, size int"


def _largest(graph: PropertyGraph, having, n: int) -> int:
    """The largest set size up to ``n`` that ``having`` allows, or -1."""
    top = graph.spark.range(n + 1).select(F.col("id").cast("int").alias("size")).where(having).agg(F.max("size").alias("top")).first()["top"]
    return -1 if top is None else top


def _grown(graph: PropertyGraph, rel: Relation, x: str, y: str, having, top: int) -> DataFrame:
    """Sets in which every pair is compatible: grown level by level, each set carrying who may still join it."""
    spark, v = graph.spark, graph.vertices.select("vid")
    if rel.df is None:
        rows, positive = None, rel.positive
    else:
        pair = [F.col(c if c in rel.names else o) for c, o in ((x, y), (y, x))]
        rows, positive = rel.df.select(*[p.alias(a) for p, a in zip(pair, "ab")]), rel.positive
        if len(rel.names) == 1:  # one variable: a condition on single vertices
            single = rel.df.select(F.col(rel.names[0]).alias("vid"))
            v = v.join(single, "vid", "left_semi" if positive else "left_anti")
            rows, positive = None, False
    if rows is not None and positive:
        v = v.join(rows.where("a = b").select(F.col("a").alias("vid")), "vid", "left_semi")
        one_way = rows.where("a < b").select("a", "b")
        compat = one_way.join(rows.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
        compat = compat.join(v.withColumnRenamed("vid", "a"), "a", "left_semi").join(v.withColumnRenamed("vid", "b"), "b", "left_semi")
    elif rel.df is None and positive:
        v, compat = v.limit(0), spark.createDataFrame([], "a long, b long")
    else:
        if rows is not None:
            v = v.join(rows.where("a = b").select(F.col("a").alias("vid")), "vid", "left_anti")
        if v.count() > graph.options.max_pairs_of:
            raise ValueError(f"more than {graph.options.max_pairs_of} vertices satisfy the filter with almost every other")
        compat = v.withColumnRenamed("vid", "a").join(v.withColumnRenamed("vid", "b"), F.col("a") < F.col("b"))
        if rows is not None:
            wrong = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            compat = compat.join(wrong, ["a", "b"], "left_anti")
    none = F.array().cast("array<bigint>")
    later = compat.groupBy(F.col("a").alias("vid")).agg(F.array_sort(F.collect_set("b")).alias("next"))
    later = materialize(v.join(later, "vid", "left").select("vid", F.coalesce("next", none).alias("next")), "later")
    level = later.select(F.array("vid").alias("vids"), F.col("next").alias("ext"))
    parts = [spark.createDataFrame([([],)], "vids array<bigint>")]
    size = 1
    while size <= top:
        level = materialize(level, "level")
        if not n_rows(level):
            break
        parts.append(level.select("vids"))
        grown = level.select("vids", "ext", F.explode("ext").alias("vid")).join(later, "vid")
        level = grown.select(F.array_append("vids", F.col("vid")).alias("vids"), F.array_intersect("ext", "next").alias("ext"))
        size += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("vids", F.size("vids").alias("size")).where(having)


def _truth(rel: Relation, order: list[str], ids: list[int]) -> np.ndarray:
    """The relation as a boolean array with one axis per quantified variable."""
    n, at = len(ids), {v: i for i, v in enumerate(ids)}
    table = np.full((n,) * len(order), not rel.positive)
    if rel.df is None:
        return table
    axes = [order.index(name) for name in rel.names]
    for row in rel.df.select(*rel.names).collect():  # at most max_vset_vertices to the number of variables
        if all(v in at for v in row):
            where: list = [slice(None)] * len(order)
            for axis, v in zip(axes, row):
                where[axis] = at[v]
            table[tuple(where)] = rel.positive
    return table


def _partnered(graph: PropertyGraph, rel: Relation, names: list[str]) -> list[int]:
    """For "all have a partner": vertices that can be in a set at all, the greatest set each of which has a partner in it, sorted.

    Peeled by semi-joins for a filter of both variables that is stored by its true tuples. Others restrict nothing here. At most one
    vertex more than ``max_vset_vertices`` comes out.
    """
    x, y = names
    alive = graph.vertices.select("vid")
    if rel.df is not None and rel.positive and set(rel.names) == {x, y}:
        pairs = materialize(rel.df.select(x, y), "pairs")
        alive = pairs.select(F.col(x).alias("vid")).distinct().join(alive, "vid", "left_semi")
        n = None
        while n != (n := alive.count()):
            alive = materialize(pairs.join(alive.withColumnRenamed("vid", y), y, "left_semi").select(F.col(x).alias("vid")).distinct().join(alive, "vid", "left_semi"), "alive")
    return sorted(r["vid"] for r in alive.limit(graph.options.max_vset_vertices + 1).collect())


def _masks(table: np.ndarray, quantifiers: list[str], ids: list[int]):
    """Evaluate the prefix for a batch of bit masks at once."""
    n, k = len(ids), len(quantifiers)
    packed = {}
    for index in product(range(n), repeat=max(0, k - 1)):
        packed[index] = np.uint64(sum(1 << i for i in range(n) if table[index + (i,)])) if k else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(ids, np.int64)
        for batch in batches:
            mask = batch.column(0).to_numpy().astype(np.uint64)

            def test(level: int, index: tuple) -> np.ndarray:
                if level == k - 1:
                    hit = packed[index]
                    return (mask & ~hit) == 0 if quantifiers[level] == FORALL else (mask & hit) != 0
                out = np.full(len(mask), quantifiers[level] == FORALL)
                for i in range(n):
                    inside = (mask >> np.uint64(i)) & np.uint64(1) != 0
                    inner = test(level + 1, (*index, i))
                    out = out & (~inside | inner) if quantifiers[level] == FORALL else out | (inside & inner)
                return out

            mask = mask[test(0, ())] if k else (mask if bool(table) else mask[:0])
            bits = ((mask[:, None] >> np.arange(n, dtype=np.uint64)) & np.uint64(1)).astype(bool)
            size = bits.sum(axis=1)
            values = np.broadcast_to(known, bits.shape)[bits]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(size.astype(np.int32))], names=["vids", "size"])

    return run


def subsets(graph: PropertyGraph, prefix: list[tuple[str, str]], expr: object, having) -> DataFrame:
    """``(vids ARRAY, size)``: every set of vertices over which the sentence holds and whose ``size`` satisfies ``having``.

    Variables range over the set. The empty set holds if the outermost quantifier is "forall". Sentences of one or two
    "forall" are grown from compatible pairs and need no bound on the graph, only on their result. Others are tested mask
    by mask over the vertices that can occur at all; more than ``options.max_vset_vertices`` of them raise ValueError rather than
    cut the result. Vertices come sorted inside a set.
    """
    loose = variables(expr) - {v for v, _ in prefix}
    if loose:
        raise ValueError(f"{', '.join(sorted(loose))} in the filter has no quantifier")
    rel = relation(graph, expr)
    names, kinds = [v for v, _ in prefix], [q for _, q in prefix]
    n, most, masked = graph.vertices.count(), graph.options.max_vset_vertices, graph.options.masked_vertices
    if n > masked and prefix and set(kinds) == {FORALL} and len(names) <= 2 and len(set(names)) == len(names):
        x, y = names if len(names) == 2 else (names[0], names[0])
        return _grown(graph, rel, x, y, having, _largest(graph, having, n))
    if n > masked and not prefix:  # all sets of an allowed size, or none
        if rel.positive:
            return graph.spark.createDataFrame([], SCHEMA)
        return _grown(graph, Relation((), None, False), "x", "x", having, _largest(graph, having, n))
    if len(set(names)) < len(names):  # an inner variable of the same name hides the outer one
        names, kinds = zip(*{v: q for v, q in prefix}.items())
        names, kinds = list(names), list(kinds)
    if n > most and kinds != [FORALL, EXIST]:
        raise ValueError(f"this sentence is enumerated over at most {most} vertices; the graph has {n}")
    if kinds == [FORALL, EXIST]:  # vertices that can occur at all
        ids = _partnered(graph, rel, names)
        if len(ids) > most:
            raise ValueError(f"this sentence is enumerated over at most {most} vertices; more can occur")
    else:
        ids = sorted(r["vid"] for r in graph.vertices.select("vid").collect())  # at most max_vset_vertices
    table = _truth(rel, names, ids)
    masks = graph.spark.range(1 << len(ids)).withColumn("size", F.bit_count("id")).where(having)
    return masks.select("id").mapInArrow(_masks(table, kinds, ids), SCHEMA)


def numbered(found: DataFrame) -> DataFrame:
    """``(subset_id, vids, size)``: subsets numbered from 0 by size and members."""
    rows = running_totals(found.withColumn("_one", F.lit(1).cast("long")), None, ["size", "vids"], ["_one"])
    return rows.select((F.col("run__one") - 1).alias("subset_id"), "vids", "size")


def members(found: DataFrame) -> DataFrame:
    """``(subset_id, vid)`` of numbered subsets."""
    return found.select("subset_id", F.explode("vids").alias("vid"))
