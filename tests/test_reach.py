"""Searches from many vertices whose answers are few, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators import algorithms as A
from loomgraph.operators.local import Csr, in_groups
from test_whole import _outs, _reach


def test_masks_of_64_starts():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(2, 90)
        edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(150)) if a < b}
        csr = Csr(np.array([3 * a for a, _ in edges], np.int64), np.array([3 * b for _, b in edges], np.int64))
        starts = csr.codes(np.array([rng.randrange(3 * n) for _ in range(64)]))
        mask, out = csr.reached(starts), _outs(edges)
        for i, s in enumerate(starts.tolist()):
            want = {3 * v for v in _reach(out, csr.ids[s] // 3)} if s >= 0 else set()
            assert {int(v) for v, m in zip(csr.ids, mask) if int(m) >> i & 1} == want


def test_groups_of_asked_rows(spark):
    """More keys than a mask has bits, more rows than are held, keys and values that no edge has."""
    edges = {(a, b) for a in range(150) for b in (a + 1, a + 7) if b < 150 and a % 40}
    out = _outs(edges)
    asked = [(a, b) for a in [*range(150), 999] for b in (0, 40, 77, 149, 1000)]

    def kernel(csr, weight, keys, which, b):
        assert len(keys) <= 64
        mask, at = csr.reached(csr.codes(keys)), csr.codes(b)
        hit = (at >= 0) & ((mask[at] >> which.astype(np.uint64)) & np.uint64(1) == 1)
        return {"a": keys[which[hit]], "b": b[hit], "w": weight[at[hit]]}

    weights = spark.createDataFrame([(v, 10 * v) for v in range(150)], "vid long, weight long")
    got = in_groups(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(asked, "a long, b long"), 2, kernel, "a long, b long, w long", weights, 100)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, 10 * b) for a, b in asked if a < 150 and b < 150 and b in _reach(out, a))


@pytest.mark.parametrize("turned", [False, True])
def test_few_targets(spark, monkeypatch, turned):
    """Two ends are searched for 240 others: no search lists what every vertex reaches, whichever side is the smaller one."""
    edges = [(v, v + 1) for v in range(238)] + [(9, 5), (100, 90), (30, 239)]
    graph = PropertyGraph(spark.range(240).select(F.col("id").alias("vid")), spark.createDataFrame(edges, "src long, dst long"))
    monkeypatch.setattr(A, "bfs", None)
    pairs = [(b, a) if turned else (a, b) for a in [*range(240), 500] for b in (7, 200, 501)]
    out = _outs(edges)
    got = A.reachable(graph, spark.createDataFrame(pairs + pairs[:9], "src long, dst long")).collect()
    assert {(r["src"], r["dst"]): r["reachable"] for r in got} == {(a, b): max(a, b) < 500 and b in _reach(out, a) for a, b in pairs} and len(got) == len(pairs)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_counts_without_distances(spark, monkeypatch, bound):
    """Two large components, a way between them, tails, a vertex without edges: each start counts all that it reaches, each component is searched once."""
    ring = lambda lo, n: [(lo + k, lo + (k + 1) % n) for k in range(n)]
    edges = ring(0, 40) + ring(50, 30) + [(3, 45), (45, 50), (52, 90), (90, 91), (95, 0), (95, 52), (96, 96), (96, 91)]
    graph = PropertyGraph(spark.range(100).select(F.col("id").alias("vid")), spark.createDataFrame(edges, "src long, dst long"))
    starts = [*range(0, 100, 5), 96, 95, 777]
    frame, out = spark.createDataFrame([(v,) for v in starts], "vid long"), _outs(edges)
    want = {v: len(_reach(out, v)) for v in starts if v < 100}
    searched = []
    whole, groups = A.bfs, A.in_groups
    monkeypatch.setattr(A, "bfs", lambda g, keys, **k: searched.append(keys.count()) or whole(g, keys, **k))
    monkeypatch.setattr(A, "in_groups", lambda e, keys, *k: searched.append(keys.count()) or groups(e, keys, *k))
    assert {r["origin"]: r["n"] for r in A.reach_counts(graph, frame, bound).collect()} == want
    assert searched == [len({v if v >= 40 else 0 for v in want if not 50 <= v < 80} | {50})]
    if bound:
        row = A.bfs_samples(graph, frame, bound, depth=False).first().asDict()
        assert row == {"samples": len(want), "least": 1, "most": max(want.values()), "average": round(sum(want.values()) / len(want), 6)}
