"""Queries over whole tables, against brute force."""

import pytest

import __spark_entry__ as E
from loomgraph.operators import algorithms as A
from loomgraph.plans import subsets
from loomgraph.sources import views

SMALL = "/root/testdata/sf0.001"


def _grow(ids, ok):
    out, level = [()], [()]
    while level:
        level = [(*s, v) for s in level for v in ids if (not s or v > s[-1]) and all(ok(a, v) for a in s)]
        out += level
    return out


def test_all_nations(spark, monkeypatch):
    g = views.nation_graph(spark, SMALL)
    ids = sorted(r["vid"] for r in g.vertices.collect())
    near = {frozenset((r["src"], r["dst"])) for r in g.edges.collect()}
    assert len(ids) == spark.read.parquet(f"{SMALL}/nation.parquet").count() == 25
    calls, grown = [], subsets._grown
    monkeypatch.setattr(subsets, "_grown", lambda *a: calls.append(1) or grown(*a))
    got = {r["mask"] for r in E.queries()["vset_independent"](spark, SMALL).collect()}
    assert calls and got == {sum(1 << v for v in s) for s in _grow(ids, lambda a, b: frozenset((a, b)) not in near) if len(s) > 1}
    assert E.queries()["vset_size2"](spark, SMALL).count() == 300
    hub = any(all(a == b or frozenset((a, b)) in near for b in ids) for a in ids)
    assert E.queries()["so_exists_forall"](spark, SMALL).first()["holds"] == hub


def _reach(out, start):
    seen, todo = {start}, [start]
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """60 parts of 4 brands; orders in which most lines are small."""
    import random

    rng, d = random.Random(7), tmp_path_factory.mktemp("items")
    part = [(k, f"part {k}", f"brand {k % 4}", "t", k % 50, 900.0 + k) for k in range(60)]
    lines = [(o, n, rng.randrange(45), 1, 10.0, float(rng.randrange(1, 51))) for o in range(14) for n in range(rng.randrange(1, 6))]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(d / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(str(d / "lineitem.parquet"))
    steps = [(a[2], b[2]) for a, b in zip(lines, lines[1:]) if a[0] == b[0] and a[2] != b[2]]
    often = {v: min({b for a, b in steps if a == v}, key=lambda b: (-steps.count((v, b)), b)) for v in {a for a, _ in steps}}
    return str(d), set(steps), set(often.items())


def _outs(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def test_parts(spark, items):
    """Every line of every order counts, in the graph of all steps and in that of the most frequent ones."""
    folder, edges, often = items
    q = lambda name: E.queries()[name](spark, folder)
    assert {tuple(r) for r in views.part_graph(spark, folder).edges.select("src", "dst").collect()} == edges
    assert {tuple(r) for r in views.next_graph(spark, folder).edges.select("src", "dst").collect()} == often
    und, out, most = _outs(often | {(b, a) for a, b in often}), _outs(often), _outs(edges)
    reach = {v: _reach(out, v) for v in range(60)}
    assert {r["vid"]: r["component"] for r in q("wcc").collect()} == {v: min(_reach(und, v)) for v in range(60)}
    scc = {v: min(w for w in reach[v] if v in reach[w]) for v in range(60)}
    assert {r["vid"]: r["component"] for r in q("scc").collect()} == scc
    assert {tuple(r) for r in q("scc_dag").select("src", "dst").collect()} == {(scc[a], scc[b]) for a, b in often if scc[a] != scc[b]}
    hub = min(range(60), key=lambda v: (-sum(a == v for a, _ in edges), v))
    assert {r["vid"] for r in q("bfs_set").select("vid").collect()} == _reach(most, hub)
    assert {(r["cu"], r["cv"], r["n_edges"]) for r in q("boundary_pairs").collect()} == {(x, y, n) for x in range(4) for y in range(4) if x != y and (n := sum((a % 4, b % 4) == (x, y) for a, b in edges))}
    inner = _outs((a, b) for a, b in often if a % 4 == b % 4)
    ends = {v for a, b in often if a % 4 != b % 4 for v in (a, b)}
    from test_graph import unfolded

    want = {(a, b) for a, b in often if a % 4 != b % 4}, {(a, b) for a in ends for b in _reach(inner, a) & ends if a != b}
    assert unfolded(q("enriched_boundary")) == want


def test_all_starts(spark, items):
    folder, edges, often = items
    out = _outs(often)
    reach = {v: _reach(out, v) for v in range(60)}
    asked = [v for v in range(60) if v % 20 == 0]
    got = E.queries()["reachable"](spark, folder).collect()
    assert {(r["src"], r["dst"], r["reachable"]) for r in got} == {(a, b, b in reach[a]) for a in asked for b in range(4)} and len(got) == 12
    got = [tuple(r) for r in E.queries()["closure_to_targets"](spark, folder).select("src", "dst").collect()]
    assert sorted(got) == sorted((a, b) for a in asked for b in reach[a] if 900 + b > 930)
    g = views.part_graph(spark, folder)
    most = _outs(edges)
    pairs = [(a, b) for a in range(0, 60, 7) for b in range(60)]
    got = A.reachable(g, spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {(r["src"], r["dst"]): r["reachable"] for r in got} == {(a, b): b in _reach(most, a) for a, b in pairs}
