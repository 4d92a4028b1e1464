"""Spread joins, forests, searches from many starts, the index, stored graphs, tasks and text splits, on small graphs."""

import random
from collections import Counter

import pytest

from loomgraph.config import Options
from loomgraph.model import PropertyGraph
from loomgraph.operators import algorithms as A
from loomgraph.operators import mutation as M
from loomgraph.operators.index import GraphIndex
from loomgraph.operators.local import forests
from loomgraph.operators.skew import Spread
from loomgraph.operators.traversal import __
from loomgraph.plans.tasks import run_task
from loomgraph.sources import graph_file
from loomgraph.sources.properties import GraphStore, attach_vertex_properties, read_properties
from loomgraph.storage import Grown, materialize, n_rows

N = 40
EDGES = sorted({(0, i) for i in range(1, 25)} | {(i, i + 1) for i in range(20, 27)} | {(26, 24), (5, 0), (6, 5)})
OUT = {v: sorted(b for a, b in EDGES if a == v) for v in range(N)}


def reach(v, out=OUT):
    seen, todo = {v: 0}, [v]
    for x in todo:
        for y in out[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([(i, i // 10, i // 10) for i in range(N)], "vid long, community int, band int")
    return PropertyGraph(v, spark.createDataFrame(EDGES, "src long, dst long")).cache()


@pytest.mark.parametrize("hot", [1 << 20, 5])
def test_spread_join_with_a_hub(spark, hot):
    edges = spark.createDataFrame(EDGES + [(None, 1)], "src long, dst long")
    asking = [(0, "a"), (0, "b"), (20, "c"), (39, "d"), (None, "e")]
    got = Spread(edges, "src", hot_rows=hot).join(spark.createDataFrame(asking, "src long, who string"))
    want = Counter((s, w, d) for s, w in asking if s is not None for d in OUT[s])
    assert Counter((r["src"], r["who"], r["dst"]) for r in got.collect()) == want
    two = Spread(edges.withColumn("origin", edges.src % 2), ["origin", "src"], hot_rows=hot)
    asked = spark.createDataFrame([(0, 0), (1, 0), (0, 20)], "origin long, src long")
    assert two.join(asked).count() == len(OUT[0]) + len(OUT[20])


def test_forests_keep_components(spark):
    rows = forests(spark.createDataFrame(EDGES * 3 + [(50, 51), (60, 60)], "src long, dst long").repartition(3))
    got = rows.collect()
    assert all(r["u"] > r["v"] for r in got) and len(got) <= 3 * N
    parent = {v: v for v in range(70)}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for r in got:
        a, b = root(r["u"]), root(r["v"])
        parent[max(a, b)] = min(a, b)
    assert {root(v) for v in range(28)} == {0} and root(51) == 50 and root(60) == 60 and root(39) == 39


@pytest.mark.parametrize("bound", [10**6, 0])
def test_many_starts(spark, graph, bound):
    starts = spark.createDataFrame([(v,) for v in (0, 5, 20, 39, 39, 99)], "vid long")
    got = {(r["origin"], r["vid"]): (r["distance"], r["parent"]) for r in A.bfs(graph, starts, local_edges=bound).collect()}
    want = {}
    for s in (0, 5, 20, 39):
        d = reach(s)
        want |= {(s, v): (k, min((u for u in d if d[u] == k - 1 and v in OUT[u]), default=None)) for v, k in d.items()}
    assert got == want
    stats = A.bfs_samples(graph, starts, bound).first()
    sizes = [len(reach(s)) for s in (0, 5, 20, 39)]
    assert (stats["samples"], stats["least"], stats["most"]) == (4, min(sizes), max(sizes))
    path = lambda f, a, b: [r["vid"] for r in f(graph, a, b, bound).orderBy("position").collect()]
    for a, b in ((6, 27), (0, 26), (27, 0), (39, 39)) if bound else ((6, 27),):
        assert path(A.shortest_path, a, b) == path(A.pruned_path, a, b) and len(path(A.shortest_path, a, b)) == (reach(a)[b] + 1 if b in reach(a) else 0)


def test_index(spark, graph, tmp_path):
    index = GraphIndex.build(graph, 0)
    index.save(str(tmp_path / "index"))
    index = GraphIndex.load(spark, str(tmp_path / "index"))
    scc = {v: min(w for w in reach(v) if v in reach(w)) for v in range(N)}
    every = graph.vertices.select("vid")
    assert {r["vid"]: r["component"] for r in index.component_of(every).collect()} == scc
    level = {r["vid"]: r["level"] for r in index.level_of(every).collect()}
    assert all(level[a] < level[b] for a, b in EDGES if scc[a] != scc[b]) and level == {r["vid"]: level[r["component"]] for r in index.places.collect()}
    ends = {v for a, b in EDGES if a // 10 != b // 10 for v in (a, b)}
    assert {r["vid"] for r in index.is_boundary(every).where("is_boundary").collect()} == ends
    assert {(r["community"], r["vid"]) for r in index.boundary_of().collect()} == {(v // 10, v) for v in ends}
    asked = spark.createDataFrame([(0,), (39,)], "vid long")
    assert {(r["vid"], r["neighbour"]) for r in index.neighbour_boundaries(asked).collect()} == {(0, b) for b in OUT[0] if b >= 10}
    assert {r["community"] for r in index.community_of(asked).collect()} == {0, 3}
    big = {c for c in scc.values() if list(scc.values()).count(c) > 1}
    found = index.members_of(spark.createDataFrame([(c,) for c in big], "component long"))
    assert {(r["component"], r["vid"]) for r in found.collect()} == {(c, v) for v, c in scc.items() if c in big}
    assert {r["component"] for r in index.at_level(0).collect()} == {scc[v] for v in level if level[v] == 0}
    assert dict(map(tuple, index.component_levels().collect())) == {c: level[c] for c in scc.values()}


def test_tasks(graph):
    assert run_task(graph, "bfs 6").count() == len(reach(6)) and run_task(graph, "wcc").count() == N
    assert [r["vid"] for r in run_task(graph, "path 6 1").orderBy("position").collect()] == [6, 5, 0, 1]
    assert run_task(graph, "wccn").first()["n_components"] == 2 and run_task(graph, "analysis").first()["n_boundary"] > 0 and run_task(graph, "scc").count() == N
    for bad in ("", "fly", "bfs", "bfs x", "path 1"):
        with pytest.raises(ValueError):
            run_task(graph, bad)


def test_store(spark, graph, tmp_path):
    store = GraphStore(spark, str(tmp_path), Options(local_edges=7))
    assert store.open("new").edges.count() == 0 and store.exists("new") and not store.exists("other")
    assert store.save("g", graph).edges.count() == len(EDGES) and store.open("g").options.local_edges == 7
    store.save("g", store.open("g").traversal().V(0).drop())
    assert store.reload("g").vertices.count() == N - 1
    (tmp_path / "t.graph").write_text("t 2 1\nv 0 0 0\nv 1 0 0\ne 0 1\n")
    (tmp_path / "p.csv").write_text("vertex,name\n0,Zed\n0,Amy\n1,\n")
    up = store.upload("up", str(tmp_path / "t.graph"), str(tmp_path / "p.csv"))
    assert {r["vid"]: r["name"] for r in up.vertices.collect()} == {0: "Amy", 1: None}
    for bad in (("1up", "t.graph"), ("up", "p.csv"), ("up", "t.graph", "t.graph")):
        with pytest.raises(ValueError):
            store.upload(bad[0], *[str(tmp_path / b) for b in bad[1:]])


@pytest.mark.parametrize("kind", ["csv", "json"])
@pytest.mark.parametrize("whole", [True, False])
def test_last_row_wins(spark, graph, tmp_path, kind, whole):
    """Whole rows are replaced, whatever is larger: an absent cell of the last row stays absent."""
    path = tmp_path / f"v.{kind}"
    rows = [(0, "Zed", 9), (1, "Bob", 5), (0, "Amy", None)]
    if kind == "csv":
        path.write_text("vertex,name,age\n" + "".join(f"{v},{n},{'' if a is None else a}\n" for v, n, a in rows))
    else:
        import json

        cells = [json.dumps({"vertex": v, "name": n, "age": a}) for v, n, a in rows]
        path.write_text("[" + ",".join(cells) + "]" if whole else "\n".join(cells))
    got = attach_vertex_properties(graph, read_properties(spark, str(path), ("vertex",), whole)).vertices
    assert {r["vid"]: (r["name"], r["age"]) for r in got.where("vid < 3").collect()} == {0: ("Amy", None), 1: ("Bob", 5), 2: (None, None)}


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_text_splits(spark, graph, tmp_path, monkeypatch, size):
    """Ranges that cut lines anywhere give every line once."""
    path = tmp_path / "g.graph"
    path.write_text(f"t {N} {len(EDGES)}\n\n" + "".join(f"v {v} 0 {v // 10}\r\n" for v in range(N)) + "\n".join(f"e {a}\t{b}" for a, b in EDGES))
    monkeypatch.setattr(graph_file, "SPLIT_BYTES", size)
    for part, want in (("edges", EDGES), ("vertices", [(v, v // 10) for v in range(N)])):
        reader = graph_file._Reader(str(path), part)
        got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(got) == want
    path.write_text("t 1 1\ne 0\n")
    with pytest.raises(Exception, match="too short"):
        list(graph_file._Reader(str(path), "edges").read(graph_file._Reader(str(path), "edges").partitions()[0]))


def test_steps(spark, graph):
    g = graph.traversal()
    assert g.V(6).repeat(__.out(), until=__.hasId(0), emit=True, limit=5).toList() == [5, 0]
    assert sorted(g.V(6).repeat(__.out(), until=__.loops().is_(2)).toList()) == [0]
    assert g.V(6).repeat(__.repeat(__.out(), times=1), until=__.loops().is_(2)).toList() == [0]
    kept = g.V(0).out().aggregate("near")
    assert sorted(kept.out().without("near").toList()) == sorted(b for a in OUT[0] for b in OUT[a] if b not in OUT[0]) and len(kept.out().within("near").toList()) == len([1 for a in OUT[0] for b in OUT[a] if b in OUT[0]])
    assert kept.cap("near").next() == OUT[0] and sorted(kept.side("near").toList()) == OUT[0]
    tree = {tuple(r["path"]): r["n"] for r in g.V(6).with_path().out().out().out().tree().collect()}
    assert tree[("6",)] == len(OUT[0]) and tree[("6", "5", "0")] == len(OUT[0]) and tree[("6", "5", "0", "7")] == 1
    assert g.V().out().profile().first()["rows"] == len(EDGES) and g.V().iterate().count().next() == N
    assert [tuple(x) for x in g.inject(["a", "b"]).index().next()] == [("a", 0), ("b", 1)]
    # the far end and one evaluation per element agree
    far = g.V().where(__.out().has("band", 2).out().hasId(25, 27))
    assert sorted(far.toList()) == sorted(v for v in OUT if any(b // 10 == 2 and {25, 27} & set(OUT[b]) for b in OUT[v]))
    near = g.V().as_("a").where(__.out().has("band", 2).out().hasId(25, 27).dedup())
    assert sorted(near.toList()) == sorted(far.toList())
    assert sorted(g.V().or_(__.in_().hasId(6), __.both().in_().hasId(6)).toList()) == sorted(v for v in range(N) if v in OUT[6] or 5 in OUT[v] or v in OUT[5])
    assert sorted(g.V().not_(__.both()).toList()) == list(range(28, N))


def test_properties_and_new_vertices(spark, graph):
    g = graph.with_(graph.vertices.withColumn("name", graph.vertices.id).withColumn("note", graph.vertices.id))
    assert M.list_properties(g, "na").count() == N and M.list_properties(g, "x").collect() == []
    less = M.remove_property(g, spark.createDataFrame([(3,)], "vid long"), "name")
    assert {r["id"] for r in M.list_properties(less, "name").collect()} == {str(v) for v in range(N) if v != 3}
    assert "note" not in M.drop_property(g, "note").vertices.columns
    more = M.add_vertices(g, spark.range(500).selectExpr("'new' AS label").repartition(7)).vertices
    assert sorted(r["vid"] for r in more.collect()) == list(range(N + 500)) and more.select("community").where("community > 3").distinct().count() == 500
    assert graph.with_(graph.vertices, graph.edges).options == graph.options and PropertyGraph(g.vertices, g.edges, Options(giant_vertex_boundary=20)).giant_vertices().collect()[0]["vid"] == 0


def test_growing_tables(spark):
    grown = Grown("test", most=2)
    for i in range(7):
        part = grown.add(spark.range(i))
        assert n_rows(part) == i == part.count()
    assert grown.frame().count() == 21 and len(grown.parts) <= 3
    assert n_rows(materialize(spark.range(5).where("id > 9"))) == 0 and n_rows(spark.range(3)) == 3
