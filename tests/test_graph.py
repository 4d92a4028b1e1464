"""Golden results on the 13-vertex example and small sample graphs, and both executions of each algorithm."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph, handle, unpack
from loomgraph.operators import algorithms as A
from loomgraph.operators import mutation as M
from loomgraph.operators.result import serialize, subset_counts, web_result
from loomgraph.operators.second_order import SecondOrder
from loomgraph.sources.graph_file import GraphFormatError, read_graph, register, write_graph
from loomgraph.sources.properties import load_graph, read_properties, synthetic

PAIRS = [(0, 2), (1, 0), (1, 2), (1, 3), (2, 3), (3, 0), (3, 4), (3, 11), (4, 6), (4, 7), (5, 4), (6, 5), (7, 3), (7, 8), (7, 9), (8, 9), (8, 10), (10, 7), (10, 9), (11, 12)]
COMMUNITY = [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    (d / "g.graph").write_text("t 13 20\n\n" + "".join(f"v {v} 0 {c}\n" for v, c in enumerate(COMMUNITY)) + "x skipped\n" + "".join(f"e {a} {b}\n" for a, b in PAIRS))
    (d / "v.csv").write_text('vertex,label,name,age,score,ok,note\n0,person,Alice,30,1.5,true,"a, ""b"""\n1,person,Bob,25,2,False,\n2,,Charlie,,,TRUE,x')
    (d / "e.csv").write_text("outVertex,inVertex,label,since\n0,2,relationship,2010\n7,7,relationship,2011")
    (d / "v.json").write_text('[{"vertex": 3, "name": "David", "tags": ["a", 1], "none": null}, {"vertex": 4, "name": "Eva"}]')
    (d / "bad.csv").write_text("vertex,name\nx,Alice")
    (d / "none.csv").write_text("id,name\n1,Alice")
    return d


@pytest.fixture(scope="module")
def example(spark, files):
    return read_graph(spark, str(files / "g.graph")).cache()


def pairs(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def unfolded(rows):
    """The edges between communities, and the pairs of boundary vertices that reach each other inside one, as classes and links say."""
    kinds = {k: {(r["src"], r["dst"]) for r in rows.collect() if r["kind"] == k} for k in ("cross", "member", "link")}
    out = {}
    for a, b in kinds["link"]:
        out.setdefault(a, set()).add(b)

    def reach(c):
        seen, todo = {c}, [c]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    classes = dict(kinds["member"])
    return kinds["cross"], {(a, b) for a in classes for b in classes if a != b and classes[b] in reach(classes[a])}


def test_loader(spark, example, files, tmp_path):
    assert tuple(example.counts().first()) == (13, 20)
    assert pairs(example.edges, "src", "dst") == sorted(PAIRS)
    assert pairs(example.vertices, "vid", "community") == list(enumerate(COMMUNITY))
    write_graph(example, str(tmp_path / "w"))
    assert pairs(read_graph(spark, str(tmp_path / "w")).edges, "src", "dst") == sorted(PAIRS)
    register(spark)
    assert spark.read.format("graph").load(str(files / "g.graph")).count() == 20
    assert pairs(spark.read.format("graph").option("part", "vertices").load(str(files / "g.graph"))) == list(enumerate(COMMUNITY))
    example.save(str(tmp_path / "saved"))
    assert pairs(PropertyGraph.load(spark, str(tmp_path / "saved")).edges, "src", "dst") == sorted(PAIRS)


@pytest.mark.parametrize("text", ["v 0 0 0\n", "t 2 1\ne 0\n", "t 2 1\ne 5 0\n", "t 2 1\nv 0\n", "t 2 1\ne a 1\n", "t 2 1\ne 0 7\n"])
def test_loader_errors(spark, tmp_path, text):
    (tmp_path / "b.graph").write_text(text)
    with pytest.raises(GraphFormatError):
        read_graph(spark, str(tmp_path / "b.graph"))


def test_property_files(spark, files):
    g = load_graph(spark, "example", str(files / "g.graph"), str(files / "v.csv"), str(files / "e.csv"))
    kinds = dict(g.vertices.dtypes)
    assert (kinds["age"], kinds["score"], kinds["ok"], kinds["note"]) == ("bigint", "double", "boolean", "string")
    rows = {r["vid"]: r for r in g.vertices.collect()}
    assert rows[0]["note"] == 'a, "b"' and rows[1]["note"] is None and rows[2]["age"] is None and rows[5]["label"] == "vertex"
    assert {(r["src"], r["dst"]): r["since"] for r in g.edges.collect()}[0, 2] == 2010 and g.edges.count() == 20
    j = {r["vertex"]: r for r in read_properties(spark, str(files / "v.json"), ("vertex",)).collect()}
    assert j[3]["tags"] == '["a","1"]' or j[3]["tags"] == '["a",1]'
    assert read_properties(spark, "x.txt", ("vertex",)) is None and read_properties(spark, None, ("vertex",)) is None
    for bad in ("bad.csv", "none.csv"):
        with pytest.raises(ValueError):
            read_properties(spark, str(files / bad), ("vertex",))
    with pytest.raises(ValueError):
        load_graph(spark, "1bad", str(files / "g.graph"))


def test_reads(spark, example):
    assert sorted(r[0] for r in example.out_neighbours(3).collect()) == [0, 4, 11]
    assert sorted(r[0] for r in example.in_neighbours(9).collect()) == [7, 8, 10]
    degrees = {r["vid"]: (r["out_degree"], r["in_degree"]) for r in example.degrees().collect()}
    assert [degrees[v][0] for v in (0, 1, 3, 11)] == [1, 3, 3, 1] and degrees[12] == (0, 1)
    m = spark.createDataFrame([(v,) for v in range(4)], "vid long")
    assert {r["vid"]: r["neighbours"] for r in example.adjacency(m).collect()} == {0: [2], 1: [0, 2, 3], 2: [3], 3: [0, 4, 11]}
    assert example.induced(m).edges.count() == 6
    assert [r["vid"] for r in example.vertices_by_id([3, 1, 3, "nobody", 99]).collect()] == [3, 1, 3]
    asked = spark.createDataFrame([(0, 2), (2, 0)], "src long, dst long")
    assert {(r["src"], r["exists"]) for r in example.has_edge(asked).collect()} == {(0, True), (2, False)}
    a, b = unpack(handle(F.lit(7), F.lit(9)))
    assert tuple(spark.range(1).select(a, b).first()) == (7, 9)
    assert example.snapshot().count() == 33


@pytest.mark.parametrize("bound", [10**6, 0])
def test_algorithms_on_the_example(example, bound):
    dist = {r["vid"]: r["distance"] for r in A.bfs(example, 0, local_edges=bound).collect()}
    assert dist == {0: 0, 2: 1, 3: 2, 4: 3, 11: 3, 6: 4, 7: 4, 12: 4, 5: 5, 8: 5, 9: 5, 10: 6}
    assert A.bfs(example, [1, 9], local_edges=bound).groupBy("origin").count().collect().__len__() == 2
    assert A.bfs(example, 0, community=0, local_edges=bound).count() == 3
    assert A.bfs(example, 4, "in", local_edges=bound).count() == 10
    assert {r["component"] for r in A.wcc(example, bound).collect()} == {0}
    scc = A.scc(example, bound)
    want = {v: 0 for v in (0, 2, 3, 4, 5, 6, 7, 8, 10)} | {1: 1, 9: 9, 11: 11, 12: 12}
    assert {r["vid"]: r["component"] for r in scc.collect()} == want
    dag = A.condensed(example, scc)
    assert pairs(dag.edges, "src", "dst") == [(0, 9), (0, 11), (1, 0), (11, 12)]
    assert {r["vid"]: r["level"] for r in A.levels(dag, bound).collect()} == {1: 0, 0: 1, 9: 2, 11: 2, 12: 3}
    path = lambda a, b: [r["vid"] for r in A.shortest_path(example, a, b, bound).orderBy("position").collect()]
    assert path(0, 10) == [0, 2, 3, 4, 7, 8, 10] and path(1, 12) == [1, 3, 11, 12] and path(9, 0) == [] and path(5, 5) == [5] and path(0, 77) == []
    asked = [(0, 9), (9, 0), (3, 3), (4, 8), (1, 12), (12, 1), (0, 99)]
    assert {(r["src"], r["dst"]) for r in A.reachable(example, asked, bound).collect() if r["reachable"]} == {(0, 9), (3, 3), (4, 8), (1, 12)}


def test_communities(example):
    assert sorted(r[0] for r in A.community_search(example, 0).collect()) == [0, 1, 2, 3]
    assert pairs(A.cross_edges(example), "src", "dst") == [(3, 4), (3, 11), (4, 7), (7, 3)]
    assert sorted(r["vid"] for r in A.boundary_vertices(example).collect()) == [3, 4, 7, 11]
    assert tuple(A.component_stats(A.communities(example)).first()) == (4, 4, 2, 3.25)
    assert {r["component"] for r in A.wcc(A.quotient(example)).collect()} == {0}
    assert {r["vid"] for r in A.boundary_bfs(example, 4).collect()} == {3, 4, 7, 11}
    cross, inside = unfolded(A.enriched_boundary(example))
    assert cross == {(3, 4), (3, 11), (4, 7), (7, 3)} and inside == set()
    assert A.dag_stats(A.condensed(example, A.scc(example))).first()["n_levels"] == 4


@pytest.mark.parametrize("seed", [1])
def test_both_executions_agree_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(75)}
    g = PropertyGraph(spark.range(n).withColumnRenamed("id", "vid"), spark.createDataFrame(list(edges), "src long, dst long")).cache()
    for f in (A.wcc, A.scc):
        assert pairs(f(g, 10**6), "vid", "component") == pairs(f(g, 0), "vid", "component")
    fine, coarse = dict(pairs(A.scc(g), "vid", "component")), dict(pairs(A.wcc(g), "vid", "component"))
    assert all(coarse[v] == coarse[c] for v, c in fine.items())
    dag = A.condensed(g, A.scc(g))
    assert pairs(A.levels(dag, 10**6), "vid", "level") == pairs(A.levels(dag, 0), "vid", "level")
    level = dict(pairs(A.levels(dag), "vid", "level"))
    assert all(level[a] < level[b] for a, b in pairs(dag.edges, "src", "dst"))
    number = dict(pairs(A.numbered(A.wcc(g)), "vid", "component_id"))
    roots = sorted(set(coarse.values()))
    assert number == {v: roots.index(c) for v, c in coarse.items()}


def so(spark, edges, n):
    return PropertyGraph(spark.range(1, n + 1).withColumnRenamed("id", "vid"), spark.createDataFrame([(a, b, "knows") for a, b in edges], "src long, dst long, label string"))


EITHER = 'g.V(x).bothE().otherV().is(y) || g.V(x).is(y)'
APART = 'g.V(x).bothE().otherV().is(y).count().is(0) || g.V(x).is(y)'


@pytest.mark.parametrize("masked", [16, 0])
def test_subsets_of_the_example(spark, example, masked):
    """By masks, and grown level by level where the sentence allows it."""
    from loomgraph.config import Options

    example = PropertyGraph(example.vertices, example.edges, Options(masked_vertices=masked))
    q = SecondOrder(example)
    sizes = lambda df: [r["count"] for r in df.groupBy("size").count().orderBy("size").collect()]
    cliques = q.Vset().forall("x").forall("y").filter(EITHER)
    assert sizes(cliques.execute()) == [1, 13, 20, 10, 2]
    assert cliques.having("size > 1").execute().count() == 32
    assert sizes(q.Vset().forall("x").forall("y").filter(APART).execute()) == [1, 13, 58, 108, 72]
    assert q.Vset().having("size == 2").execute().count() == 78
    if not masked:
        return
    some = q.Vset().forall("x").exist("y").filter("g.V(x).out().is(y)").execute()
    assert some.count() == 74 and some.where("size = 0").count() == 1
    assert [r["subset_id"] for r in some.orderBy("size", "vids").collect()] == list(range(74))
    named = lambda c: sorted(r["vids"] for r in c.execute().collect())
    assert named(q.Community().forall("x").exist("y").filter("g.V(x).out().is(y)")) == [[0, 1, 2, 3], [4, 5, 6]]
    assert len(named(q.Community().forall("x").forall("y").filter(EITHER))) == 4
    assert [len(v) for v in named(q.SCC().forall("x").exist("y").filter("g.V(x).out().is(y)"))] == [9]
    assert named(q.SCC().forall("x").forall("y").filter(EITHER)) == [[1], [9], [11], [12]]
    assert named(q.WCC()) == [list(range(13))] and named(q.WCC().having("size < 5")) == [] and named(q.WCC().having("size")) == []
    assert q.BFS(0).execute().first()["size"] == 12 and q.BFS(50).execute().count() == 0
    assert q.run("g.Vset().forall('x').forall('y').filter('g.V(x).outE().is(y)').execute()").count() == 1
    shaped = {r["subset_id"]: r for r in serialize(example, q.Community().execute()).collect()}
    assert len(shaped[0]["vertices"]) == 4 and [(e["source"], e["target"]) for e in shaped[1]["edges"]] == [(4, 6), (5, 4), (6, 5)]
    counts = {tuple(r) for r in subset_counts(example, q.Community().members()).collect()}
    assert counts == {(0, 4, 6), (1, 3, 3), (2, 4, 6), (3, 2, 1)}
    assert web_result(example, q.Community().execute()).first()["totalCount"] == 4
    assert serialize(example, q.Vset().forall("x").filter("false").execute()).first()["vertices"] == []


def test_sentences(spark):
    g = SecondOrder(so(spark, [(1, 2), (2, 3), (3, 1)], 4))
    knows = "g.V({}).out('knows').is({})"
    holds = lambda *p, f: _build(g.SecondOrder(), p).filter(f).execute().first()["holds"]
    assert holds("Ex", "Ey", f=knows.format("x", "y"))
    assert not holds("Ex", "Ay", f=f"{knows.format('y', 'x')} || g.V(y).is(x)")
    assert not holds("Ax", "Ay", f=f"!{knows.format('x', 'y')} || {knows.format('y', 'x')}")
    assert {tuple(r["vids"]) for r in _build(g.Vset(), ("Ax", "Ey")).filter(knows.format("x", "y")).execute().collect()} == {(), (1, 2, 3)}
    assert _build(g.Vset(), ("Ax", "Ay")).filter(EITHER).execute().count() == 9
    chain = SecondOrder(so(spark, [(1, 2), (2, 3)], 3))
    f = "g.V(x).bothE().otherV().is(y)"
    assert _build(chain.SecondOrder(), ("Ax", "Ey")).filter(f).execute().first()["holds"]
    assert {tuple(r["vids"]) for r in _build(chain.Vset(), ("Ax", "Ey")).filter(f).execute().collect()} == {(), (1, 2), (2, 3), (1, 2, 3)}
    with pytest.raises(ValueError):
        g.SecondOrder().filter("true").execute()
    with pytest.raises(ValueError):
        g.SecondOrder().exist("x").filter("g.V(z).out().is(x)").execute()
    empty = SecondOrder(PropertyGraph.empty(spark))
    assert _build(empty.SecondOrder(), ("Ax",)).filter("false").execute().first()["holds"]
    assert not _build(empty.SecondOrder(), ("Ex",)).filter("true").execute().first()["holds"]


def _build(query, prefix):
    for p in prefix:
        query = query.exist(p[1:]) if p[0] == "E" else query.forall(p[1:])
    return query


def _brute(ids, edges, age, prefix, test, binding=None):
    binding = binding or {}
    if not prefix:
        return test(binding, edges, age)
    (q, v), rest = (prefix[0][0], prefix[0][1:]), prefix[1:]
    results = (_brute(ids, edges, age, rest, test, {**binding, v: i}) for i in ids)
    return any(results) if q == "E" else all(results)


FILTERS = [
    ("g.V(x).out().is(y)", lambda b, e, a: (b["x"], b["y"]) in e, "xy"),
    ("!g.V(x).out().is(y) && g.V(y).has('age', gt(1))", lambda b, e, a: (b["x"], b["y"]) not in e and a[b["y"]] > 1, "xy"),
    ("g.V(x).both().is(y).count().is(0) || g.V(x).is(y)", lambda b, e, a: not ((b["x"], b["y"]) in e or (b["y"], b["x"]) in e) or b["x"] == b["y"], "xy"),
    ("g.V(x).has('age', 1) || g.V(y).has('age', 2)", lambda b, e, a: a[b["x"]] == 1 or a[b["y"]] == 2, "xy"),
    ("g.V(x).where(__.in().has('age', lt(2)))", lambda b, e, a: any(t == b["x"] and a[s] < 2 for s, t in e), "x"),
    ("g.V(x).out().count().is(gte(2))", lambda b, e, a: sum(s == b["x"] for s, t in e) >= 2, "x"),
    ("g.V(x).out().is(y) && g.V(y).out().is(z) && !(g.V(z).is(x))", lambda b, e, a: (b["x"], b["y"]) in e and (b["y"], b["z"]) in e and b["z"] != b["x"], "xyz"),
    ("g.V(x).out().count()", lambda b, e, a: True, "x"),
]


@pytest.mark.parametrize("text, test, names", FILTERS, ids=[f[0] for f in FILTERS])
def test_quantifiers_and_subsets_against_brute_force(spark, text, test, names):
    from itertools import chain, combinations, product

    rng = random.Random(text)
    n = 4
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(6)}
    age = {i: rng.randrange(4) for i in range(n)}
    g = PropertyGraph(spark.createDataFrame(list(age.items()), "vid long, age long").withColumn("community", (F.col("vid") % 2).cast("int")), spark.createDataFrame(list(edges), "src long, dst long")).cache()
    q = SecondOrder(g)
    powerset = list(chain.from_iterable(combinations(range(n), k) for k in range(n + 1)))
    prefixes = list(product("EA", repeat=len(names)))
    for quantifiers in prefixes if len(prefixes) < 3 else rng.sample(prefixes, 2):
        prefix = [a + v for a, v in zip(quantifiers, names)]
        assert _build(q.SecondOrder(), prefix).filter(text).execute().first()["holds"] == _brute(range(n), edges, age, prefix, test)
        got = {r["subset_id"] for r in _build(q.Community(), prefix).filter(text).sizes().collect()}
        assert got == {c for c in (0, 1) if _brute([i for i in range(n) if i % 2 == c], edges, age, prefix, test)}
        found = {tuple(r["vids"]) for r in _build(q.Vset(), prefix).filter(text).having("size != 1").execute().collect()}
        assert found == {s for s in powerset if len(s) != 1 and _brute(s, edges, age, prefix, test)}, prefix


def test_traversals(spark):
    v = spark.createDataFrame([(1, "user", "Alice", 28, None), (2, "user", "Bob", 30, None), (3, "product", "Phone", None, 2999.0)], "vid long, label string, name string, age long, price double")
    e = spark.createDataFrame([(1, 2, "friend", 2020), (2, 1, "friend", 2021), (1, 3, "buy", None), (3, 3, "part", None)], "src long, dst long, label string, since long")
    graph = PropertyGraph(v, e).cache()
    g = graph.traversal()
    from loomgraph.functions.predicates import between, gt, starting_with, within
    from loomgraph.operators.traversal import __

    assert g.V().hasLabel("user").count().next() == 2
    assert g.V().has("name", "Alice").out("friend").values("name").toList() == ["Bob"]
    assert sorted(g.V(1).both().toList()) == [2, 3] and sorted(g.V(1).bothE().otherV().toList()) == [2, 2, 3]
    assert sorted(g.V(3).bothE().toList()) == [(1, 3), (3, 3), (3, 3)] and g.V(3).both().toList() == [1]
    assert g.E().has("since", gt(2020)).outV().toList() == [2] and sorted(g.E().bothV().toList()) == [1, 1, 1, 2, 2, 3, 3, 3]
    assert g.V().has("age", between(28, 30)).toList() == [1] and sorted(g.V().has("name", within("Bob", "Phone")).toList()) == [2, 3]
    assert g.V().has("name", starting_with("Ph")).toList() == [3] and g.V().hasNot("age").toList() == [3] and g.V().has("nothing", 1).toList() == []
    assert g.V().where(__.out("buy")).toList() == [1] and sorted(g.V().not_(__.out("buy")).toList()) == [2, 3]
    assert sorted(g.V().where(__.out().count().is_(0)).toList()) == [] and sorted(g.V().where(__.out("friend").count().is_(0)).toList()) == [3]
    assert sorted(g.V().or_(__.out("buy"), __.has("name", "Bob")).toList()) == [1, 2] and g.V().and_(__.out("buy"), __.has("name", "Bob")).toList() == []
    assert g.V(2).V(1, 1).toList() == [1, 1]
    assert g.V().out().dedup().count().next() == 3 and g.V().values("age").sum().next() == 58 and g.V().values("age").mean().next() == 29
    assert g.V().has("age", 99).values("age").sum().toList() == [] and g.V().has("age", 99).count().next() == 0
    assert g.V().order(("age", "desc"), "name").toList()[0] == 2 and g.V().order("name").range(1, 3).toList() == [2, 3] and g.V().order("name").tail(1).toList() == [3]
    assert {r["key"]: r["n"] for r in g.V().groupCount("label").collect()} == {"user": 2, "product": 1}
    assert {r["key"]: r["value"] for r in g.V().group("label", "name").collect()} == {"user": ["Alice", "Bob"], "product": ["Phone"]}
    assert g.V().has("name", "Phone").valueMap("name", "price", "age").first()["properties"] == '{"name":["Phone"],"price":[2999.0]}'
    assert g.V(1).valueMap("name", tokens=True).first()["label"] == "user"
    assert g.E().hasLabel("buy").elementMap().first()["in_vertex"] == 3
    assert tuple(g.E().hasLabel("buy").project(who="out.name", what="in.name", kind="label").first()) == ("Alice", "Phone", "buy")
    assert g.V().as_("a").out("friend").as_("b").out("friend").as_("c").where_same("a", "c").select("a", "b", by="name").count() == 2
    assert g.V(1).with_path().out("friend").out().simplePath().path().collect() == [] and g.V(1).with_path().out("friend").out("friend").cyclicPath().path().first()["path"] == ["1", "2", "1"]
    assert sorted(g.V(1).repeat(__.out("friend"), times=3).toList()) == [2] and sorted(g.V(1).repeat(__.out("friend"), times=2, emit=True).toList()) == [1, 2]
    assert g.V(2).repeat(__.out(), until=__.hasLabel("product"), limit=4).dedup().toList() == [3]
    assert pairs(g.V().match(("a", "friend", "b"), ("a", "buy", "c")).select("a", "b", "c")) == [(1, 2, 3)]
    assert sorted(g.V(1).union(__.out("friend"), __.out("buy")).toList()) == [2, 3]
    assert sorted(g.V().coalesce(__.out("buy"), __.out("friend")).toList()) == [1, 3] and sorted(g.V(1, 3).optional(__.out("friend")).toList()) == [2, 3]
    assert g.V(1).choose(__.hasLabel("user"), __.out("buy"), __.out("friend")).toList() == [3]
    assert g.inject(3, 1).map(lambda x: x * 2).order().toList() == [2, 6] and g.V(1, 2).values("name").fold().next() == ["Alice", "Bob"]
    assert g.E().hasLabel("friend").subgraph().counts().first()["n_vertices"] == 2
    assert g.V(1).property("age", 29).traversal().V(1).values("age").next() == 29
    assert g.V(1).outE("friend").drop().traversal().V(1).out("friend").toList() == []
    less = g.V(3).drop()
    assert tuple(less.counts().first()) == (2, 2)
    with pytest.raises(ValueError):
        g.V(1).property("age", None)
    more = M.add_vertices(graph, spark.createDataFrame([("user", "Carl")], "label string, name string"))
    assert more.vertices.where("name = 'Carl'").first()["vid"] == 4
    assert M.merge_vertices(graph, spark.createDataFrame([("1", "user"), ("x9", "user")], "id string, label string")).vertices.count() == 4
    over = M.add_edges(graph, spark.createDataFrame([(1, 2, "enemy"), (2, 3, "buy")], "src long, dst long, label string"))
    assert over.edges.count() == 5 and over.traversal().V(1).outE("enemy").toList() == [(1, 2)]
    assert M.merge_edges(graph, spark.createDataFrame([(1, 2, "enemy")], "src long, dst long, label string")).edges.where("label = 'enemy'").count() == 0
    log = lambda *r: spark.createDataFrame(r, "src long, dst long, ts long, op int")
    merged = M.merge_logs(log((0, 1, 100, 0), (0, 2, 200, 0)), log((0, 1, 150, 1), (0, 2, 250, 1), (0, 3, 300, 0)))
    assert pairs(merged, "dst", "ts", "op") == [(1, 150, 1), (2, 250, 1), (3, 300, 0)]
    feed = spark.createDataFrame([(1, 1, 2, 5, 1, None), (2, 2, 3, 6, 0, 2024)], "delta_id long, src long, dst long, ts long, op int, since long")
    assert pairs(M.with_changes(graph, feed).edges, "src", "dst") == [(1, 3), (2, 1), (2, 3), (3, 3)]
    made = PropertyGraph.of(None, spark.createDataFrame([(1, 2), (1, 2), (None, 3)], "src long, dst long"))
    assert tuple(made.counts().first()) == (2, 1)
    s = synthetic(spark, 100, 300)
    assert s.vertices.count() == 100 and s.edges.where("src = dst").isEmpty()


def test_value_steps_and_options(spark, tmp_path):
    from loomgraph.config import Options
    from loomgraph.operators.traversal import Source, together

    g = Source(PropertyGraph.empty(spark))
    one = lambda v, name, *a: getattr(g.inject(v), name)(*a).next()
    assert [one("ab c", "toUpper"), one(" a ", "trim"), one("abcd", "substring", 1, 3), one("a.b", "split", "."), one("aba", "replace", "a", "x"), one("ab", "concat", "-", "c"), one("abc", "length"), one("abc", "reverse")] == ["AB C", "a", "bc", ["a", "b"], "xbx", "ab-c", 3, "cba"]
    assert [one([1, 2], "combine", [2]), one([1, 2], "merge", [2, 3]), one([1, 2], "difference", [2]), one([1, 2], "intersect", [2]), one([1, 2], "disjunct", [2, 3]), one([1], "product", [3, 4]), one(["a", "b"], "conjoin", "+")] == [[1, 2, 2], [1, 2, 3], [1], [2], [1, 3], [[1, 3], [1, 4]], "a+b"]
    assert one("2024-01-31", "asDate").month == 1 and g.inject("2024-01-01").asDate().dateAdd("DAY", 2).dateDiff("2024-01-01").next() == 172800 and one(-4, "abs") == 4 and g.inject(9.0).sqrt().next() == 3.0
    assert tuple(together(a=g.V().count(), b=g.inject(1, 2).sum()).first()) == (0, 3)
    with pytest.raises(ValueError):
        g.V().toUpper()
    o = Options.parse("block_size: 512  # bytes\n\nlocal_edges: 9\n")
    o.save(str(tmp_path / "o"))
    assert Options.load(str(tmp_path / "o")) == o and o.block_size == 512
    assert o.with_table(spark.createDataFrame([("block_size", 7), ("other", 1)], "option_name string, option_value long")).block_size == 7
    with pytest.raises(ValueError):
        Options.parse("nothing: 1")


def test_language_errors():
    from loomgraph.plans.language import QuerySyntaxError, parse_filter, parse_having

    for bad in ("g.V(x", "g.V(x).fly()", "x == 1", "g.V(x) &&", "(g.V(x)", "", "g.V(x).out(;)", "exec('rm')"):
        with pytest.raises(QuerySyntaxError):
            parse_filter(bad)
    for bad in ("size >", "size + true", "sizes > 1", "size > 1 &&"):
        with pytest.raises(QuerySyntaxError):
            parse_having(bad)


def test_stream_of_changes(spark, tmp_path):
    from loomgraph.streaming import deltas

    rows = [(i, i % 3, i % 5, 100 - i, i % 4 == 0, i, None) for i in range(40)]
    frame = spark.createDataFrame([(*r[:4], int(r[4]), *r[5:]) for r in rows], deltas.FEED)
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    deltas.ingest(deltas.read_feed(spark, str(tmp_path / "in"), 1), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    base = spark.createDataFrame([(0, 0), (9, 9)], "src long, dst long")
    from loomgraph.operators.changes import apply_changes

    assert pairs(deltas.current(spark, base, str(tmp_path / "log")), "src", "dst") == pairs(apply_changes(base, frame), "src", "dst")
    deltas.compact(spark, base, str(tmp_path / "log"), str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == apply_changes(base, frame).count()
    q = deltas.activity(deltas.read_feed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from act").first()[0] == 40
