"""Steps that see several traversers, inside filters and nested traversals, against brute force on shared neighbours."""

import pytest

from loomgraph.model import PropertyGraph
from loomgraph.operators.second_order import SecondOrder
from loomgraph.operators.traversal import __
from loomgraph.plans.language import parse_filter
from loomgraph.plans.quantify import relation

EDGES = sorted({(a, b) for a in range(5) for b in (5, 6)} | {(0, 1), (5, 6), (6, 7), (7, 7)})
OUT = {v: sorted(b for a, b in EDGES if a == v) for v in range(9)}
TWO = {v: sorted(c for b in OUT[v] for c in OUT[b]) for v in OUT}


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([(i, 10 - i) for i in range(9)], "vid long, age long")
    return PropertyGraph(v, spark.createDataFrame(EDGES, "src long, dst long")).cache()


def test_nested_traversals(graph):
    g = graph.traversal()
    some, more = [v for v in OUT if OUT[v]], [v for v in OUT if len(OUT[v]) > 1]
    assert sorted(g.V().where(__.out().dedup()).toList()) == some
    assert sorted(g.V().where(__.out().limit(1)).toList()) == some
    assert sorted(g.V().where(__.out().skip(1)).toList()) == more
    assert sorted(g.V().where(__.out().range(1, 2)).toList()) == more
    assert sorted(g.V().where(__.out().range(1, -1)).toList()) == more
    assert sorted(g.V().where(__.out().tail(1)).toList()) == some
    assert sorted(g.V().not_(__.out().limit(1)).toList()) == [8]
    assert sorted(g.V().or_(__.out().skip(2), __.out().limit(1).hasId(7)).toList()) == [v for v in OUT if len(OUT[v]) > 2 or OUT[v][:1] == [7]]
    assert sorted(g.V().where(__.out().out().dedup().count().is_(2)).toList()) == [v for v in OUT if len(set(TWO[v])) == 2]
    assert sorted(g.V().where(__.out().order("age").limit(1).hasId(6)).toList()) == [v for v in OUT if OUT[v] and max(OUT[v]) == 6]
    assert sorted(g.V().where(__.out().where(__.out().limit(1).hasId(6))).toList()) == [v for v in OUT if any(OUT[b][:1] == [6] for b in OUT[v])]
    assert sorted(g.V().local(__.out().limit(1)).toList()) == sorted(OUT[v][0] for v in some)
    assert sorted(g.V().coalesce(__.out().skip(1).limit(1), __.out()).toList()) == sorted(x for v in some for x in (OUT[v][1:2] or OUT[v]))
    assert sorted(g.V().as_("a").out().where(__.out().dedup()).select("a").toList()) == sorted(v for v in OUT for b in OUT[v] if OUT[b])
    assert sorted(g.V().out().dedup().toList()) == sorted({b for _, b in EDGES}) and len(g.V().limit(2).toList()) == 2


@pytest.mark.parametrize("text, want", [
    ("g.V(x).out().dedup().is(y)", lambda x, y: y in OUT[x]),
    ("g.V(x).out().out().dedup().is(y)", lambda x, y: y in TWO[x]),
    ("g.V(x).out().limit(1).is(y)", lambda x, y: y in OUT[x][:1]),
    ("g.V(x).out().is(y).limit(1)", lambda x, y: y in OUT[x]),
    ("g.V(x).out().out().dedup().count().is(2) && g.V(x).out().is(y)", lambda x, y: len(set(TWO[x])) == 2 and y in OUT[x]),
    ("g.V(x).in().where(__.out().limit(1)).is(y)", lambda x, y: x in OUT[y]),
    ("g.V(x).out().where(__.in().dedup().is(x)).is(y)", lambda x, y: y in OUT[x]),
])
def test_filter_texts(graph, text, want):
    rel = relation(graph, parse_filter(text))
    assert rel.positive and {tuple(r) for r in rel.df.select("x", "y").collect()} == {(x, y) for x in OUT for y in OUT if want(x, y)}


def test_sentence(graph):
    assert SecondOrder(graph.induced(graph.vertices.where("vid < 7").select("vid"))).SecondOrder().forall("x").exist("y").filter("g.V(x).out().dedup().is(y) || g.V(x).is(6) && g.V(y).is(6)").execute().first()["holds"]
