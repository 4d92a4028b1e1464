"""Repeats without ``times`` reach the end of the graph, or say that they did not."""

import pytest

from loomgraph.model import PropertyGraph
from loomgraph.operators.traversal import __
from loomgraph.plans.language import parse_filter
from loomgraph.plans.quantify import relation


def _chain(spark, n, edges):
    return PropertyGraph(spark.range(n).withColumnRenamed("id", "vid"), spark.createDataFrame(edges, "src long, dst long")).cache()


def test_chains_longer_than_the_old_bound(spark):
    g = _chain(spark, 36, [(i, i + 1) for i in range(35)])
    assert g.traversal().V(0).repeat(__.out(), until=__.hasId(35)).toList() == [35]
    assert relation(_chain(spark, 3, [(0, 1), (1, 2)]), parse_filter("g.V(x).repeat(__.out()).is(y)")).df.count() == 0


def test_cycles_and_limits(spark):
    g = _chain(spark, 4, [(0, 1), (1, 0), (2, 3)])
    with pytest.raises(ValueError, match="cycle"):
        g.traversal().V(0).repeat(__.out(), until=__.hasId(3)).toList()
    with pytest.warns(UserWarning, match="traversers left"):
        assert g.traversal().V(0).repeat(__.out(), until=__.hasId(1, 3), emit=False, limit=0).toList() == [0]
    assert sorted(g.traversal().V(2).repeat(__.out(), emit=True).toList()) == [3]
