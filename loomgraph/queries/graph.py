"""Graph reads, traversals, algorithms and second-order queries over graph views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.predicates import between, gt, gte, starting_with, within
from loomgraph.operators import algorithms as A
from loomgraph.operators import mutation as M
from loomgraph.operators.changes import apply_changes
from loomgraph.operators.result import subset_counts
from loomgraph.operators.second_order import SecondOrder
from loomgraph.operators.traversal import __
from loomgraph.queries.base import CLOSED, CROSS, HUB, LEVELS, ORACLE, QUERIES, STRONG, WEAK, market, nation, nxt, part, people, query, trade, walk
from loomgraph.sources.views import NATION, REGION
from loomgraph.storage import materialize, table

# -- reads ------------------------------------------------------------------------------------------------------------------


@query(trade, " SELECT vid, label, name FROM tv")
def v_scan(g):
    return g.vertices.select("vid", "label", "name")


@query(trade, " SELECT src, dst, label FROM te")
def e_scan(g):
    return g.edges.select("src", "dst", "label")


@query(trade, f" SELECT vid, name FROM tv WHERE vid IN ({NATION + 3}, {REGION}) UNION ALL SELECT vid, name FROM tv WHERE vid = {NATION + 3}")
def v_by_id(g):
    return g.vertices_by_id([NATION + 3, REGION, NATION + 3, "nobody"]).select("vid", "name")


@query(trade, f" SELECT src, dst, label FROM te WHERE src = {NATION + 5} AND dst = (SELECT {REGION} + n_regionkey FROM nation WHERE n_nationkey = 5)")
def e_by_id(g):
    ids = [r["id"] for r in g.edges.where(F.col("src") == NATION + 5).select("id").collect()]  # one edge per nation
    return g.edges_by_id(ids).select("src", "dst", "label")


@query(trade, " SELECT (SELECT count(*) FROM tv) AS n_vertices, (SELECT count(*) FROM te) AS n_edges")
def counts(g):
    return g.counts()


@query(trade, " SELECT vid, (SELECT count(*) FROM te WHERE src = vid) AS out_degree, (SELECT count(*) FROM te WHERE dst = vid) AS in_degree FROM tv")
def degree(g):
    return g.degrees()


@query(trade, f" SELECT src AS vid FROM te WHERE dst = {NATION + 7}")
def in_edges(g):
    return g.in_neighbours(NATION + 7)


@query(trade, " SELECT c.src, c.dst, EXISTS (SELECT 1 FROM te t WHERE t.src = c.src AND t.dst = c.dst) AS \"exists\" FROM (SELECT DISTINCT dst AS src, src AS dst FROM te UNION SELECT src, dst FROM te WHERE label = 'buys_from') c")
def has_edge(g):
    asked = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).union(g.edges.where("label = 'buys_from'").select("src", "dst")).distinct()
    return g.has_edge(asked)


@query(trade, " SELECT src, dst, label FROM te WHERE src IN (SELECT vid FROM tv WHERE label <> 'customer' OR balance > 5000) AND dst IN (SELECT vid FROM tv WHERE label <> 'customer' OR balance > 5000)")
def induced_subgraph(g):
    return g.induced(g.vertices.where("label <> 'customer' OR balance > 5000").select("vid")).edges.select("src", "dst", "label")


@query(people, " SELECT src AS vid, count(*) AS n_neighbours, min(dst) AS least FROM pe GROUP BY src UNION ALL SELECT vid, 0, NULL FROM pv WHERE vid NOT IN (SELECT src FROM pe)")
def adjacency(g):
    return g.adjacency().select("vid", F.size("neighbours").cast("long").alias("n_neighbours"), F.get("neighbours", F.lit(0)).alias("least"))


@query(trade, " SELECT 'vertex' AS kind, label, count(*) AS n FROM tv GROUP BY 2 UNION ALL SELECT 'edge', label, count(*) FROM te GROUP BY 2")
def snapshot(g):
    return g.snapshot().groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


# -- traversals -----------------------------------------------------------------------------------------------------------------


@query(trade, " SELECT vid FROM tv WHERE label = 'supplier'")
def has_label(g):
    return g.traversal().V().hasLabel("supplier").frame()


@query(trade, " SELECT vid FROM tv WHERE segment = 'BUILDING' AND balance > 1000")
def has_prop(g):
    return g.traversal().V().has("segment", "BUILDING").has("balance", gt(1000.0)).frame()


@query(trade, " SELECT vid FROM tv WHERE balance >= 0 AND balance < 500 AND name LIKE 'Customer%' AND segment IN ('BUILDING', 'MACHINERY')")
def has_predicates(g):
    return g.traversal().V().has("balance", between(0.0, 500.0)).has("name", starting_with("Customer")).has("segment", within("BUILDING", "MACHINERY")).frame()


@query(trade, " SELECT vid FROM tv WHERE segment IS NULL AND NOT EXISTS (SELECT 1 FROM te WHERE dst = vid AND label = 'buys_from')")
def has_not(g):
    return g.traversal().V().hasNot("segment").not_(__.in_("buys_from")).frame()


@query(trade, " SELECT b.dst AS vid FROM te a JOIN te b ON a.dst = b.src JOIN tv ON a.src = tv.vid WHERE a.label = 'buys_from' AND b.label = 'in_nation' AND segment = 'FURNITURE'")
def out(g):
    return g.traversal().V().has("segment", "FURNITURE").out("buys_from").out("in_nation").frame()


@query(trade, " SELECT b.src AS vid FROM te a JOIN te b ON b.dst = a.src JOIN tv ON a.dst = tv.vid WHERE tv.label = 'region' AND a.label = 'in_region' AND b.label = 'in_nation'")
def in_steps(g):
    return g.traversal().V().hasLabel("region").in_("in_region").in_("in_nation").frame()


@query(people, " , nb AS (SELECT src AS a, dst AS b FROM pe WHERE src <> dst UNION SELECT dst, src FROM pe WHERE src <> dst) SELECT b AS vid, count(*) AS n FROM nb GROUP BY b")
def both(g):
    return g.traversal().V().both().frame().groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


@query(trade, " SELECT dst AS vid FROM te WHERE label = 'in_nation'")
def outE_inV(g):
    return g.traversal().V().outE("in_nation").inV().frame()


@query(people, " SELECT vid, count(*) AS n FROM (SELECT src AS vid FROM pe UNION ALL SELECT dst FROM pe) GROUP BY vid")
def bothE_otherV(g):
    return g.traversal().V().bothE().otherV().frame().groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


@query(trade, " SELECT name AS value FROM tv WHERE label = 'nation'")
def values(g):
    return g.traversal().V().hasLabel("nation").values("name").frame()


@query(trade, " SELECT CAST(vid AS VARCHAR) AS id, label, name, balance, segment FROM tv")
def element_map(g):
    return g.traversal().V().elementMap()


@query(trade, """ SELECT label, CASE WHEN balance IS NULL THEN 1 WHEN segment IS NULL THEN 2 ELSE 3 END AS n_keys, count(*) AS n FROM tv GROUP BY 1, 2""")
def value_map(g):
    m = g.traversal().V().valueMap(tokens=True)
    return m.select("label", F.size(F.json_object_keys("properties")).alias("n_keys")).groupBy("label", "n_keys").agg(F.count(F.lit(1)).alias("n"))


@query(trade, " SELECT a.name AS buyer, b.name AS seller FROM te JOIN tv a ON te.src = a.vid JOIN tv b ON te.dst = b.vid WHERE te.label = 'buys_from'")
def project(g):
    return g.traversal().E().hasLabel("buys_from").project(buyer="out.name", seller="in.name")


@query(trade, f" SELECT vid FROM tv WHERE label = 'customer' AND EXISTS (SELECT 1 FROM te a JOIN te b ON a.dst = b.src WHERE a.src = vid AND a.label = 'buys_from' AND b.label = 'in_nation' AND b.dst = {NATION + 2})")
def where_sub(g):
    return g.traversal().V().hasLabel("customer").where(__.out("buys_from").out("in_nation").hasId(NATION + 2)).frame()


@query(trade, " SELECT vid FROM tv WHERE label = 'customer' AND (SELECT count(*) FROM te WHERE src = vid AND label = 'buys_from') >= 40")
def where_count(g):
    return g.traversal().V().hasLabel("customer").where(__.out("buys_from").count().is_(gte(40))).frame()


@query(trade, " SELECT vid FROM tv WHERE segment = 'HOUSEHOLD' OR EXISTS (SELECT 1 FROM te WHERE dst = vid AND label = 'in_region')")
def or_step(g):
    return g.traversal().V().or_(__.has("segment", "HOUSEHOLD"), __.in_("in_region")).frame()


@query(trade, " SELECT segment AS key, count(*) AS n FROM tv WHERE segment IS NOT NULL GROUP BY 1")
def group_count(g):
    return g.traversal().V().groupCount("segment")


@query(trade, " SELECT label AS key, round(max(balance), 4) AS value FROM tv GROUP BY 1")
def group_by(g):
    return g.traversal().V().group("label", "balance", "max").select("key", F.round("value", 4).alias("value"))


@query(trade, " SELECT vid FROM tv WHERE balance IS NOT NULL ORDER BY balance DESC, vid LIMIT 25 OFFSET 5")
def order_limit(g):
    return g.traversal().V().has("balance").order(("balance", "desc")).range(5, 30).frame()


@query(people, " SELECT DISTINCT a.src AS vid FROM pe a JOIN pe b ON a.dst = b.src AND b.dst = a.src")
def dedup(g):
    return g.traversal().V().as_("a").out().out().as_("b").where_same("a", "b").dedup().frame()


@query(trade, " SELECT DISTINCT c.dst AS vid FROM te a JOIN te b ON a.dst = b.src JOIN te c ON b.dst = c.src JOIN tv ON a.src = tv.vid WHERE tv.label = 'customer'")
def repeat_times(g):
    return g.traversal().V().hasLabel("customer").repeat(__.out(), times=3).dedup().frame()


@query(trade, "RECURSIVE , r AS (SELECT vid, 0 AS k FROM tv WHERE label = 'supplier' UNION ALL SELECT dst, k + 1 FROM r JOIN te ON src = vid WHERE k < 3) SELECT CAST(vid AS BIGINT) AS vid FROM r WHERE k > 0")
def repeat_emit(g):
    return g.traversal().V().hasLabel("supplier").repeat(__.out(), times=3, emit=True).frame()


@query(trade, " SELECT x.src AS a, x.dst AS b, y.dst AS c FROM te x JOIN te y ON x.src = y.src JOIN te z ON x.dst = z.src AND z.dst = y.dst WHERE x.label = 'buys_from' AND y.label = 'in_nation' AND z.label = 'in_nation'")
def match_triangle(g):
    return g.traversal().V().match(("a", "buys_from", "b"), ("a", "in_nation", "c"), ("b", "in_nation", "c")).select("a", "b", "c")


@query(trade, " SELECT a.src || ',' || a.dst || ',' || b.dst AS path FROM te a JOIN te b ON a.dst = b.src JOIN tv ON a.src = tv.vid WHERE tv.label = 'customer'")
def path(g):
    return g.traversal().V().hasLabel("customer").with_path().out().out().simplePath().path().select(F.concat_ws(",", "path").alias("path"))


@query(trade, " SELECT dst AS vid FROM te WHERE label = 'in_region' UNION ALL SELECT src FROM te WHERE label = 'in_region' AND dst IN (SELECT vid FROM tv WHERE label = 'region')")
def union_step(g):
    return g.traversal().V().hasLabel("nation").union(__.out("in_region"), __.where(__.out("in_region"))).frame()


@query(trade, " SELECT dst AS vid FROM te WHERE label = 'buys_from' UNION ALL SELECT vid FROM tv WHERE label = 'customer' AND NOT EXISTS (SELECT 1 FROM te WHERE src = vid AND label = 'buys_from')")
def optional_step(g):
    return g.traversal().V().hasLabel("customer").optional(__.out("buys_from")).frame()


@query(trade, " SELECT dst AS vid FROM te JOIN tv ON src = vid WHERE tv.label = 'customer' AND ((balance > 5000 AND te.label = 'buys_from') OR (NOT balance > 5000 AND te.label = 'in_nation'))")
def choose_step(g):
    return g.traversal().V().hasLabel("customer").choose(__.has("balance", gt(5000.0)), __.out("buys_from"), __.out("in_nation")).frame()


@query(trade, " SELECT round(sum(balance), 2) AS s, min(balance) AS a, max(balance) AS b, round(avg(balance), 4) AS m, count(balance) AS n FROM tv WHERE label = 'customer'")
def reducers(g):
    t = g.traversal().V().hasLabel("customer").values("balance")
    one = lambda r, n, k=None: r.frame().select((F.round(r.name, k) if k else F.col(r.name)).alias(n))
    return one(t.sum(), "s", 2).join(one(t.min(), "a")).join(one(t.max(), "b")).join(one(t.mean(), "m", 4)).join(one(t.count(), "n"))


# -- mutations --------------------------------------------------------------------------------------------------------------------


@query(trade, " SELECT src, dst, label FROM te WHERE src NOT IN (SELECT vid FROM tv WHERE balance < 0) AND dst NOT IN (SELECT vid FROM tv WHERE balance < 0)")
def drop_vertices(g):
    from loomgraph.functions.predicates import lt

    return g.traversal().V().has("balance", lt(0.0)).drop().edges.select("src", "dst", "label")


@query(trade, " SELECT vid, CASE WHEN label = 'nation' THEN 'changed' ELSE segment END AS segment FROM tv")
def set_property(g):
    return g.traversal().V().hasLabel("nation").property("segment", "changed").vertices.select("vid", "segment")


@query(trade, " SELECT dst AS src, src AS dst, 'in_nation' AS label FROM te WHERE label = 'in_nation' UNION ALL SELECT src, dst, label FROM te")
def add_edges(g):
    back = g.edges.where("label = 'in_nation'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
    return M.add_edges(g, back).edges.select("src", "dst", "label")


def delta_lww(spark: SparkSession, folder: str) -> DataFrame:
    """Last operation per edge of the event log: users to value buckets, removed by errors."""
    ev = table(spark, folder, "events")
    log = ev.select(F.col("user_id").alias("src"), F.pmod(F.floor("value").cast("long"), F.lit(16)).alias("dst"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") == "error").cast("int").alias("op"), "event_id")
    log = log.where("dst IS NOT NULL AND ts IS NOT NULL")
    one = log.groupBy("src", "dst", "ts").agg(F.min(F.struct("event_id", "op")).alias("x")).select("src", "dst", "ts", F.col("x.op").alias("op"))
    return M.merge_logs(one)


QUERIES["delta_lww"] = delta_lww
ORACLE["delta_lww"] = """SELECT src, dst, ts, op FROM (SELECT user_id AS src, ((CAST(floor(value) AS BIGINT) % 16) + 16) % 16 AS dst, epoch_us(ts) AS ts, CAST(event_type = 'error' AS INT) AS op,
 row_number() OVER (PARTITION BY user_id, ((CAST(floor(value) AS BIGINT) % 16) + 16) % 16 ORDER BY ts DESC, event_id) AS rn FROM events WHERE value IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1"""


def delta_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Out-degree of every source after the change feed."""
    now = apply_changes(table(spark, folder, "graph_edges"), table(spark, folder, "edge_deltas"))
    return now.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


QUERIES["delta_overlay"] = delta_overlay
ORACLE["delta_overlay"] = """WITH last AS (SELECT src, dst, op FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, delta_id) AS rn FROM edge_deltas
  WHERE src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND op IN (0, 1)) WHERE rn = 1)
 SELECT src, count(*) AS out_degree FROM (SELECT src, dst FROM last WHERE op = 0 UNION SELECT src, dst FROM graph_edges g WHERE src IS NOT NULL AND dst IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM last l WHERE l.src = g.src AND l.dst = g.dst)) GROUP BY src"""

# -- algorithms -------------------------------------------------------------------------------------------------------------------


def _hub(g) -> int:
    top = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()
    return top["src"]


@query(part, f"RECURSIVE , {HUB}, {walk()} SELECT vid, distance FROM bf")
def bfs_dist(g):
    return A.bfs(g, _hub(g)).select("vid", "distance")


@query(part, f"RECURSIVE , {HUB}, {walk()} SELECT vid FROM bf")
def bfs_set(g):
    return SecondOrder(g).BFS(_hub(g)).found()


@query(nxt, f"RECURSIVE , {WEAK} SELECT vid, component FROM wc")
def wcc(g):
    return A.wcc(g)


@query(nxt, f"RECURSIVE , {WEAK} SELECT vid, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS component_id FROM wc")
def wcc_numbered(g):
    return A.numbered(A.wcc(g))


@query(nxt, f"RECURSIVE , {WEAK}, s AS (SELECT count(*) AS n FROM wc GROUP BY component) SELECT count(*) AS n_components, max(n) AS largest, min(n) AS smallest, round(avg(n), 6) AS average FROM s")
def wcc_stats(g):
    return A.component_stats(A.wcc(g))


@query(nxt, f"RECURSIVE , {STRONG} SELECT vid, component FROM sc")
def scc(g):
    return A.scc(g)


@query(nxt, f"RECURSIVE , {STRONG} SELECT src, dst FROM se")
def scc_dag(g):
    return A.condensation(g, A.scc(g))


@query(nxt, f"RECURSIVE , {LEVELS} SELECT vid, level FROM lv")
def scc_levels(g):
    parts = materialize(A.scc(g), "scc")
    return A.levels(A.condensed(g, parts))


def _asked(g) -> DataFrame:
    """The query set of searches: every vertex whose id is divisible by 20."""
    return g.vertices.where("vid % 20 = 0").select("vid")


@query(nxt, f"RECURSIVE , {CLOSED} SELECT s.vid AS src, t.vid AS dst, EXISTS (SELECT 1 FROM r WHERE r.a = s.vid AND r.b = t.vid) AS reachable FROM pv s, (SELECT min(vid) AS vid FROM pv GROUP BY community) t WHERE s.vid % 20 = 0")
def reachable(g):
    """Whether every asked part reaches the smallest part of each brand."""
    brands = g.vertices.groupBy("community").agg(F.min("vid").alias("vid")).agg(F.collect_list("vid").alias("firsts"))  # one id a brand
    return A.reachable(g, _asked(g).select(F.col("vid").alias("src")).join(F.broadcast(brands)).select("src", F.explode("firsts").alias("dst")))


@query(nxt, f"RECURSIVE , {HUB}, {walk()} SELECT distance AS position, vid FROM bf")
def shortest_path(g):
    """The path to the farthest vertex: no vertex has two edges out, so all that the start reaches lies on it."""
    h = _hub(g)
    far = A.bfs(g, h).orderBy(F.desc("distance"), "vid").first()["vid"]
    return A.shortest_path(g, h, far)


@query(part, f", {HUB} SELECT vid FROM pv WHERE community = (SELECT community FROM pv WHERE vid = (SELECT vid FROM hub))")
def community_search(g):
    return A.community_search(g, _hub(g))


@query(part, " , s AS (SELECT count(*) AS n FROM pv GROUP BY community) SELECT count(*) AS n_components, max(n) AS largest, min(n) AS smallest, round(avg(n), 6) AS average FROM s")
def community_stats(g):
    return A.component_stats(A.communities(g))


@query(part, f", {CROSS} SELECT src AS vid, cu AS community FROM c UNION SELECT dst, cv FROM c")
def boundary_vertices(g):
    return A.boundary_vertices(g)


@query(part, f", {CROSS} SELECT cu, cv, count(*) AS n_edges FROM c GROUP BY 1, 2")
def boundary_pairs(g):
    return A.boundary_pairs(g)


@query(nxt, f"RECURSIVE , {CROSS}, q AS (SELECT cu AS a, cv AS b FROM c UNION SELECT cv, cu FROM c), qr AS (SELECT DISTINCT community AS a, community AS b FROM pv UNION SELECT qr.a, q.b FROM qr JOIN q ON qr.b = q.a) SELECT CAST(a AS BIGINT) AS vid, CAST(min(b) AS BIGINT) AS component FROM qr GROUP BY a")
def quotient_wcc(g):
    return A.wcc(A.quotient(g))


@query(people, f"RECURSIVE , {WEAK} SELECT vid, component FROM wc")
def people_wcc(g):
    return A.wcc(g)


@query(people, f"RECURSIVE , {STRONG} SELECT vid, component FROM sc")
def people_scc(g):
    return A.scc(g)


@query(people, f"RECURSIVE , {HUB}, {walk()} SELECT vid, distance FROM bf")
def people_bfs(g):
    return A.bfs(g, _hub(g)).select("vid", "distance")


@query(part, f"RECURSIVE , {HUB}, {walk()} SELECT count(*) AS visited, max(distance) AS depth, round(avg(distance), 6) AS mean_distance FROM bf")
def bfs_stats(g):
    return A.bfs(g, _hub(g)).agg(F.count(F.lit(1)).alias("visited"), F.max("distance").alias("depth"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query(nxt, f"RECURSIVE , {HUB}, {walk('dst', 'src')} SELECT vid, distance FROM bf")
def bfs_reverse(g):
    return A.bfs(g, _hub(g), "in").select("vid", "distance")


_INSIDE = "m AS MATERIALIZED (SELECT vid FROM pv WHERE community = (SELECT community FROM pv WHERE vid = (SELECT vid FROM hub))), ie AS MATERIALIZED (SELECT src, dst FROM pe WHERE src IN (SELECT vid FROM m) AND dst IN (SELECT vid FROM m)), st AS MATERIALIZED (SELECT vid FROM hub WHERE vid IN (SELECT vid FROM m))"


@query(people, f"RECURSIVE , {HUB}, {_INSIDE}, {walk(edges='ie', start='st')} SELECT vid, distance FROM bf")
def bfs_in_community(g):
    h = _hub(g)
    own = g.vertices.where(F.col("vid") == h).first()["community"]
    return A.bfs(g, h, community=own if own is not None else -1).select("vid", "distance")


@query(nxt, f"RECURSIVE , {CROSS}, b AS (SELECT src AS v FROM c UNION SELECT dst FROM c), i AS (SELECT pe.src, pe.dst FROM pe JOIN pv a ON pe.src = a.vid JOIN pv z ON pe.dst = z.vid WHERE a.community = z.community), ir AS (SELECT vid AS s, vid AS t FROM pv UNION SELECT ir.s, i.dst FROM ir JOIN i ON ir.t = i.src), k AS (SELECT x.s AS vid, min(x.t) AS class FROM ir x JOIN ir y ON x.s = y.t AND x.t = y.s GROUP BY x.s) SELECT 'cross' AS kind, src, dst FROM c UNION ALL SELECT 'member', v, class FROM b JOIN k ON vid = v UNION ALL SELECT DISTINCT 'link', a.class, z.class FROM i JOIN k a ON i.src = a.vid JOIN k z ON i.dst = z.vid WHERE a.class <> z.class")
def enriched_boundary(g):
    return A.enriched_boundary(g)


@query(nxt, f"RECURSIVE , {LEVELS}, n AS (SELECT level, count(*) AS n FROM lv GROUP BY 1) SELECT (SELECT count(*) FROM lv) AS n_vertices, (SELECT count(*) FROM se) AS n_edges, CAST((SELECT max(level) + 1 FROM n) AS BIGINT) AS n_levels, (SELECT max(n) FROM n) AS widest, (SELECT max(k) FROM (SELECT count(*) AS k FROM se GROUP BY src)) AS max_out, (SELECT max(k) FROM (SELECT count(*) AS k FROM se GROUP BY dst)) AS max_in")
def dag_stats(g):
    dag = A.condensed(g, materialize(A.scc(g), "scc"))
    return A.dag_stats(dag)


@query(nxt, f"RECURSIVE , {CLOSED} SELECT a AS src, b AS dst FROM r WHERE a % 20 = 0 AND b IN (SELECT vid FROM pv WHERE price > 930)")
def closure_to_targets(g):
    return A.closure(g, _asked(g), g.vertices.where("price > 930").select("vid"))


# The same in distributed rounds, whatever the size: no task holds the graph. Strong components are peeled off until a thousand edges are left.


@query(people, f"RECURSIVE , {HUB}, {walk()} SELECT vid, distance FROM bf")
def rounds_bfs(g):
    return A.bfs(g, _hub(g), local_edges=0).select("vid", "distance")


@query(people, f"RECURSIVE , {WEAK} SELECT vid, component FROM wc")
def rounds_wcc(g):
    return A.wcc(g, 0)


@query(people, f"RECURSIVE , {STRONG} SELECT vid, component FROM sc")
def rounds_scc(g):
    return A.scc(g, 1000)


@query(people, f"RECURSIVE , {LEVELS} SELECT vid, level FROM lv")
def rounds_levels(g):
    return A.levels(A.condensed(g, materialize(A.scc(g, 1000), "scc")), 0)


@query(people, f"RECURSIVE , {HUB}, {walk()}, far AS (SELECT min(vid) AS vid FROM bf WHERE distance = (SELECT max(distance) FROM bf)), up(vid, position) AS (SELECT vid, (SELECT max(distance) FROM bf) FROM far UNION ALL SELECT min(b.vid), min(b.distance) FROM up JOIN pe ON pe.dst = up.vid JOIN bf b ON b.vid = pe.src AND b.distance = up.position - 1 HAVING count(*) > 0) SELECT position, vid FROM up")
def rounds_path(g):
    h = _hub(g)
    far = A.bfs(g, h, local_edges=0).orderBy(F.desc("distance"), "vid").first()["vid"]
    return A.shortest_path(g, h, far, 0)


@query(trade, " SELECT a.name AS buyer, r.name AS region FROM te x JOIN te y ON x.dst = y.src JOIN tv a ON a.vid = x.src JOIN tv r ON r.vid = y.dst WHERE x.label = 'in_nation' AND y.label = 'in_region'")
def select_names(g):
    return g.traversal().V().as_("buyer").out("in_nation").out("in_region").as_("region").select("buyer", "region", by="name")


@query(trade, " SELECT vid FROM tv WHERE label IN ('customer', 'supplier') AND NOT EXISTS (SELECT 1 FROM te WHERE te.src = vid AND te.label = 'buys_from')")
def coalesce_step(g):
    from loomgraph.functions.predicates import within as either

    return g.traversal().V().has("label", either("customer", "supplier")).coalesce(__.where(__.out("buys_from")).has("name", "nobody"), __.not_(__.out("buys_from"))).frame()


# -- second-order queries -------------------------------------------------------------------------------------------------------------


@query(part, " SELECT EXISTS (SELECT 1 FROM pe a JOIN pe b ON a.src = b.dst AND a.dst = b.src) AS holds")
def so_exists_exists(g):
    return SecondOrder(g).SecondOrder().exist("x").exist("y").filter("g.V(x).out().is(y) && g.V(y).out().is(x)").execute()


@query(part, " SELECT NOT EXISTS (SELECT 1 FROM pv WHERE vid NOT IN (SELECT src FROM pe) AND vid NOT IN (SELECT dst FROM pe)) AS holds")
def so_forall_exists(g):
    return SecondOrder(g).SecondOrder().forall("x").exist("y").filter("g.V(x).bothE().otherV().is(y)").execute()


@query(nation, " SELECT EXISTS (SELECT 1 FROM nv x WHERE NOT EXISTS (SELECT 1 FROM nv y WHERE x.vid <> y.vid AND NOT EXISTS (SELECT 1 FROM nu WHERE src = x.vid AND dst = y.vid))) AS holds")
def so_exists_forall(g):
    return SecondOrder(g).SecondOrder().exist("x").forall("y").filter("g.V(x).bothE().otherV().is(y) || g.V(x).is(y)").execute()


@query(part, " SELECT NOT EXISTS (SELECT 1 FROM pe a WHERE NOT EXISTS (SELECT 1 FROM pe b WHERE b.src = a.dst AND b.dst = a.src)) AS holds")
def so_forall_forall(g):
    return SecondOrder(g).SecondOrder().forall("x").forall("y").filter("!g.V(x).out().is(y) || g.V(y).out().is(x)").execute()


@query(nxt, f"RECURSIVE , {WEAK} SELECT component AS subset_id, vid FROM wc WHERE component IN (SELECT component FROM wc GROUP BY 1 HAVING count(*) > 1)")
def wcc_filter(g):
    return SecondOrder(g).WCC().forall("x").exist("y").filter("g.V(x).bothE().otherV().is(y)").having("size > 1").members()


@query(nxt, f"RECURSIVE , {STRONG} SELECT component AS subset_id, vid FROM sc WHERE component NOT IN (SELECT x.component FROM sc x WHERE NOT EXISTS (SELECT 1 FROM pe JOIN sc y ON pe.dst = y.vid WHERE pe.src = x.vid AND y.component = x.component))")
def scc_filter(g):
    return SecondOrder(g).SCC().forall("x").exist("y").filter("g.V(x).out().is(y)").members()


@query(nxt, f"RECURSIVE , {STRONG}, k AS (SELECT component, count(*) AS n FROM sc GROUP BY 1) SELECT component AS subset_id, n AS size FROM k WHERE n <= 3 AND component IN (SELECT a.component FROM sc a JOIN pv ON a.vid = pv.vid WHERE pv.price > 950)")
def scc_exists_price(g):
    return SecondOrder(g).SCC().exist("x").filter("g.V(x).has('price', gt(950))").having("size <= 3").sizes()


@query(part, " SELECT CAST(pv.community AS BIGINT) AS subset_id, count(*) AS size FROM pv WHERE community IN (SELECT a.community FROM pe JOIN pv a ON pe.src = a.vid JOIN pv b ON pe.dst = b.vid WHERE a.community = b.community) GROUP BY 1")
def community_filter(g):
    return SecondOrder(g).Community().exist("x").exist("y").filter("g.V(x).out().is(y)").sizes()


@query(people, " , k AS (SELECT community, count(*) AS n FROM pv WHERE community IS NOT NULL GROUP BY 1) SELECT CAST(community AS BIGINT) AS subset_id, n AS size FROM k WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.community = k.community AND vid NOT IN (SELECT src FROM pe))")
def community_all_have_out(g):
    return SecondOrder(g).Community().forall("x").filter("g.V(x).out()").sizes()


def _mask():
    return F.aggregate("vids", F.lit(0).cast("long"), lambda a, v: a + F.pow(F.lit(2), v).cast("long")).alias("mask")


def _masked(found: DataFrame) -> DataFrame:
    return found.select(_mask(), "size")


def _listed(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("vids", ",").alias("vids"), "size")


#: Sets grown by one later vertex at a time, as bit masks; ``{}`` is the test of a mask against the neighbours of the new vertex.
_GROWN = "RECURSIVE , k AS (SELECT CAST(0 AS BIGINT) AS mask, CAST(-1 AS BIGINT) AS last UNION ALL SELECT mask | (CAST(1 AS BIGINT) << vid), vid FROM k JOIN near ON vid > last WHERE {}), s AS (SELECT mask, CAST(bit_count(mask) AS INT) AS size FROM k)"
_CLIQUES, _APART = _GROWN.format("(mask & others) = mask"), _GROWN.format("(mask & others) = 0")
_CLIQUE, _LONERS = "g.V(x).bothE().otherV().is(y) || g.V(x).is(y)", "g.V(x).bothE().otherV().is(y).count().is(0) || g.V(x).is(y)"


@query(nation, _CLIQUES + " SELECT mask, size FROM s")
def vset_cliques(g):
    return _masked(SecondOrder(g).Vset().forall("x").forall("y").filter(_CLIQUE).execute())


@query(nation, _APART + " SELECT mask, size FROM s WHERE size > 1")
def vset_independent(g):
    return _masked(SecondOrder(g).Vset().forall("x").forall("y").filter(_LONERS).having("size > 1").execute())


@query(nation, " SELECT (CAST(1 AS BIGINT) << a.vid) | (CAST(1 AS BIGINT) << b.vid) AS mask, CAST(2 AS INT) AS size FROM nv a JOIN nv b ON a.vid < b.vid")
def vset_size2(g):
    return _masked(SecondOrder(g).Vset().having("size == 2").execute())


@query(nation, _CLIQUES + ", h AS (SELECT s.mask, vid FROM s JOIN nv ON (mask >> vid) & 1 = 1 WHERE size >= 2) SELECT h.mask, count(*) AS n_vertices, (SELECT count(*) FROM ne JOIN h a ON a.vid = ne.src AND a.mask = h.mask JOIN h b ON b.vid = ne.dst AND b.mask = h.mask) AS n_edges FROM h GROUP BY 1")
def serialize_counts(g):
    found = SecondOrder(g).Vset().forall("x").forall("y").filter(_CLIQUE).having("size >= 2").execute()
    found = materialize(found, "subsets")
    members = found.select("subset_id", F.explode("vids").alias("vid"))
    return subset_counts(g, members).join(found.select("subset_id", _mask()), "subset_id").select("mask", "n_vertices", "n_edges")


#: The sets of the market graph, mask by mask; ``{}`` is the sentence about the mask ``m``.
_SETS = " SELECT coalesce((SELECT string_agg(h.vid, ',' ORDER BY h.vid) FROM held h WHERE h.mask = m.mask), '') AS vids, size FROM masks m WHERE {}"


@query(market, _SETS.format("NOT EXISTS (SELECT 1 FROM held x WHERE x.mask = m.mask AND NOT EXISTS (SELECT 1 FROM held y JOIN me ON me.src = x.vid AND me.dst = y.vid WHERE y.mask = m.mask))"))
def vset_forall_exists(g):
    return _listed(SecondOrder(g).Vset().forall("x").exist("y").filter("g.V(x).out().is(y)").execute())


@query(market, _SETS.format("EXISTS (SELECT 1 FROM held x WHERE x.mask = m.mask AND NOT EXISTS (SELECT 1 FROM held y WHERE y.mask = m.mask AND y.vid <> x.vid AND NOT EXISTS (SELECT 1 FROM me WHERE me.src = x.vid AND me.dst = y.vid)))"))
def vset_exists_forall(g):
    return _listed(SecondOrder(g).Vset().exist("x").forall("y").filter("g.V(x).out().is(y) || g.V(x).is(y)").execute())


@query(market, _SETS.format("EXISTS (SELECT 1 FROM held x JOIN held y ON x.mask = y.mask JOIN me ON me.src = x.vid AND me.dst = y.vid WHERE x.mask = m.mask) AND size <= 4"))
def vset_exists_exists(g):
    return _listed(SecondOrder(g).Vset().exist("x").exist("y").filter("g.V(x).out().is(y)").having("size <= 4").execute())


@query(market, _SETS.format("NOT EXISTS (SELECT 1 FROM held x JOIN held y ON x.mask = y.mask JOIN held z ON x.mask = z.mask JOIN me a ON a.src = x.vid AND a.dst = y.vid JOIN me b ON b.src = y.vid AND b.dst = z.vid WHERE x.mask = m.mask AND z.vid = x.vid)"))
def vset_three_variables(g):
    """Sets without a region and a segment that lead to each other."""
    return _listed(SecondOrder(g).Vset().forall("x").forall("y").forall("z").filter("!(g.V(x).out().is(y) && g.V(y).out().is(z) && g.V(z).is(x))").execute())
