"""Traversal steps, nested scopes, lookups and mutations over graph views of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.predicates import gt, gte
from loomgraph.operators import algorithms as A
from loomgraph.operators import mutation as M
from loomgraph.operators.index import GraphIndex
from loomgraph.operators.second_order import SecondOrder
from loomgraph.operators.traversal import __, together
from loomgraph.plans.tasks import run_task
from loomgraph.queries.base import CROSS, HUB, LEVELS, ORACLE, QUERIES, STRONG, WEAK, nxt, part, people, query, sizes, trade, walk  # noqa: F401
from loomgraph.sources.views import CUSTOMER, NATION, REGION
from loomgraph.storage import materialize, scratch, table

# -- reads ------------------------------------------------------------------------------------------------------------------


@query(trade, f" SELECT dst AS vid FROM te WHERE src = {NATION + 4}")
def out_neighbours(g):
    return g.out_neighbours(NATION + 4)


@query(people, " SELECT src AS vid, count(*) AS out_degree FROM pe GROUP BY src HAVING count(*) >= 128")
def giant_vertices(g):
    return g.giant_vertices()


@query(trade, f" SELECT vid + 7 AS vid, vid + 7 IN (SELECT vid FROM tv) AS \"exists\" FROM tv")
def has_vertex(g):
    return g.has_vertex(g.vertices.select((F.col("vid") + 7).alias("vid")))


@query(people, " SELECT pv.vid, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM pe WHERE src = pv.vid), '') AS neighbours FROM pv")
def adjacency_lists(g):
    return g.adjacency().select("vid", F.array_join("neighbours", ",").alias("neighbours"))


@query(people, " SELECT src AS vid, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM pe WHERE src IN (SELECT vid FROM pv WHERE community = 1) GROUP BY 1 UNION ALL SELECT vid, '' FROM pv WHERE community = 1 AND vid NOT IN (SELECT src FROM pe)")
def adjacency_of_members(g):
    return g.adjacency(g.vertices.where("community = 1").select("vid")).select("vid", F.array_join("neighbours", ",").alias("neighbours"))


@query(trade, " SELECT CAST(vid AS VARCHAR) AS id, 'segment' AS key, segment AS value FROM tv WHERE segment IS NOT NULL")
def list_properties(g):
    return M.list_properties(g, "seg")


@query(trade, " SELECT vid, CASE WHEN balance >= 0 THEN segment END AS segment FROM tv")
def remove_property(g):
    return M.remove_property(g, g.vertices.where("balance < 0 OR balance IS NULL").select("vid"), "segment").vertices.select("vid", "segment")


@query(trade, " SELECT vid, name, balance FROM tv")
def drop_property(g):
    return M.drop_property(g, "segment").vertices.drop("id", "label", "community")


@query(trade, " SELECT (SELECT count(*) FROM tv) AS n_vertices, (SELECT count(*) FROM te) AS n_edges")
def cached_counts(g):
    return g.cache().counts()


@query(trade, """ SELECT 'vertex' AS kind, CAST(vid AS VARCHAR) AS id, label, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS target, name, segment FROM tv
 UNION ALL SELECT 'edge', NULL, label, src, dst, NULL, NULL FROM te""")
def snapshot_rows(g):
    return g.snapshot().select("kind", F.when(F.col("kind") == "vertex", F.col("id")).alias("id"), "label", "source", "target", F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.segment").alias("segment"))


# -- steps ------------------------------------------------------------------------------------------------------------------


@query(trade, f" SELECT x.vid FROM te JOIN (SELECT {REGION} AS vid UNION ALL SELECT {REGION + 1}) x ON true WHERE te.label = 'in_nation' AND te.dst = {NATION + 1}")
def mid_v(g):
    return g.traversal().V(NATION + 1).in_("in_nation").V(REGION, REGION + 1).frame()


@query(trade, " SELECT src, dst FROM te WHERE label = 'in_nation'")
def inE(g):
    return g.traversal().V().inE("in_nation").frame()


@query(trade, " SELECT name AS value FROM tv WHERE name IS NOT NULL")
def value(g):
    return g.traversal().V().value("name").frame()


@query(trade, " SELECT CAST(vid AS VARCHAR) AS value FROM tv WHERE label = 'supplier'")
def id_step(g):
    return g.traversal().V().hasLabel("supplier").id().frame()


@query(trade, " SELECT label AS value FROM te")
def label_step(g):
    return g.traversal().E().label().frame()


@query(trade, " SELECT (SELECT count(*) FROM tv) AS people, (SELECT round(sum(balance), 2) FROM tv) AS money, (SELECT max(balance) FROM tv) AS most")
def map_of_traversals(g):
    t = g.traversal()
    return together(people=t.V().count(), money=t.V().values("balance").sum(), most=t.V().values("balance").max()).withColumn("money", F.round("money", 2))


@query(trade, " SELECT vid, '{\"name\":[\"' || name || '\"]' || CASE WHEN segment IS NULL THEN '' ELSE ',\"segment\":[\"' || segment || '\"]' END || '}' AS properties FROM tv")
def value_map_values(g):
    t = g.traversal().V()
    return t.valueMap("name", "segment", tokens=True).select(F.col("id").cast("long").alias("vid"), "properties")


@query(trade, " SELECT min(vid) AS value FROM tv")
def next_value(g):
    t = g.traversal().V().iterate()
    return g.spark.createDataFrame([(t.order("id").next(),)], "value long")


@query(trade, " SELECT least(50, count(*)) AS n FROM tv")
def sample_size(g):
    return g.traversal().V().sample(50).count().frame().select(F.col("count").alias("n"))


@query(trade, " SELECT true AS near_a_half")
def coin_share(g):
    kept, whole = g.traversal().V().coin(0.5).count().frame(), g.traversal().V().count().frame().toDF("whole")
    return kept.join(whole).select((F.abs(F.col("count") / F.col("whole") - 0.5) < 0.1).alias("near_a_half"))  # one row each


@query(trade, " SELECT vid FROM tv WHERE EXISTS (SELECT 1 FROM te WHERE src = vid)")
def where_dedup(g):
    return g.traversal().V().where(__.out().dedup()).frame()


@query(trade, " SELECT vid FROM tv WHERE (SELECT count(*) FROM te WHERE src = vid) >= 40")
def where_dedup_count(g):
    return g.traversal().V().where(__.out().dedup().count().is_(gte(40))).frame()


@query(trade, " SELECT vid FROM tv WHERE EXISTS (SELECT 1 FROM te WHERE src = vid)")
def where_limit(g):
    return g.traversal().V().where(__.out().limit(1)).frame()


@query(trade, " SELECT vid FROM tv WHERE (SELECT count(*) FROM te WHERE src = vid) > 10")
def where_skip(g):
    return g.traversal().V().where(__.out().skip(10)).frame()


@query(trade, " SELECT min(dst) AS vid FROM te GROUP BY src")
def local_limit(g):
    return g.traversal().V().local(__.out().limit(1)).frame()


@query(trade, " SELECT te.dst AS vid FROM te WHERE te.label = 'buys_from' QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst DESC) <= 2")
def local_tail(g):
    return g.traversal().V().hasLabel("customer").local(__.out("buys_from").tail(2)).frame()


@query(sizes, " SELECT max(vid) AS vid FROM zv")
def repeat_until(g):
    """From the smallest size along the chain of all sizes, more than thirty hops, to the one without a larger."""
    first = g.vertices.agg(F.min("vid")).first()[0]
    return g.traversal().V(first).repeat(__.out(), until=__.not_(__.out())).frame()


@query(sizes, " SELECT vid FROM zv WHERE vid > (SELECT min(vid) FROM zv) AND vid <= (SELECT min(vid) + 12 FROM zv)")
def repeat_until_emit(g):
    first = g.vertices.agg(F.min("vid")).first()[0]
    return g.traversal().V(first).repeat(__.out(), until=__.hasId(first + 12), emit=True).frame()


@query(sizes, " SELECT b.dst AS vid FROM ze a JOIN ze b ON a.dst = b.src")
def repeat_loops(g):
    return g.traversal().V().repeat(__.out(), until=__.loops().is_(2)).frame()


@query(trade, " SELECT DISTINCT dst AS vid FROM te WHERE label = 'in_nation' EXCEPT SELECT te.dst FROM te JOIN tv ON src = vid WHERE te.label = 'in_nation' AND tv.label = 'customer' AND balance > 9990")
def aggregate_without(g):
    rich = g.traversal().V().hasLabel("customer").has("balance", gt(9990.0)).out("in_nation").aggregate("rich")
    return rich._new(g.traversal().V().out("in_nation").dedup().df).without("rich").frame()


@query(trade, " SELECT string_agg(name, ',' ORDER BY name) AS names FROM tv WHERE label = 'region'")
def store_cap(g):
    return g.traversal().V().hasLabel("region").values("name").store("x").cap("x").frame().select(F.array_join("fold", ",").alias("names"))


@query(trade, " SELECT name AS value FROM tv WHERE label = 'region' UNION ALL SELECT 'more'")
def inject_unfold(g):
    t = g.traversal()
    return t.V().hasLabel("region").values("name").frame().union(t.inject(["more"]).unfold().frame())


@query(trade, " SELECT round(balance * 2 + 1, 4) AS value FROM tv WHERE label = 'supplier'")
def math_step(g):
    return g.traversal().V().hasLabel("supplier").values("balance").math(lambda x: F.round(x * 2 + 1, 4)).frame()


@query(trade, " SELECT 1 AS value FROM tv")
def constant_step(g):
    return g.traversal().V().constant(1).frame()


@query(trade, " SELECT w AS word, i AS at FROM (SELECT unnest(string_split(name, '#')) AS w, unnest(range(len(string_split(name, '#')))) AS i FROM tv)")
def index_step(g):
    t = g.traversal().V().values("name").split("#").index().unfold()
    return t.df.select(F.col("_x.value").alias("word"), F.col("_x.index").cast("long").alias("at"))


@query(trade, " SELECT upper(replace(substring(name, 1, 6), 'e', '-')) || '!' AS value FROM tv WHERE label IN ('customer', 'supplier', 'nation')")
def text_steps(g):
    t = g.traversal().V().or_(__.hasLabel("customer"), __.hasLabel("supplier"), __.hasLabel("nation")).values("name")
    return t.substring(0, 6).replace("e", "-").toUpper().concat("!").frame()


@query(trade, " SELECT length(trim(name || '  ')) AS value FROM tv")
def text_lengths(g):
    return g.traversal().V().values("name").concat("  ").trim().length().frame()


@query(trade, " SELECT list_sort(list_distinct(['a', name]))[1] AS least, 2 + (name <> 'a')::INT - 1 AS n FROM tv WHERE label = 'nation'")
def list_steps(g):
    t = g.traversal().V().hasLabel("nation").values("name").map(lambda x: F.array(x)).merge(["a"])
    return t.df.select(F.get("_x", F.lit(0)).alias("least"), F.size("_x").alias("n"))


@query(trade, " SELECT name || '+z' AS value FROM tv WHERE label = 'region'")
def list_join(g):
    t = g.traversal().V().hasLabel("region").values("name").map(lambda x: F.array(x, F.lit("y"))).difference(["y"]).combine(["z"])
    return t.conjoin("+").frame()


@query(trade, " SELECT CAST(86400 * n_nationkey AS BIGINT) AS value FROM nation")
def date_steps(g):
    start = F.to_timestamp(F.lit("2024-01-01"))
    t = g.traversal().V().hasLabel("nation").id().map(lambda x: F.timestamp_add("DAY", (x.cast("long") - NATION).cast("int"), start))
    return t.dateAdd("DAY", 1).dateDiff("2024-01-02").frame()


@query(trade, " SELECT (SELECT count(*) FROM te WHERE label = 'in_region') AS n_edges, (SELECT count(*) FROM (SELECT src FROM te WHERE label = 'in_region' UNION SELECT dst FROM te WHERE label = 'in_region')) AS n_vertices")
def subgraph_step(g):
    return g.traversal().E().hasLabel("in_region").subgraph().counts()


@query(trade, """ , p AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM te a JOIN te b ON a.dst = b.src JOIN tv ON a.src = tv.vid WHERE tv.label = 'supplier')
 SELECT 0 AS depth, CAST(x AS VARCHAR) AS path, count(*) AS n FROM p GROUP BY x UNION ALL SELECT 1, x || ',' || y, count(*) FROM p GROUP BY x, y UNION ALL SELECT 2, x || ',' || y || ',' || z, count(*) FROM p GROUP BY x, y, z""")
def tree_step(g):
    return g.traversal().V().hasLabel("supplier").with_path().out().out().tree().select("depth", F.array_join("path", ",").alias("path"), "n")


@query(trade, " SELECT count(*) AS rows, true AS timed FROM te")
def profile_step(g):
    return g.traversal().V().outE().profile().select("rows", ((F.col("seconds") > 0) & (F.length("plan") > 0)).alias("timed"))


@query(people, " SELECT a.src || ',' || a.dst || ',' || a.src AS path FROM pe a JOIN pe b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst UNION ALL SELECT a.src || ',' || a.src || ',' || b.dst FROM pe a JOIN pe b ON b.src = a.src WHERE a.src = a.dst UNION ALL SELECT a.src || ',' || a.dst || ',' || a.dst FROM pe a JOIN pe b ON b.src = a.dst AND b.dst = a.dst WHERE a.src <> a.dst")
def cyclic_path(g):
    return g.traversal().V().with_path().out().out().cyclicPath().path().select(F.concat_ws(",", "path").alias("path"))


# -- second-order filters with scoped steps -------------------------------------------------------------------------------------


@query(trade, f" SELECT NOT EXISTS (SELECT 1 FROM tv WHERE label <> 'region' AND vid NOT IN (SELECT src FROM te)) AS holds")
def so_dedup(g):
    return SecondOrder(g).SecondOrder().forall("x").exist("y").filter("g.V(x).out().dedup().is(y) || g.V(x).hasLabel('region') && g.V(y).hasLabel('region')").execute()


@query(trade, " SELECT NOT EXISTS (SELECT 1 FROM tv WHERE vid NOT IN (SELECT src FROM te)) AS holds")
def so_limit(g):
    return SecondOrder(g).SecondOrder().forall("x").filter("g.V(x).out().limit(1)").execute()


@query(trade, " SELECT EXISTS (SELECT 1 FROM te GROUP BY src HAVING count(*) >= 40) AS holds")
def so_dedup_count(g):
    return SecondOrder(g).SecondOrder().exist("x").filter("g.V(x).out().dedup().count().is(gte(40))").execute()


@query(nxt, f"RECURSIVE , {WEAK}, t AS (SELECT dst AS vid FROM pe GROUP BY dst HAVING count(*) >= 2) SELECT component AS subset_id, count(*) AS size FROM wc GROUP BY 1 HAVING count(*) > 1 AND bool_or(vid IN (SELECT vid FROM t))")
def wcc_dedup_filter(g):
    return SecondOrder(g).WCC().exist("x").filter("g.V(x).in().dedup().skip(1)").having("size > 1").sizes()


# -- mutations ------------------------------------------------------------------------------------------------------------------


@query(trade, " SELECT vid, label, name FROM tv UNION ALL SELECT (SELECT max(vid) FROM tv) + row_number() OVER (), 'part', CAST(NULL AS VARCHAR) FROM part")
def add_vertices(g, folder):
    rows = table(g.spark, folder, "part").select(F.lit("part").alias("label"), F.col("p_name").alias("name"))
    return M.add_vertices(g, rows).vertices.select("vid", "label", F.when(F.col("label") != "part", F.col("name")).alias("name"))


@query(trade, f" SELECT CAST(vid AS VARCHAR) AS id, label FROM tv UNION ALL SELECT 'brand:' || p_brand, 'brand' FROM (SELECT DISTINCT p_brand FROM part)")
def merge_vertices(g, folder):
    brands = table(g.spark, folder, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("id")).distinct()
    known = g.vertices.where("label = 'customer'").select("id")
    return M.merge_vertices(g, brands.unionByName(known).withColumn("label", F.lit("brand"))).vertices.select("id", "label")


@query(trade, " SELECT src, dst, label FROM te UNION ALL SELECT dst, src, 'back' FROM te")
def merge_edges(g):
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return M.merge_edges(g, back.unionByName(g.edges.select("src", "dst")).withColumn("label", F.lit("back"))).edges.select("src", "dst", "label")


@query(trade, f" SELECT src, dst FROM te WHERE label <> 'buys_from'")
def drop_edges(g):
    return g.traversal().E().hasLabel("buys_from").drop().edges.select("src", "dst")


# -- algorithms: lookups, samples, tasks ------------------------------------------------------------------------------------------


@query(people, f"RECURSIVE , b(origin, vid) AS (SELECT vid, vid FROM pv WHERE vid % 20 = 0 UNION SELECT b.origin, pe.dst FROM b JOIN pe ON pe.src = b.vid), n AS (SELECT origin, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS samples, min(n) AS least, max(n) AS most, round(avg(n), 6) AS average FROM n")
def bfs_samples(g):
    return A.bfs_samples(g, g.vertices.where("vid % 20 = 0").select("vid"), depth=False)


@query(part, f"RECURSIVE , {CROSS}, st AS (SELECT min(src) AS vid FROM c), {walk(edges='c', start='st')} SELECT vid, distance FROM bf")
def boundary_bfs(g):
    return A.boundary_bfs(g, A.cross_edges(g).agg(F.min("src")).first()[0]).select("vid", "distance")


@query(nxt, f"RECURSIVE , {HUB}, {walk()} SELECT distance AS position, vid FROM bf")
def pruned_path(g):
    top = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    far = A.bfs(g, top).orderBy(F.desc("distance"), "vid").first()["vid"]
    return A.pruned_path(g, top, far)


@query(nxt, f"RECURSIVE , {STRONG}, st AS (SELECT component AS vid FROM sc WHERE vid = (SELECT vid FROM hub)), {walk(edges='se', start='st')} SELECT vid AS component, distance FROM bf")
def dag_bfs(g):
    parts = materialize(A.scc(g), "scc")
    top = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    return A.dag_bfs(g, parts, parts.where(F.col("vid") == top).first()["component"])


@query(nxt, f"RECURSIVE , {STRONG}, st AS (SELECT component AS vid FROM sc WHERE vid = (SELECT vid FROM hub)), {walk(edges='se', start='st')} SELECT distance AS position, vid AS component FROM bf")
def dag_path(g):
    parts = materialize(A.scc(g), "scc")
    top = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    start = parts.where(F.col("vid") == top).first()["component"]
    far = A.dag_bfs(g, parts, start).orderBy(F.desc("distance"), "component").first()["component"]
    return A.dag_path(g, parts, start, far)


@query(nxt, f"RECURSIVE , {LEVELS}, {CROSS}, e AS (SELECT src AS vid FROM c UNION SELECT dst FROM c) SELECT sc.vid, pv.community, sc.component, lv.level, sc.vid IN (SELECT vid FROM e) AS is_boundary FROM sc JOIN lv ON sc.component = lv.vid JOIN pv ON pv.vid = sc.vid")
def saved_index(g):
    """The index written, read back and asked about every vertex."""
    path = scratch(g.spark, "index")
    GraphIndex.build(g).save(path)
    index = GraphIndex.load(g.spark, path)
    return index.places.join(index.is_boundary(g.vertices), "vid")


@query(nxt, f"RECURSIVE , {LEVELS}, big AS (SELECT component FROM sc GROUP BY 1 HAVING count(*) > 1) SELECT sc.component, sc.vid, (SELECT level FROM lv WHERE lv.vid = sc.component) AS level FROM sc WHERE component IN (SELECT component FROM big)")
def scc_lookups(g):
    index = GraphIndex.build(g)
    big = index.places.groupBy("component").count().where("count > 1").select("component")
    return index.members_of(big).join(index.component_levels(), "component").select("component", "vid", "level")


@query(nxt, f"RECURSIVE , {LEVELS} SELECT vid AS component FROM lv WHERE level = 1")
def sccs_at_level(g):
    return GraphIndex.build(g).at_level(1)


@query(nxt, f", {CROSS} SELECT src AS vid, dst AS neighbour FROM c WHERE src % 20 = 0")
def neighbour_boundaries(g):
    return GraphIndex.build(g).neighbour_boundaries(g.vertices.where("vid % 20 = 0"))


@query(part, f"RECURSIVE , {HUB}, {WEAK}, {walk()}, {CROSS} SELECT 'bfs' AS task, count(*) AS n FROM bf UNION ALL SELECT 'wcc', count(*) FROM wc UNION ALL SELECT 'scc', count(*) FROM pv UNION ALL SELECT 'analysis', (SELECT count(*) FROM (SELECT src FROM c UNION SELECT dst FROM c))")
def tasks(g):
    top = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    n = lambda name, text: run_task(g, text).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("task"), "n")
    return n("bfs", f"bfs {top}").union(n("wcc", "wcc")).union(n("scc", "scc")).union(run_task(g, "analysis").select(F.lit("analysis"), "n_boundary"))
