"""Sources, sinks, results for clients and streams: test tables written in every format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.config import Options
from loomgraph.model import PropertyGraph
from loomgraph.operators.result import serialize, web_result
from loomgraph.operators.second_order import SecondOrder
from loomgraph.queries.base import ORACLE, QUERIES, nation, nxt, people, query, trade  # noqa: F401
from loomgraph.sources.graph_file import read_graph, register, write_graph
from loomgraph.sources.properties import GraphStore, attach_edge_properties, attach_vertex_properties, read_properties, synthetic
from loomgraph.storage import materialize, scratch, table
from loomgraph.streaming import deltas

# -- topology files -----------------------------------------------------------------------------------------------------------


def _text_graph(g) -> str:
    path = scratch(g.spark, "text") + ".graph"
    write_graph(g, path)
    return path


@query(nxt, " SELECT src, dst FROM pe")
def graph_file_edges(g):
    return read_graph(g.spark, _text_graph(g)).edges.select("src", "dst")


@query(nxt, " SELECT vid, community FROM pv")
def graph_file_vertices(g):
    return read_graph(g.spark, _text_graph(g)).vertices.select("vid", "community")


@query(nxt, " SELECT src, dst FROM pe")
def graph_format_edges(g):
    register(g.spark)
    return g.spark.read.format("graph").load(_text_graph(g))


# -- property files -----------------------------------------------------------------------------------------------------------


def _written(old: DataFrame, new: DataFrame, kind: str) -> str:
    """A folder of property files, the new rows in files written after those of the old rows."""
    path = scratch(old.sparkSession, "properties") + f".{kind}"
    for rows, mode in ((old, "overwrite"), (new, "append")):
        writer = rows.write.mode(mode)
        writer.csv(path, header=True, escape='"') if kind == "csv" else writer.json(path)
    return path


def _vertex_file(g, kind: str) -> DataFrame:
    """Every vertex twice, first with values that the later row replaces, also where the later one is smaller or absent."""
    v = g.vertices.select(F.col("vid").alias("vertex"), "label", "name", "balance", "segment")
    old = v.withColumns({"name": F.lit("zzz"), "balance": F.lit(1e9), "segment": F.lit("old")})
    rows = read_properties(g.spark, _written(old, v, kind), ("vertex",), multi_line=False)
    bare = PropertyGraph(g.vertices.select("vid"), g.edges)
    return attach_vertex_properties(bare, rows).vertices.select("vid", "label", "name", F.round("balance", 2).alias("balance"), "segment")


_VERTEX_ROWS = " SELECT vid, label, name, round(balance, 2) AS balance, segment FROM tv"
_EDGE_ROWS = " SELECT src, dst, label FROM te"


@query(trade, _VERTEX_ROWS)
def vertex_csv(g):
    return _vertex_file(g, "csv")


@query(trade, _VERTEX_ROWS)
def vertex_json(g):
    return _vertex_file(g, "json")


def _edge_file(g, kind: str) -> DataFrame:
    e = g.edges.select(F.col("src").alias("outVertex"), F.col("dst").alias("inVertex"), "label")
    strangers = e.limit(0).unionByName(g.vertices.where("label = 'region'").select(F.col("vid").alias("outVertex"), F.col("vid").alias("inVertex"), F.lit("loop").alias("label")))
    rows = read_properties(g.spark, _written(e.withColumn("label", F.lit("zzz")), e.unionByName(strangers), kind), ("outVertex", "inVertex"), multi_line=False)
    return attach_edge_properties(PropertyGraph(g.vertices, g.edges.select("src", "dst")), rows).edges.select("src", "dst", "label")


@query(trade, _EDGE_ROWS)
def edge_csv(g):
    return _edge_file(g, "csv")


@query(trade, _EDGE_ROWS)
def edge_json(g):
    return _edge_file(g, "json")


@query(trade, " SELECT 'csv' AS suffix, count(*) AS n FROM tv UNION ALL SELECT 'json', count(*) FROM tv UNION ALL SELECT 'txt', 0")
def file_suffixes(g):
    v = g.vertices.select(F.col("vid").alias("vertex"), "name")
    out = None
    for kind in ("csv", "json", "txt"):
        path = _written(v, v, kind) if kind != "txt" else "properties.txt"
        rows = read_properties(g.spark, path, ("vertex",), multi_line=False)
        one = g.spark.range(1).select(F.lit(kind).alias("suffix"), F.lit(0).cast("long").alias("n")) if rows is None else rows.agg(F.lit(kind).alias("suffix"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# -- stored graphs ------------------------------------------------------------------------------------------------------------


@query(trade, _EDGE_ROWS)
def save_load(g):
    path = scratch(g.spark, "graph")
    g.save(path)
    return PropertyGraph.load(g.spark, path).edges.select("src", "dst", "label")


@query(trade, " SELECT 'new' AS step, CAST(0 AS BIGINT) AS n_vertices, CAST(0 AS BIGINT) AS n_edges UNION ALL SELECT 'saved', (SELECT count(*) FROM tv), (SELECT count(*) FROM te) UNION ALL SELECT 'smaller', (SELECT count(*) FROM tv), (SELECT count(*) FROM te WHERE label <> 'buys_from')")
def store_reload(g):
    store = GraphStore(g.spark, scratch(g.spark, "store"))
    one = lambda step, graph: materialize(graph.counts().select(F.lit(step).alias("step"), "n_vertices", "n_edges"), "counts")
    new = one("new", store.open("trade"))
    saved = one("saved", store.save("trade", g))
    less = store.open("trade").traversal().E().hasLabel("buys_from").drop()
    store.save("trade", less)
    return new.union(saved).union(one("smaller", store.reload("trade")))


@query(nxt, " SELECT vid, community, name FROM pv")
def upload(g):
    """The files of a graph, as a client sends them."""
    names = g.vertices.select(F.col("vid").alias("vertex"), "name")
    path = _written(names.withColumn("name", F.lit("old")), names, "csv")
    return GraphStore(g.spark, scratch(g.spark, "store")).upload("parts", _text_graph(g), path).vertices.select("vid", "community", "name")


def synthetic_graph(spark, folder):
    g = synthetic(spark)
    v = g.vertices.agg(F.count(F.lit(1)).alias("n_vertices"), F.min("age").alias("youngest"), F.max("age").alias("oldest"), F.min("vid").alias("first"))
    return v.join(g.edges.agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"), (F.count(F.lit(1)) > 19_000).alias("enough")))  # one row each


QUERIES["synthetic_graph"] = synthetic_graph
ORACLE["synthetic_graph"] = "SELECT 10000 AS n_vertices, 18 AS youngest, 77 AS oldest, 1 AS first, 0 AS loops, true AS enough"


def storage_options(spark, folder):
    o = Options.parse("# defaults\nblock_size: 512\nlocal_edges: 9\n").with_table(table(spark, folder, "storage_options"))
    o = Options.parse(o.dump())
    return spark.createDataFrame([(o.giant_vertex_boundary, o.block_size, o.local_edges)], "giant_vertex_boundary long, block_size long, local_edges long")


QUERIES["storage_options"] = storage_options
ORACLE["storage_options"] = """SELECT max(CASE WHEN option_name = 'giant_vertex_boundary' THEN option_value END) AS giant_vertex_boundary, max(CASE WHEN option_name = 'block_size' THEN option_value END) AS block_size, 9 AS local_edges FROM storage_options"""

# -- results for clients --------------------------------------------------------------------------------------------------------

_REGIONS = " , h AS (SELECT n_regionkey AS subset_id, vid FROM nv) SELECT subset_id, count(*) AS size, string_agg(vid, ',' ORDER BY vid) AS vertices"


@query(nation, f"{_REGIONS}, string_agg((SELECT name FROM nv WHERE nv.vid = h.vid), ',' ORDER BY vid) AS names, coalesce((SELECT string_agg(src || '>' || dst, ',' ORDER BY src, dst) FROM ne JOIN h a ON a.vid = src JOIN h b ON b.vid = dst AND b.subset_id = a.subset_id WHERE a.subset_id = h.subset_id), '') AS edges FROM h GROUP BY subset_id")
def serialized(g):
    """Regions as subsets, with the properties of their nations and the edges between them."""
    rows = serialize(g, SecondOrder(g).Community().execute())
    return rows.select(
        "subset_id", "size", F.array_join(F.transform("vertices", lambda v: v["id"]), ",").alias("vertices"), F.array_join(F.transform("vertices", lambda v: F.get_json_object(v["properties"], "$.name")), ",").alias("names"),
        F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["source"], e["target"])), ",").alias("edges"),
    )


@query(nation, f"{_REGIONS} FROM h GROUP BY subset_id")
def serialized_vertices(g):
    rows = serialize(g, SecondOrder(g).Community().execute(), edges=False)
    return rows.select("subset_id", "size", F.array_join(F.transform("vertices", lambda v: v["id"]), ",").alias("vertices"))


@query(nation, " SELECT 'VsetResult' AS type, count(*) AS size, string_agg(vid, ',' ORDER BY vid) AS vertices, (SELECT count(DISTINCT n_regionkey) FROM nv) AS total, (SELECT count(*) FROM ne JOIN nv a ON a.vid = src JOIN nv b ON b.vid = dst WHERE a.n_regionkey = b.n_regionkey AND a.n_regionkey = nv.n_regionkey) AS n_edges FROM nv GROUP BY n_regionkey")
def web_answer(g):
    """The JSON that a client gets, parsed again."""
    shape = "array<struct<vertices: array<struct<id: string>>, edges: array<struct<source: long>>, size: long>>"
    rows = web_result(g, SecondOrder(g).Community().execute()).select("type", "totalCount", F.explode(F.from_json("subsets", shape)).alias("s"))
    return rows.select("type", F.col("totalCount").alias("total"), "s.size", F.array_join("s.vertices.id", ",").alias("vertices"), F.size("s.edges").alias("n_edges"))


# -- streams --------------------------------------------------------------------------------------------------------------------

_LAST = """last AS (SELECT src, dst, delta_id, op FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, delta_id) AS rn
  FROM edge_deltas WHERE src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND op IN (0, 1)) WHERE rn = 1)"""


def _log(spark, folder) -> str:
    """The change feed, arriving in several files, ingested by a stream into a log."""
    feed, log, mark = (scratch(spark, n) for n in ("feed", "log", "marks"))
    table(spark, folder, "edge_deltas").select(*[f.split()[0] for f in deltas.FEED.split(", ")]).repartition(6).write.parquet(feed)
    deltas.ingest(deltas.read_feed(spark, feed, 2), log, mark).awaitTermination()
    return log


def streamed_edges(spark, folder):
    """The edges after all micro-batches."""
    return deltas.current(spark, table(spark, folder, "graph_edges"), _log(spark, folder)).select("src", "dst", "delta_id")


QUERIES["streamed_edges"] = streamed_edges
ORACLE["streamed_edges"] = f"""WITH {_LAST} SELECT src, dst, delta_id FROM last WHERE op = 0
 UNION ALL SELECT DISTINCT g.src, g.dst, CAST(NULL AS BIGINT) FROM graph_edges g WHERE g.src IS NOT NULL AND g.dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM last l WHERE l.src = g.src AND l.dst = g.dst)"""


def compacted_edges(spark, folder):
    """A new base written from the log."""
    path = scratch(spark, "compacted")
    deltas.compact(spark, table(spark, folder, "graph_edges"), _log(spark, folder), path)
    return spark.read.parquet(path).groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


QUERIES["compacted_edges"] = compacted_edges
ORACLE["compacted_edges"] = f"SELECT src, count(*) AS out_degree FROM ({ORACLE['streamed_edges']}) GROUP BY src"


def activity_by_hour(spark, folder):
    """Every change of the log per hour of its own time, however late it came."""
    return deltas.activity_of(spark.read.schema(deltas.FEED).parquet(_log(spark, folder))).select(F.unix_timestamp("window.start").alias("start"), "op", "n")


QUERIES["activity_by_hour"] = activity_by_hour
ORACLE["activity_by_hour"] = "SELECT CAST(floor(ts / 3600000000.0) * 3600 AS BIGINT) AS start, op, count(*) AS n FROM edge_deltas WHERE ts IS NOT NULL GROUP BY 1, 2"
