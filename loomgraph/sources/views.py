"""Graphs over the relational and graph test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.storage import materialize, table


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    brands = part.select("p_brand").distinct().withColumn("community", F.dense_rank().over(Window.orderBy("p_brand")) - 1)  # one row per brand
    return part.join(brands, "p_brand").select(
        F.col("p_partkey").alias("vid"), F.lit("part").alias("label"), "community", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"),
    )


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, dst)``: each line of an order and the next one, where their parts differ."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return steps.where("dst IS NOT NULL AND src <> dst")


def part_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Parts, each linked to every one that is the next of an order; communities are brands.

    The derived edges are written once: algorithms read them many times.
    """
    return PropertyGraph(_parts(spark, folder), materialize(_steps(spark, folder).distinct(), "part"))


def next_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Parts, each linked to the one that most often is the next of an order, the smallest of several: at most one edge out of a part."""
    often = _steps(spark, folder).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = often.groupBy("src").agg(F.max(F.struct("n", F.negative("dst").alias("neg"))).alias("x")).select("src", F.negative("x.neg").alias("dst"), F.col("x.n").alias("times"))
    return PropertyGraph(_parts(spark, folder), materialize(edges, "next"))


def size_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The sizes of parts, each linked to the next larger one."""
    sizes = table(spark, folder, "part").select(F.col("p_size").cast("long").alias("vid")).distinct()
    edges = sizes.select(F.col("vid").alias("src"), F.lead("vid").over(Window.orderBy("vid")).alias("dst")).where("dst IS NOT NULL")  # one row per size
    return PropertyGraph(sizes, materialize(edges, "sizes"))


def market_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions (0, ...) and market segments (100, ... by name) over all customers.

    A region leads to a segment with more than the average number of its customers, a segment to a region with more than the
    average balance of its customers.
    """
    where = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = table(spark, folder, "customer").select("c_mktsegment").where("c_mktsegment IS NOT NULL").distinct()
    segments = segments.withColumn("segment", F.row_number().over(Window.orderBy("c_mktsegment")).cast("long") + 99)  # one row per segment
    cells = where.join(segments, "c_mktsegment").groupBy(F.col("n_regionkey").cast("long").alias("region"), "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))
    of = lambda key: Window.partitionBy(key)
    cells = cells.withColumns({"usual": F.avg("n").over(of("region")), "rich": F.sum("balance").over(of("segment")) / F.sum("n").over(of("segment"))})  # regions times segments
    edges = cells.where("n > usual").select(F.col("region").alias("src"), F.col("segment").alias("dst"))
    edges = edges.unionByName(cells.where("balance / n > rich").select(F.col("segment").alias("src"), F.col("region").alias("dst")))
    vertices = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("vid"), F.lit("region").alias("label"), F.col("r_name").alias("name"))
    vertices = vertices.unionByName(segments.select(F.col("segment").alias("vid"), F.lit("segment").alias("label"), F.col("c_mktsegment").alias("name")))
    return PropertyGraph(vertices, materialize(edges, "market"))


REGION, NATION, CUSTOMER, SUPPLIER = (k * 10**9 for k in (1, 2, 3, 4))


def trade_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions, nations, customers and suppliers; ``in_region``, ``in_nation`` and ``buys_from`` edges."""
    t = {n: table(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    key = lambda c, base: (F.col(c).cast("long") + base)
    none = lambda kind: F.lit(None).cast(kind)
    v = [
        t["region"].select(key("r_regionkey", REGION).alias("vid"), F.lit("region").alias("label"), F.col("r_name").alias("name"), none("double").alias("balance"), none("string").alias("segment")),
        t["nation"].select(key("n_nationkey", NATION).alias("vid"), F.lit("nation").alias("label"), F.col("n_name").alias("name"), none("double").alias("balance"), none("string").alias("segment")),
        t["customer"].select(key("c_custkey", CUSTOMER).alias("vid"), F.lit("customer").alias("label"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t["supplier"].select(key("s_suppkey", SUPPLIER).alias("vid"), F.lit("supplier").alias("label"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), none("string").alias("segment")),
    ]
    pair = lambda df, a, b, label: df.select(a.alias("src"), b.alias("dst"), F.lit(label).alias("label"))
    bought = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).select(key("o_custkey", CUSTOMER).alias("src"), key("l_suppkey", SUPPLIER).alias("dst")).distinct()
    e = [
        pair(t["nation"], key("n_nationkey", NATION), key("n_regionkey", REGION), "in_region"),
        pair(t["customer"], key("c_custkey", CUSTOMER), key("c_nationkey", NATION), "in_nation"),
        pair(t["supplier"], key("s_suppkey", SUPPLIER), key("s_nationkey", NATION), "in_nation"),
        bought.withColumn("label", F.lit("buys_from")),
    ]
    return PropertyGraph(_union(v), materialize(_union(e), "trade"))


def nation_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """All nations; an edge to a later nation of the same region, and to one that sold it more lines than the average pair."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), "n_name", "n_regionkey")
    a, b = nations.select(F.col("vid").alias("src"), F.col("n_regionkey").alias("ra")), nations.select(F.col("vid").alias("dst"), F.col("n_regionkey").alias("rb"))
    same = a.join(b, (F.col("ra") == F.col("rb")) & (F.col("src") < F.col("dst"))).select("src", "dst")
    c, o, i, s = (table(spark, folder, x) for x in ("customer", "orders", "lineitem", "supplier"))
    sold = i.join(o, i["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).count()
    all_pairs = sold.agg(F.sum("count").alias("lines"), F.count(F.lit(1)).alias("pairs"))  # one row
    sold = sold.crossJoin(F.broadcast(all_pairs)).where((F.col("count") * F.col("pairs") > F.col("lines")) & (F.col("src") != F.col("dst"))).select("src", "dst")
    return PropertyGraph(nations.select("vid", F.lit("nation").alias("label"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("community")), materialize(same.union(sold).distinct(), "nation"))


def people_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The vertex and edge tables: communities from ``graph_vertices``, topology from ``graph_edges``, merged and written once.

    Null ends and repeated rows are dropped; the numeric label becomes text.
    """
    v = table(spark, folder, "graph_vertices").select("vid", F.col("label").cast("string").alias("label"), "community")
    e = table(spark, folder, "graph_edges").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    return PropertyGraph(v.withColumn("label", F.coalesce("label", F.lit("vertex"))), materialize(e, "people"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
