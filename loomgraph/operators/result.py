"""Subsets shaped for clients: members with their properties, and the edges induced between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph, as_json


def induced_edges(graph: PropertyGraph, members: DataFrame) -> DataFrame:
    """``(subset_id, src, dst)``: edges with both ends in a subset of ``members (subset_id, vid)``."""
    out = graph.edges.select("src", "dst").join(members.select("subset_id", F.col("vid").alias("src")), "src")
    return out.join(members.select("subset_id", F.col("vid").alias("dst")), ["subset_id", "dst"]).select("subset_id", "src", "dst")


def subset_counts(graph: PropertyGraph, members: DataFrame) -> DataFrame:
    """``(subset_id, n_vertices, n_edges)``."""
    v = members.groupBy("subset_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    e = induced_edges(graph, members).groupBy("subset_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return v.join(e, "subset_id", "left").select("subset_id", "n_vertices", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def serialize(graph: PropertyGraph, found: DataFrame, edges: bool = True) -> DataFrame:
    """``(subset_id, size, vertices, edges)`` for subsets ``(subset_id, vids, size)``.

    ``vertices`` is an array of ``{id, label, properties}`` by vid, ``edges`` of ``{id, label, source, target, properties}``; properties
    are JSON objects. The empty set has empty arrays. Without ``edges`` that column is left out.
    """
    members = found.select("subset_id", F.explode("vids").alias("vid"))
    v = graph.vertices.select("vid", F.struct(F.col("vid").alias("_at"), "id", "label", as_json(graph.vertex_properties).alias("properties")).alias("v"))
    lists = members.join(v, "vid").groupBy("subset_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    out = found.select("subset_id", "size").join(lists, "subset_id", "left")
    out = out.withColumn("vertices", F.transform(F.coalesce("v", F.expr("filter(v, x -> true)")), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["properties"].alias("properties")))).drop("v")
    out = out.withColumn("vertices", F.coalesce("vertices", F.array().cast(out.schema["vertices"].dataType)))
    if not edges:
        return out
    e = graph.edges.select("src", "dst", F.struct(F.col("id"), F.col("label"), F.col("src").alias("source"), F.col("dst").alias("target"), as_json(graph.edge_properties).alias("properties")).alias("e"))
    shaped = induced_edges(graph, members).join(e, ["src", "dst"]).groupBy("subset_id").agg(F.collect_list(F.struct("src", "dst", "e")).alias("es"))
    out = out.join(shaped, "subset_id", "left").withColumn("edges", F.transform(F.array_sort("es"), lambda x: x["e"])).drop("es")
    return out.withColumn("edges", F.coalesce("edges", F.array().cast(out.schema["edges"].dataType)))


def web_result(graph: PropertyGraph, found: DataFrame) -> DataFrame:
    """One row ``(type, subsets JSON, totalCount)``. A client's answer: its size is that of the query's result."""
    shaped = serialize(graph, found)
    rows = shaped.select("subset_id", F.struct("vertices", "edges", "size").alias("s")).groupBy().agg(F.array_sort(F.collect_list(F.struct("subset_id", "s"))).alias("x"))
    return rows.select(F.lit("VsetResult").alias("type"), F.to_json(F.transform("x", lambda r: r["s"])).alias("subsets"), F.size("x").cast("long").alias("totalCount"))
