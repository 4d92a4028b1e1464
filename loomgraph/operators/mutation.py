"""New graphs from old ones: vertices, edges and properties added, replaced or dropped. Nothing changes in place."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators.changes import apply_changes
from loomgraph.operators.sweep import running_totals
from loomgraph.storage import materialize


def add_vertices(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Append ``rows`` with ``label``, optionally ``vid``, ``id``, ``community`` and properties.

    Without ``vid`` they are numbered above the largest; without ``id`` they get a random one; without a community each is
    one of its own, above the largest. Numbers come from a sweep over the new rows, which are written once; no task sees all of them.
    """
    top = graph.vertices.agg(F.coalesce(F.max("vid"), F.lit(-1)).alias("v"), F.coalesce(F.max("community"), F.lit(-1)).alias("c")).first()
    if "vid" not in rows.columns or "community" not in rows.columns:
        rows = materialize(rows.withColumns({"_at": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")}), "new")
        rows = running_totals(rows, None, ["_at"], ["_one"]).withColumnRenamed("run__one", "_n").drop("_at", "_one")
        if "vid" not in rows.columns:
            rows = rows.withColumn("vid", F.col("_n") + F.lit(top["v"]).cast("long"))
        if "community" not in rows.columns:
            rows = rows.withColumn("community", (F.col("_n") + top["c"]).cast("int"))
        rows = rows.drop("_n")
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"))
    new = PropertyGraph(rows, graph.edges).vertices
    return graph.with_(graph.vertices.join(new.select("vid"), "vid", "left_anti").unionByName(new, allowMissingColumns=True))


def add_edges(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Insert or replace the edges ``rows (src, dst, label, ...)``: an existing pair is overwritten with all its properties."""
    new = PropertyGraph(graph.vertices, rows.dropDuplicates(["src", "dst"])).edges
    kept = graph.edges.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
    return graph.with_(edges=kept.unionByName(new, allowMissingColumns=True))


def merge_vertices(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Add those of ``rows (id, label, ...)`` whose ``id`` no vertex has."""
    return add_vertices(graph, rows.join(graph.vertices.select("id"), "id", "left_anti"))


def merge_edges(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """Add those of ``rows (src, dst, label, ...)`` whose pair is no edge."""
    return add_edges(graph, rows.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def drop_vertices(graph: PropertyGraph, vids: DataFrame) -> PropertyGraph:
    gone = vids.select("vid").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("vid", "src"), "src", "left_anti").join(gone.withColumnRenamed("vid", "dst"), "dst", "left_anti")
    return graph.with_(graph.vertices.join(gone, "vid", "left_anti"), edges)


def drop_edges(graph: PropertyGraph, pairs: DataFrame) -> PropertyGraph:
    return graph.with_(edges=graph.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))


def _set(rows: DataFrame, keys: list[str], chosen: DataFrame, key: str, value: Any) -> DataFrame:
    if value is None:
        raise ValueError("a property value must not be null; drop the property instead")
    mark = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    old = F.col(key) if key in rows.columns else F.lit(None)
    return rows.join(mark, keys, "left").withColumn(key, F.when(F.col("_hit"), F.lit(value)).otherwise(old)).drop("_hit")


def set_vertex_property(graph: PropertyGraph, vids: DataFrame, key: str, value: Any) -> PropertyGraph:
    return graph.with_(_set(graph.vertices, ["vid"], vids, key, value))


def set_edge_property(graph: PropertyGraph, pairs: DataFrame, key: str, value: Any) -> PropertyGraph:
    return graph.with_(edges=_set(graph.edges, ["src", "dst"], pairs, key, value))


def drop_property(graph: PropertyGraph, key: str, of: str = "vertex") -> PropertyGraph:
    return graph.with_(graph.vertices.drop(key)) if of == "vertex" else graph.with_(edges=graph.edges.drop(key))


def list_properties(graph: PropertyGraph, prefix: str = "", of: str = "vertex") -> DataFrame:
    """``(id, key, value)``: every present property whose name starts with ``prefix``, as text, of all vertices or edges."""
    rows, names = (graph.vertices, graph.vertex_properties) if of == "vertex" else (graph.edges, graph.edge_properties)
    names = [n for n in names if n.startswith(prefix)]
    if not names:
        return graph.spark.createDataFrame([], "id string, key string, value string")
    cells = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    return rows.select("id", F.inline(cells)).where(F.col("value").isNotNull())


def remove_property(graph: PropertyGraph, chosen: DataFrame, key: str) -> PropertyGraph:
    """Without the property ``key`` of the vertices ``chosen (vid)`` or the edges ``chosen (src, dst)``."""
    edge = "src" in chosen.columns
    rows, keys = (graph.edges, ["src", "dst"]) if edge else (graph.vertices, ["vid"])
    if key not in rows.columns:
        return graph
    mark = chosen.select(*keys).distinct().withColumn("_hit", F.lit(True))
    rows = rows.join(mark, keys, "left").withColumn(key, F.when(F.col("_hit").isNull(), F.col(key))).drop("_hit")
    return graph.with_(edges=rows) if edge else graph.with_(rows)


def with_changes(graph: PropertyGraph, feed: DataFrame) -> PropertyGraph:
    """The graph with an edge feed applied; edges that the feed adds have no properties but ``since``."""
    now = apply_changes(graph.edges, feed)
    kept = graph.edges.join(now.where("delta_id IS NULL").select("src", "dst"), ["src", "dst"], "left_semi")
    new = PropertyGraph(graph.vertices, now.where("delta_id IS NOT NULL").select("src", "dst", "since")).edges
    return graph.with_(edges=kept.unionByName(new, allowMissingColumns=True))


def merge_logs(*logs: DataFrame) -> DataFrame:
    """``(src, dst, ts, op)``: per edge the operation with the largest ``ts`` of several logs; on a tie that of the earlier log."""
    rows = None
    for i, log in enumerate(logs):
        one = log.select("src", "dst", "ts", "op", F.lit(-i).alias("_at"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("src", "dst").agg(F.max(F.struct("ts", "_at", "op")).alias("x")).select("src", "dst", "x.ts", "x.op")
