"""p3, p5 and p6: skewed per-source results, edge changes, references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.accumulate import key_totals
from loomgraph.operators.changes import apply_changes
from loomgraph.operators.orphans import ForeignKey, cascade
from loomgraph.storage import materialize, table


def _option(spark: SparkSession, folder: str, name: str) -> int:
    return table(spark, folder, "storage_options").where(F.col("option_name") == name).first()["option_value"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    least = _option(spark, folder, "giant_vertex_boundary")
    return key_totals(table(spark, folder, "graph_edges"), "src", "dst").where(F.col("n_items") >= least).select(F.col("src").alias("vid"))


def p3_source_totals(spark: SparkSession, folder: str) -> DataFrame:
    least = _option(spark, folder, "giant_vertex_boundary")
    return key_totals(table(spark, folder, "graph_edges"), "src", "dst").select("src", "n_rows", F.col("n_items").alias("n_neighbours"), (F.col("n_items") >= least).alias("is_giant"))


def _current(spark: SparkSession, folder: str) -> DataFrame:
    """The rebuilt edge table, written out: the queries read the table, so all of the base goes through the multiset."""
    return materialize(apply_changes(table(spark, folder, "graph_edges"), table(spark, folder, "edge_deltas")), "edges")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder).where(F.col("delta_id").isNotNull()).select("src", "dst", "delta_id")


def p5_current_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder).select("src", "dst", "delta_id", "since")


_REFS = tuple(ForeignKey("edge_property", (c,), "vertex_property", ("vertex",), "loaded_at", "loaded_at", "deleted_at") for c in ("outVertex", "inVertex"))
_ROW_IDS = {"edge_property": "edge_row", "edge_deltas": "delta_id"}


def _orphans(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Orphans of every table, from the changes' references to edge records and theirs to vertex records."""
    tables = {t: table(spark, folder, t) for t in ("edge_property", "vertex_property", "edge_deltas")}
    keys = [*_REFS, ForeignKey("edge_deltas", ("src", "dst"), "edge_property", ("outVertex", "inVertex"))]
    return cascade(tables, _ROW_IDS, keys, {"edge_deltas": "recv_at", "edge_property": "loaded_at"})


def _direct(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)["edge_property"].where("level = 0")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _direct(spark, folder).select("edge_row", "ref_column", "reason", "period")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _direct(spark, folder).groupBy("ref_column", "period", "reason").agg(F.count(F.lit(1)).alias("n"))


def p6_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans per table, reference and month, down to the changes of orphaned edge records."""
    parts = _orphans(spark, folder)
    out = None
    for name in sorted(parts):
        one = parts[name].select(F.lit(name).alias("table_name"), "ref_column", "reason", "period", (F.col("level") > 0).alias("is_inherited"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("table_name", "ref_column", "reason", "period", "is_inherited").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_source_totals, p5_found, p5_current_edges, p6_found, p6_counts, p6_cascade)}

_GIANT = "(SELECT option_value FROM storage_options WHERE option_name = 'giant_vertex_boundary')"
_LAST = """last AS (SELECT src, dst, delta_id, op, since FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, delta_id) AS rn
  FROM edge_deltas WHERE src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL AND op IN (0, 1)) WHERE rn = 1)"""
_DIRECT = """refs AS (SELECT edge_row, 'outVertex' AS ref_column, outVertex AS v, loaded_at AS t FROM edge_property WHERE outVertex IS NOT NULL
  UNION ALL SELECT edge_row, 'inVertex', inVertex, loaded_at FROM edge_property WHERE inVertex IS NOT NULL),
 direct AS (SELECT edge_row, ref_column, CASE WHEN NOT EXISTS (SELECT 1 FROM vertex_property p WHERE p.vertex = r.v) THEN 'missing'
   WHEN NOT EXISTS (SELECT 1 FROM vertex_property p WHERE p.vertex = r.v AND p.loaded_at <= r.t) THEN 'late' ELSE 'deleted' END AS reason,
   strftime(t, '%Y-%m') AS period FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM vertex_property p WHERE p.vertex = r.v AND p.loaded_at <= r.t AND (p.deleted_at IS NULL OR p.deleted_at > r.t)))"""
_BAD = """bad AS (SELECT DISTINCT edge_row FROM direct),
 pairs AS (SELECT outVertex AS s, inVertex AS d, count(*) AS n, count(b.edge_row) AS lost FROM edge_property e LEFT JOIN bad b USING (edge_row)
  WHERE outVertex IS NOT NULL AND inVertex IS NOT NULL GROUP BY 1, 2)"""

ORACLE = {
    "p3_found": f"SELECT src AS vid FROM graph_edges WHERE src IS NOT NULL GROUP BY src HAVING count(DISTINCT dst) >= {_GIANT}",
    "p3_source_totals": f"SELECT src, count(*) AS n_rows, count(DISTINCT dst) AS n_neighbours, count(DISTINCT dst) >= {_GIANT} AS is_giant FROM graph_edges WHERE src IS NOT NULL GROUP BY src",
    "p5_found": f"WITH {_LAST} SELECT src, dst, delta_id FROM last WHERE op = 0",
    "p5_current_edges": f"""WITH {_LAST} SELECT src, dst, delta_id, since FROM last WHERE op = 0
 UNION ALL SELECT DISTINCT g.src, g.dst, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM graph_edges g
  WHERE g.src IS NOT NULL AND g.dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM last l WHERE l.src = g.src AND l.dst = g.dst)""",
    "p6_found": f"WITH {_DIRECT} SELECT edge_row, ref_column, reason, period FROM direct",
    "p6_counts": f"WITH {_DIRECT} SELECT ref_column, period, reason, count(*) AS n FROM direct GROUP BY ALL",
    "p6_cascade": f"""WITH {_DIRECT}, {_BAD}, touched AS (SELECT delta_id, p.n, p.lost, strftime(recv_at, '%Y-%m') AS period FROM edge_deltas d LEFT JOIN pairs p ON d.src = p.s AND d.dst = p.d
  WHERE d.src IS NOT NULL AND d.dst IS NOT NULL)
 SELECT 'edge_property' AS table_name, ref_column, reason, period, false AS is_inherited, count(*) AS n FROM direct GROUP BY ALL
 UNION ALL SELECT 'edge_deltas', 'src,dst', CASE WHEN n IS NULL THEN 'missing' ELSE 'inherited' END, period, n IS NOT NULL, count(*) FROM touched WHERE n IS NULL OR n = lost GROUP BY ALL""",
}
