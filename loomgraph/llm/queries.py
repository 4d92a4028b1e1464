"""p1, p2, p4, p7, p8 and p9 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.frequent import frequent_values
from loomgraph.llm.groups import connected_groups, same_rows
from loomgraph.llm.mixing import mixture
from loomgraph.llm.packing import container_report, fill_containers
from loomgraph.llm.seen import error_rates, seen_before
from loomgraph.llm.splitting import split_texts
from loomgraph.storage import table


def _setting(spark: SparkSession, folder: str, name: str) -> int:
    if name == "frequent_permille":
        return table(spark, folder, "storage_options").where(F.col("option_name") == name).first()["option_value"]
    return table(spark, folder, "size_limits").where(F.col("limit_name") == name).first()["tokens"]


def p1_seen(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "id_requests")
    key = F.when(F.col("kind") == "vertex", F.col("outer_id")).when(F.col("kind") == "edge", F.col("handle").cast("string"))
    edges = table(spark, folder, "graph_edges").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    stored = edges.select(F.shiftleft("src", 32).bitwiseOR(F.col("dst")).cast("string").alias("key"))
    return seen_before(requests.select("request_id", "kind", key.alias("key")), stored)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_seen(spark, folder).where("seen").select("request_id")


def p1_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    return error_rates(p1_seen(spark, folder))


def p1_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return p1_seen(spark, folder).select("request_id", "kind", "seen")


def p1_rates_add_up(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind the requests and those seen, whether the routes account for all of them, and whether the filter errs on less than one in fifty."""
    r = p1_error_rate(spark, folder)
    whole = (F.col("n_positive") + F.col("n_negative") == F.col("n_requests")) & (F.col("n_positive") - F.col("n_collisions") == F.col("n_seen"))
    return r.select("kind", "n_requests", "n_seen", whole.alias("accounted"), (F.col("wrong_rate") < 0.02).alias("seldom_wrong"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return connected_groups(same_rows(table(spark, folder, "edge_property")), "outVertex", "inVertex")


def p2_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return p2_found(spark, folder).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_vertices"))


def p4_frequent(spark: SparkSession, folder: str) -> DataFrame:
    rows = frequent_values(table(spark, folder, "edge_property"), ["outVertex", "inVertex"], _setting(spark, folder, "frequent_permille"))
    return rows.withColumnRenamed("value", "vertex")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_frequent(spark, folder).select("ref_column", "vertex")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p4_frequent(spark, folder).select("ref_column", "vertex", "n", "n_column")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return fill_containers(table(spark, folder, "documents"), _setting(spark, folder, "container_capacity"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_containers(spark, folder).where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return container_report(p7_containers(spark, folder), _setting(spark, folder, "container_capacity"))


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its tokens and pieces, and whether only whole containers divide it."""
    limit = _setting(spark, folder, "container_capacity")
    whole = (F.col("piece") == F.col("n_pieces") - 1) | (F.col("tokens") == limit)
    rows = p7_containers(spark, folder).groupBy("doc_id")
    return rows.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_pieces"), F.min(whole).alias("whole"))


def p7_overfull(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers hold more than their capacity, and whether nine tenths of the space are used."""
    limit = _setting(spark, folder, "container_capacity")
    loads = p7_containers(spark, folder).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return loads.agg(F.count(F.when(F.col("tokens") > limit, 1)).alias("n_overfull"), (F.sum("tokens") > 0.9 * limit * F.count(F.lit(1))).alias("well_filled"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_shares(spark, folder).where("used_up").select("source")


def p8_own(spark: SparkSession, folder: str) -> DataFrame:
    """Per source its own documents and tokens, and whether the mixture keeps to its cap."""
    return p8_shares(spark, folder).select("source", "n_documents", "own_tokens", (F.col("used_tokens") <= F.col("max_repeats") * F.col("own_tokens")).alias("capped"))


def p8_total(spark: SparkSession, folder: str) -> DataFrame:
    """Documents used more often than their source permits, and whether the tokens used fill the budget to a thousandth and no further."""
    docs, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    mixed = mixture(docs, targets)[0]
    caps = targets.select("source", "max_repeats")
    over = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(caps, "source").where("n > max_repeats").agg(F.count(F.lit(1)).alias("n_over"))
    used = mixed.agg(F.sum("tokens").alias("used")).join(docs.agg(F.sum(F.octet_length("text")).alias("budget")))
    return over.join(used).select("n_over", ((F.col("used") <= F.col("budget")) & (F.col("used") > 0.97 * F.col("budget"))).alias("filled"))  # one row each


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), _setting(spark, folder, "piece_limit"), _setting(spark, folder, "piece_overlap"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pieces(spark, folder).where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p9_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the digest of its pieces without their overlaps, their tokens, and whether all are within the limit."""
    limit = _setting(spark, folder, "piece_limit")
    own = F.decode(F.substring(F.col("text").cast("binary"), (F.col("overlap") + 1).cast("int"), F.lit(1 << 30)), "ISO-8859-1")
    rows = p9_pieces(spark, folder).select("doc_id", F.struct("piece", own.alias("own")).alias("p"), "tokens", "overlap")
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum(F.col("tokens") - F.col("overlap")).alias("tokens"), (F.max("tokens") <= limit).alias("within"))
    return rows.select("doc_id", F.md5(F.encode(F.array_join("ps.own", ""), "ISO-8859-1")).alias("digest"), "tokens", "within")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_seen, p1_verdicts, p1_error_rate, p1_rates_add_up, p2_found, p2_group_sizes, p4_found, p4_frequent, p4_counts, p7_found, p7_containers, p7_documents, p7_overfull, p7_report,
    p8_found, p8_mixture, p8_own, p8_shares, p8_total, p9_found, p9_pieces, p9_rebuilt,
)}

_LIMIT = "(SELECT tokens FROM size_limits WHERE limit_name = '{}')"
_GROUPS = """WITH RECURSIVE links AS (SELECT outVertex AS a, inVertex AS b FROM edge_property WHERE lower(trim(label)) = 'same_as' AND outVertex IS NOT NULL AND inVertex IS NOT NULL
  UNION SELECT inVertex, outVertex FROM edge_property WHERE lower(trim(label)) = 'same_as' AND outVertex IS NOT NULL AND inVertex IS NOT NULL),
 reach AS (SELECT a AS vertex, a AS other FROM links UNION SELECT r.vertex, l.b FROM reach r JOIN links l ON r.other = l.a),
 groups AS (SELECT vertex, min(other) AS group_id FROM reach GROUP BY vertex)"""
_FREQUENT = " UNION ALL ".join(
    f"""SELECT '{c}' AS ref_column, {c} AS vertex FROM edge_property WHERE {c} IS NOT NULL GROUP BY {c}
 HAVING count(*) * 1000 >= (SELECT option_value FROM storage_options WHERE option_name = 'frequent_permille') * (SELECT count({c}) FROM edge_property)"""
    for c in ("outVertex", "inVertex")
)

_SEEN = """WITH keyed AS (SELECT request_id, kind, CASE WHEN kind = 'vertex' THEN outer_id WHEN kind = 'edge' THEN CAST(handle AS VARCHAR) END AS key FROM id_requests),
 firsts AS (SELECT kind, key, min(request_id) AS first FROM keyed WHERE key IS NOT NULL GROUP BY 1, 2),
 stored AS (SELECT DISTINCT CAST((src * 4294967296) + dst AS VARCHAR) AS key FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
 verdict AS (SELECT request_id, kind, request_id > first OR (kind = 'edge' AND key IN (SELECT key FROM stored)) AS seen FROM keyed JOIN firsts USING (kind, key))"""
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS ref_column, {c} AS vertex, count(*) AS n, (SELECT count({c}) FROM edge_property) AS n_column FROM edge_property WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("outVertex", "inVertex"))
_CAPACITY = _LIMIT.format("container_capacity")

ORACLE = {
    "p1_found": f"{_SEEN} SELECT request_id FROM verdict WHERE seen",
    "p1_verdicts": f"{_SEEN} SELECT request_id, kind, seen FROM verdict",
    "p1_rates_add_up": f"{_SEEN} SELECT kind, count(*) AS n_requests, count(*) FILTER (seen) AS n_seen, true AS accounted, true AS seldom_wrong FROM verdict GROUP BY kind",
    "p4_counts": f"SELECT * FROM ({_COUNTS}) WHERE n * 1000 >= n_column * (SELECT option_value FROM storage_options WHERE option_name = 'frequent_permille')",
    "p7_documents": f"SELECT doc_id, strlen(text) AS tokens, greatest(1, CAST(ceil(strlen(text) / {_CAPACITY}) AS BIGINT)) AS n_pieces, true AS whole FROM documents",
    "p7_overfull": "SELECT 0 AS n_overfull, true AS well_filled",
    "p8_own": """SELECT t.source, coalesce(o.n, 0) AS n_documents, coalesce(o.own, 0) AS own_tokens, true AS capped FROM mix_targets t
 LEFT JOIN (SELECT lower(trim(source)) AS source, count(*) AS n, sum(strlen(text))::BIGINT AS own FROM documents GROUP BY 1) o ON t.source = o.source""",
    "p8_total": "SELECT 0 AS n_over, true AS filled",
    "p9_rebuilt": "SELECT doc_id, md5(text) AS digest, strlen(text) AS tokens, true AS within FROM documents",
    "p2_found": f"{_GROUPS} SELECT vertex, group_id FROM groups",
    "p2_group_sizes": f"{_GROUPS} SELECT group_id, count(*) AS n_vertices FROM groups GROUP BY group_id",
    "p4_found": _FREQUENT,
    "p7_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {_LIMIT.format('container_capacity')}",
    "p8_found": """SELECT t.source FROM mix_targets t LEFT JOIN (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS own FROM documents GROUP BY 1) o ON t.source = o.source
 WHERE t.max_repeats * coalesce(o.own, 0) < t.target_share * (SELECT sum(strlen(text)) FROM documents)""",
    "p9_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {_LIMIT.format('piece_limit')}",
}
