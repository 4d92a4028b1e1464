"""Registration of queries over graph views, and the SQL tables of those views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.model import PropertyGraph
from loomgraph.sources import views
from loomgraph.sources.views import CUSTOMER, NATION, REGION, SUPPLIER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(view: Callable[[SparkSession, str], PropertyGraph], sql: str | None = None):
    """Register a query over one graph view, by the name of its function, with its SQL after the view's own tables.

    ``sql`` starts with ``, name AS (...)`` for tables of its own, or with ``SELECT``; with ``RECURSIVE`` in front if one of them is.
    """

    def add(f: Callable[..., DataFrame]):
        both = f.__code__.co_argcount == 2  # some also read tables of the folder
        QUERIES[f.__name__] = lambda spark, folder: f(view(spark, folder), folder) if both else f(view(spark, folder))
        if sql:
            rest = sql.strip()
            first = "WITH RECURSIVE " if rest.startswith("RECURSIVE") else "WITH "
            ORACLE[f.__name__] = f"{first}{TABLES[view]} {rest.removeprefix('RECURSIVE').strip()}"
        return f

    return add


_LINES = """lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem"""
_PV = "pv AS MATERIALIZED (SELECT p_partkey AS vid, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS community, p_name AS name, p_size AS size, p_retailprice AS price FROM part)"
_PART = f"""{_PV},
 pe AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, {_LINES}) WHERE dst IS NOT NULL AND src <> dst)"""
_NEXT = f"""{_PV},
 pe AS MATERIALIZED (SELECT src, dst, times FROM (SELECT src, dst, count(*) AS times, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS rn
  FROM (SELECT l_partkey AS src, {_LINES}) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst) WHERE rn = 1)"""
_TRADE = f"""tv AS MATERIALIZED (SELECT {REGION} + r_regionkey AS vid, 'region' AS label, r_name AS name, CAST(NULL AS DOUBLE) AS balance, CAST(NULL AS VARCHAR) AS segment FROM region
  UNION ALL SELECT {NATION} + n_nationkey, 'nation', n_name, NULL, NULL FROM nation
  UNION ALL SELECT {CUSTOMER} + c_custkey, 'customer', c_name, c_acctbal, c_mktsegment FROM customer
  UNION ALL SELECT {SUPPLIER} + s_suppkey, 'supplier', s_name, s_acctbal, NULL FROM supplier),
 te AS MATERIALIZED (SELECT CAST({NATION} + n_nationkey AS BIGINT) AS src, CAST({REGION} + n_regionkey AS BIGINT) AS dst, 'in_region' AS label FROM nation
  UNION ALL SELECT {CUSTOMER} + c_custkey, {NATION} + c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT {SUPPLIER} + s_suppkey, {NATION} + s_nationkey, 'in_nation' FROM supplier
  UNION ALL SELECT DISTINCT {CUSTOMER} + o_custkey, {SUPPLIER} + l_suppkey, 'buys_from' FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_NATIONS = """nv AS MATERIALIZED (SELECT CAST(n_nationkey AS BIGINT) AS vid, n_name AS name, n_regionkey FROM nation),
 sold AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 ne AS MATERIALIZED (SELECT a.vid AS src, b.vid AS dst FROM nv a JOIN nv b ON a.n_regionkey = b.n_regionkey AND a.vid < b.vid
  UNION SELECT src, dst FROM sold WHERE src <> dst AND n * (SELECT count(*) FROM sold) > (SELECT sum(n) FROM sold)),
 nu AS MATERIALIZED (SELECT src, dst FROM ne UNION SELECT dst, src FROM ne),
 near AS MATERIALIZED (SELECT vid, coalesce(sum(CAST(1 AS BIGINT) << dst), 0)::BIGINT AS others FROM nv LEFT JOIN nu ON src = vid GROUP BY 1)"""
#: ``bit`` is the place of a vertex in a mask of all ten.
_MARKET = """sg AS MATERIALIZED (SELECT c_mktsegment AS name, 99 + row_number() OVER (ORDER BY c_mktsegment) AS vid FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
 cell AS MATERIALIZED (SELECT CAST(n_regionkey AS BIGINT) AS region, sg.vid AS segment, count(*) AS n, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN sg ON sg.name = c_mktsegment GROUP BY 1, 2),
 mw AS MATERIALIZED (SELECT *, avg(n) OVER (PARTITION BY region) AS usual, sum(balance) OVER (PARTITION BY segment) / sum(n) OVER (PARTITION BY segment) AS rich FROM cell),
 mv AS MATERIALIZED (SELECT vid, CAST(row_number() OVER (ORDER BY vid) - 1 AS BIGINT) AS bit FROM (SELECT CAST(r_regionkey AS BIGINT) AS vid FROM region UNION ALL SELECT vid FROM sg)),
 me AS MATERIALIZED (SELECT region AS src, segment AS dst FROM mw WHERE n > usual UNION ALL SELECT segment, region FROM mw WHERE balance / n > rich),
 masks AS MATERIALIZED (SELECT range AS mask, CAST(bit_count(range) AS INT) AS size FROM range(0, (SELECT CAST(1 AS BIGINT) << count(*) FROM mv))),
 held AS MATERIALIZED (SELECT mask, size, vid FROM masks JOIN mv ON (mask >> bit) & 1 = 1)"""
_SIZES = """zv AS MATERIALIZED (SELECT DISTINCT CAST(p_size AS BIGINT) AS vid FROM part),
 ze AS MATERIALIZED (SELECT vid AS src, dst FROM (SELECT vid, lead(vid) OVER (ORDER BY vid) AS dst FROM zv) WHERE dst IS NOT NULL)"""
_PEOPLE = """pv AS MATERIALIZED (SELECT vid, coalesce(CAST(label AS VARCHAR), 'vertex') AS label, community FROM graph_vertices),
 pe AS MATERIALIZED (SELECT DISTINCT src, dst FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL)"""
part, nxt, trade, nation, market, people, sizes = views.part_graph, views.next_graph, views.trade_graph, views.nation_graph, views.market_graph, views.people_graph, views.size_graph
TABLES = {part: _PART, nxt: _NEXT, trade: _TRADE, nation: _NATIONS, market: _MARKET, people: _PEOPLE, sizes: _SIZES}

# SQL of the algorithms over ``pv`` and ``pe``; those with RECURSIVE tables come after the keyword.
HUB = "hub AS MATERIALIZED (SELECT min(src) AS vid FROM (SELECT src, count(*) AS n FROM pe GROUP BY src) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM pe GROUP BY src)))"


def walk(src: str = "src", dst: str = "dst", edges: str = "pe", start: str = "hub") -> str:
    """``bf (vid, distance)`` from ``start (vid)``."""
    return f"""bf(vid, distance) USING KEY (vid) AS (SELECT vid, CAST(0 AS BIGINT) FROM {start} UNION SELECT {edges}.{dst}, bf.distance + 1 FROM bf JOIN {edges} ON {edges}.{src} = bf.vid
  WHERE {edges}.{dst} NOT IN (SELECT vid FROM recurring.bf))"""


#: ``wc (vid, component)``: labels pushed along edges while they get smaller.
WEAK = """wc(vid, component) USING KEY (vid) AS (SELECT vid, vid FROM pv UNION SELECT u.b, min(wc.component) FROM wc
  JOIN (SELECT src AS a, dst AS b FROM pe UNION ALL SELECT dst, src FROM pe) u ON wc.vid = u.a JOIN recurring.wc r ON r.vid = u.b WHERE wc.component < r.component GROUP BY u.b)"""
#: ``sc (vid, component)``: what the hub reaches and is reached from, and the closure of the rest; ``se`` the edges between components.
STRONG = f"""{HUB}, fw(vid) AS (SELECT vid FROM hub UNION SELECT pe.dst FROM fw JOIN pe ON pe.src = fw.vid), bw(vid) AS (SELECT vid FROM hub UNION SELECT pe.src FROM bw JOIN pe ON pe.dst = bw.vid),
 core AS MATERIALIZED (SELECT vid FROM fw INTERSECT SELECT vid FROM bw),
 loose AS MATERIALIZED (SELECT src, dst FROM pe WHERE src NOT IN (SELECT vid FROM core) AND dst NOT IN (SELECT vid FROM core)),
 lr(a, b) AS (SELECT vid, vid FROM pv WHERE vid NOT IN (SELECT vid FROM core) UNION SELECT lr.a, loose.dst FROM lr JOIN loose ON lr.b = loose.src),
 sc AS MATERIALIZED (SELECT vid, (SELECT min(vid) FROM core) AS component FROM core UNION ALL SELECT x.a, min(x.b) FROM lr x JOIN lr y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
 se AS MATERIALIZED (SELECT DISTINCT a.component AS src, b.component AS dst FROM pe JOIN sc a ON pe.src = a.vid JOIN sc b ON pe.dst = b.vid WHERE a.component <> b.component)"""
#: ``lv (vid, level)`` of components, raised while an edge asks for more.
LEVELS = f"""{STRONG}, lv(vid, level) USING KEY (vid) AS (SELECT DISTINCT component, CAST(0 AS BIGINT) FROM sc UNION SELECT se.dst, max(lv.level + 1) FROM lv JOIN se ON se.src = lv.vid
  JOIN recurring.lv r ON r.vid = se.dst WHERE r.level < lv.level + 1 GROUP BY se.dst)"""
#: ``r (a, b)``: the whole closure, for graphs of at most one edge out of a vertex.
CLOSED = "r(a, b) AS (SELECT vid, vid FROM pv UNION SELECT r.a, pe.dst FROM r JOIN pe ON r.b = pe.src)"
CROSS = "c AS MATERIALIZED (SELECT pe.src, pe.dst, a.community AS cu, b.community AS cv FROM pe JOIN pv a ON pe.src = a.vid JOIN pv b ON pe.dst = b.vid WHERE a.community <> b.community)"
