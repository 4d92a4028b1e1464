"""A property graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.config import Options

VERTEX_CORE, EDGE_CORE = ("vid", "id", "label", "community"), ("src", "dst", "id", "label")
DEFAULT_VERTEX_LABEL, DEFAULT_EDGE_LABEL = "vertex", "edge"


class PropertyGraph:
    """Immutable pair of ``vertices`` and ``edges``.

    ``vertices``: ``vid LONG`` unique, ``id STRING`` (external id, by default the text of ``vid``), ``label STRING``, ``community INT``,
    and one typed column per property. ``edges``: ``src LONG, dst LONG`` (one edge per ordered pair), ``id``, ``label`` and
    properties. Missing core columns are filled in; a null property is an absent one. The constructor trusts its
    input; :meth:`of` cleans it first.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, options: Options | None = None):
        v, e = vertices, edges
        self.options = options or Options()
        if "label" not in v.columns:
            v = v.withColumn("label", F.lit(DEFAULT_VERTEX_LABEL))
        if "community" not in v.columns:
            v = v.withColumn("community", F.lit(None).cast("int"))
        if "id" not in v.columns:
            v = v.withColumn("id", F.col("vid").cast("string"))
        if "label" not in e.columns:
            e = e.withColumn("label", F.lit(DEFAULT_EDGE_LABEL))
        if "id" not in e.columns:
            e = e.withColumn("id", handle(F.col("src"), F.col("dst")).cast("string"))
        self.vertices = v.select(*VERTEX_CORE, *[c for c in v.columns if c not in VERTEX_CORE])
        self.edges = e.select(*EDGE_CORE, *[c for c in e.columns if c not in EDGE_CORE])

    @classmethod
    def of(cls, vertices: DataFrame | None, edges: DataFrame) -> PropertyGraph:
        """Clean input: rows with null keys go, repeated pairs become one edge, ends without a vertex become vertices."""
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        if rest:
            edges = edges.groupBy("src", "dst").agg(F.max(F.struct(*rest)).alias("x")).select("src", "dst", "x.*")
        else:
            edges = edges.select("src", "dst").distinct()
        ends = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        if vertices is None:
            return cls(ends, edges)
        rest = [c for c in vertices.columns if c != "vid"]
        vertices = vertices.where(F.col("vid").isNotNull())
        if rest:
            vertices = vertices.groupBy("vid").agg(F.max(F.struct(*rest)).alias("x")).select("vid", "x.*")
        else:
            vertices = vertices.distinct()
        known = vertices.join(ends.select(F.col("vid").alias("_end")), F.col("vid") == F.col("_end"), "full")
        return cls(known.withColumn("vid", F.coalesce("vid", "_end")).drop("_end"), edges)

    def with_(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
        """Other vertices or edges under the same options."""
        return PropertyGraph(self.vertices if vertices is None else vertices, self.edges if edges is None else edges, self.options)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @property
    def vertex_properties(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in VERTEX_CORE]

    @property
    def edge_properties(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_CORE]

    def traversal(self):
        from loomgraph.operators.traversal import Source

        return Source(self)

    # -- reads ---------------------------------------------------------------------------------------------------------

    def vertices_by_id(self, ids: Iterable) -> DataFrame:
        """Vertices of ``ids`` in their order, repeated ids repeated.

        An external id wins; a number that no external id matches is taken as the internal ``vid``. Unknown ids give no row.
        """
        asked = [(i, str(x), int(x) if str(x).lstrip("-").isdigit() else None) for i, x in enumerate(ids)]
        asked = self.spark.createDataFrame(asked, "_pos int, _text string, _number long")
        v = self.vertices.withColumn("_id", F.col("id"))
        by_id = asked.join(v, F.col("_text") == F.col("_id"))
        rest = asked.join(self.vertices.select(F.col("id").alias("_id")), F.col("_text") == F.col("_id"), "left_anti")
        by_vid = rest.join(v, F.col("_number") == F.col("vid"))
        return by_id.unionByName(by_vid).orderBy("_pos").drop("_pos", "_text", "_number", "_id")

    def edges_by_id(self, ids: Iterable) -> DataFrame:
        return self.edges.where(F.col("id").isin([str(i) for i in ids]))

    def out_neighbours(self, vid: int) -> DataFrame:
        return self.edges.where(F.col("src") == vid).select(F.col("dst").alias("vid"))

    def in_neighbours(self, vid: int) -> DataFrame:
        return self.edges.where(F.col("dst") == vid).select(F.col("src").alias("vid"))

    def degrees(self) -> DataFrame:
        """``(vid, out_degree, in_degree)`` of every vertex, isolated ones with 0."""
        ends = self.edges.select(F.explode(F.array(
            F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i"))
        )).alias("x")).select("x.*")
        all_of = self.vertices.select("vid", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(ends)
        return all_of.groupBy("vid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    def giant_vertices(self) -> DataFrame:
        """``(vid, out_degree)`` of the vertices with at least ``options.giant_vertex_boundary`` out-neighbours."""
        return self.edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("out_degree")).where(F.col("out_degree") >= self.options.giant_vertex_boundary)

    def has_vertex(self, vids: DataFrame) -> DataFrame:
        """``vids`` with ``exists``."""
        known = self.vertices.select(F.col("vid").alias("_k"))
        return vids.join(known, vids["vid"] == known["_k"], "left").withColumn("exists", F.col("_k").isNotNull()).drop("_k")

    def has_edge(self, pairs: DataFrame) -> DataFrame:
        """``pairs (src, dst)`` with ``exists``."""
        known = self.edges.select("src", "dst", F.lit(True).alias("exists"))
        return pairs.join(known, ["src", "dst"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

    def adjacency(self, members: DataFrame | None = None) -> DataFrame:
        """``(vid, neighbours)``: sorted out-neighbours of every vertex, or only of ``members`` (not restricted to them)."""
        pairs = self.edges.select(F.col("src").alias("vid"), "dst")
        who = self.vertices.select("vid")
        if members is not None:
            who = who.join(members.select("vid"), "vid", "left_semi")
            pairs = pairs.join(members.select("vid"), "vid", "left_semi")
        lists = pairs.groupBy("vid").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
        return who.join(lists, "vid", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))

    def induced(self, members: DataFrame) -> PropertyGraph:
        """The subgraph of the vertices in ``members (vid)``: edges with both ends among them."""
        keep = members.select("vid").distinct()
        edges = self.edges.join(keep.withColumnRenamed("vid", "src"), "src", "left_semi").join(keep.withColumnRenamed("vid", "dst"), "dst", "left_semi")
        return self.with_(self.vertices.join(keep, "vid", "left_semi"), edges)

    def counts(self) -> DataFrame:
        return self.vertices.agg(F.count(F.lit(1)).alias("n_vertices")).join(self.edges.agg(F.count(F.lit(1)).alias("n_edges")))

    def cache(self) -> PropertyGraph:
        self.vertices.cache(), self.edges.cache()
        return self

    def register(self, vertices: str = "vertices", edges: str = "edges") -> None:
        """Temporary views for Spark SQL."""
        self.vertices.createOrReplaceTempView(vertices)
        self.edges.createOrReplaceTempView(edges)

    def snapshot(self) -> DataFrame:
        """``(kind, id, label, source, target, properties JSON)`` of all vertices and edges."""
        v = self.vertices.select(F.lit("vertex").alias("kind"), "id", "label", F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("target"), as_json(self.vertex_properties).alias("properties"))
        e = self.edges.select(F.lit("edge").alias("kind"), "id", "label", F.col("src").alias("source"), F.col("dst").alias("target"), as_json(self.edge_properties).alias("properties"))
        return v.unionByName(e)

    # -- storage -------------------------------------------------------------------------------------------------------

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Zstd Parquet; edges are clustered by source so that a source's edges prune to few row groups."""
        edges = self.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
        for name, rows in (("vertices", self.vertices), ("edges", edges)):
            writer = rows.write.mode(mode).option("compression", "zstd").option("parquet.page.size", str(256 * self.options.block_size))
            writer.parquet(f"{path.rstrip('/')}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: Options | None = None) -> PropertyGraph:
        return cls(spark.read.parquet(f"{path.rstrip('/')}/vertices"), spark.read.parquet(f"{path.rstrip('/')}/edges"), options)

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        v = T.StructType([T.StructField("vid", T.LongType())])
        e = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
        return cls(spark.createDataFrame([], v), spark.createDataFrame([], e))


def handle(src, dst):
    """The packed 64-bit id of an edge between 32-bit vertex ids."""
    return F.shiftleft(src.cast("long"), 32).bitwiseOR(dst.cast("long"))


def unpack(packed):
    """``(src, dst)`` columns of a packed id."""
    return F.shiftrightunsigned(packed, 32), packed.bitwiseAND(F.lit(0xFFFFFFFF))


def as_json(names: list[str], prefix: str = ""):
    """JSON of the non-null columns ``names``; an object without members if there are none."""
    return F.to_json(F.struct(*[F.col(prefix + n).alias(n) for n in names])) if names else F.lit("{}")
