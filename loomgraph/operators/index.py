"""What algorithms look up again and again, computed once and saved: communities, their boundary, strong components and levels."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import PropertyGraph
from loomgraph.operators import algorithms as A
from loomgraph.storage import materialize


@dataclass(frozen=True)
class GraphIndex:
    """``places (vid, community, component, level)``, one row a vertex; ``links (src, dst)`` between components; ``boundary``, the rows of
    :func:`algorithms.enriched_boundary`; ``pairs (cu, cv, n_edges)`` of linked communities.

    Lookups take and give frames, so that any number of vertices is asked about in one join.
    """

    places: DataFrame
    links: DataFrame
    boundary: DataFrame
    pairs: DataFrame

    @classmethod
    def build(cls, graph: PropertyGraph, local_edges: int | None = None) -> GraphIndex:
        parts = materialize(A.scc(graph, local_edges), "scc")
        dag = A.written(A.condensed(graph, parts))
        level = A.levels(dag, local_edges).withColumnRenamed("vid", "component")
        places = graph.vertices.select("vid", "community").join(parts, "vid").join(level, "component").select("vid", "community", "component", "level")
        return cls(materialize(places, "places"), dag.edges.select("src", "dst"), materialize(A.enriched_boundary(graph, local_edges), "boundary"), A.boundary_pairs(graph))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode(mode).option("compression", "zstd").parquet(f"{path.rstrip('/')}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        return cls(*(spark.read.parquet(f"{path.rstrip('/')}/{f.name}") for f in fields(cls)))

    # -- communities

    def community_of(self, vids: DataFrame) -> DataFrame:
        """``(vid, community)``."""
        return vids.select("vid").join(self.places, "vid").select("vid", "community")

    def is_boundary(self, vids: DataFrame) -> DataFrame:
        """``(vid, is_boundary)`` of every vertex of ``vids``."""
        ends = self.boundary.where("kind = 'member'").select(F.col("src").alias("vid"), F.lit(True).alias("hit"))
        return vids.select("vid").join(ends, "vid", "left").select("vid", F.coalesce("hit", F.lit(False)).alias("is_boundary"))

    def boundary_of(self) -> DataFrame:
        """``(community, vid)``: the boundary vertices of every community."""
        return self.boundary.where("kind = 'member'").select(F.col("src").alias("vid")).join(self.places, "vid").select("community", "vid")

    def neighbour_boundaries(self, vids: DataFrame) -> DataFrame:
        """``(vid, neighbour)``: the ends in other communities of the edges out of ``vids``."""
        cross = self.boundary.where("kind = 'cross'").select(F.col("src").alias("vid"), F.col("dst").alias("neighbour"))
        return cross.join(vids.select("vid").distinct(), "vid", "left_semi")

    # -- strong components

    def component_of(self, vids: DataFrame) -> DataFrame:
        """``(vid, component)``."""
        return vids.select("vid").join(self.places, "vid").select("vid", "component")

    def members_of(self, components: DataFrame) -> DataFrame:
        """``(component, vid)``."""
        return self.places.join(components.select("component").distinct(), "component", "left_semi").select("component", "vid")

    def level_of(self, vids: DataFrame) -> DataFrame:
        """``(vid, level)``: the level of each vertex's component."""
        return vids.select("vid").join(self.places, "vid").select("vid", "level")

    def component_levels(self) -> DataFrame:
        """``(component, level)``."""
        return self.places.select("component", "level").distinct()

    def at_level(self, level: int) -> DataFrame:
        """``(component)``: the components of one level."""
        return self.places.where(F.col("level") == level).select("component").distinct()
