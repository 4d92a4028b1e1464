"""Property files for vertices and edges: CSV with a header, or JSON objects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.config import Options
from loomgraph.model import PropertyGraph
from loomgraph.sources.graph_file import read_graph


def _typed(df: DataFrame, names: list[str]) -> DataFrame:
    """Give text columns the narrowest type that all their cells have: LONG, DOUBLE, BOOLEAN or STRING; empty cells are null."""
    if not names:
        return df
    df = df.withColumns({c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in names})
    fails = lambda c, ok: F.count(F.when(F.col(c).isNotNull() & ~ok, 1))
    tests = []
    for i, c in enumerate(names):
        text = F.trim(F.col(c))
        tests += [fails(c, text.rlike(r"^[-+]?\d{1,18}$")).alias(f"l{i}"), fails(c, text.rlike(r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$")).alias(f"d{i}"), fails(c, F.lower(text).isin("true", "false")).alias(f"b{i}"), F.count(c).alias(f"n{i}")]
    seen = df.agg(*tests).first()
    casts = {}
    for i, c in enumerate(names):
        kind = "string" if not seen[f"n{i}"] else "long" if not seen[f"l{i}"] else "double" if not seen[f"d{i}"] else "boolean" if not seen[f"b{i}"] else "string"
        casts[c] = F.trim(F.col(c)).cast(kind) if kind != "string" else F.col(c)
    return df.withColumns(casts)


def read_properties(spark: SparkSession, path: str | None, keys: tuple[str, ...], multi_line: bool = True) -> DataFrame | None:
    """Rows of a ``.csv`` or ``.json`` property file with the LONG columns ``keys``, each key once; None for other names and for no path.

    Of rows with the same key the last one stays, whole: that of the last file by time and name, there the last line. With
    ``multi_line=False`` a record is one line, JSON is one object a line, and large files are split.

    CSV cells are typed per column, with text as the fallback. JSON may be one object or an array of objects; nested values
    are JSON text and null is an absent property. A missing or non-integral key column raises ValueError.
    """
    if not path or not path.endswith((".csv", ".json")):
        return None
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
        absent = [k for k in keys if k not in df.columns]
    else:
        df = spark.read.json(path, multiLine=multi_line)
        absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError(f"{path} has no column {absent[0]}")
    for k in keys:
        if not isinstance(df.schema[k].dataType, (T.StringType, T.LongType)):
            raise ValueError(f"{k} in {path} is not integral")
    wrong = df.where(F.greatest(*[F.col(k).cast("string").try_cast("long").isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).cast("string").try_cast("long").isNull())
    if not wrong.isEmpty():
        raise ValueError(f"{path} has rows whose {', '.join(keys)} is not an integer")
    rest = [c for c in df.columns if c not in keys and c != "_corrupt_record"]
    # within one split of a file, ids rise from line to line
    place = F.struct(*[F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path", "file_block_start")], F.monotonically_increasing_id().alias("row"))
    df = df.select(*[F.trim(F.col(k).cast("string")).cast("long").alias(k) for k in keys], F.struct(*rest, F.lit(0).alias("_some")).alias("_cells"), place.alias("_place"))
    df = df.groupBy(*keys).agg(F.max_by("_cells", "_place").alias("_cells")).select(*keys, *[F.col(f"_cells.`{c}`").alias(c) for c in rest])
    if path.endswith(".csv"):
        return _typed(df.select(*keys, *rest), [c for c in rest if c != "label"])
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({c: F.to_json(F.col(c)) for c in nested}).select(*keys, *rest) if nested else df.select(*keys, *rest)


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key. Files come with one already; of other frames, which have no order, the largest row stays."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*") if rest else df.distinct()


def attach_vertex_properties(graph: PropertyGraph, rows: DataFrame | None) -> PropertyGraph:
    """Replace all properties (and the label, where given) of the vertices that ``rows (vertex, ...)`` has."""
    if rows is None:
        return graph
    rows = _latest(rows.withColumnRenamed("vertex", "vid"), ["vid"])
    if "label" in rows.columns:
        rows = rows.withColumnRenamed("label", "_label")
    kept = graph.vertices.drop(*[c for c in rows.columns if c != "vid"]).join(rows, "vid", "left")
    if "_label" in kept.columns:
        kept = kept.withColumn("label", F.coalesce("_label", "label")).drop("_label")
    return graph.with_(kept)


def attach_edge_properties(graph: PropertyGraph, rows: DataFrame | None) -> PropertyGraph:
    """As :func:`attach_vertex_properties` for ``rows (outVertex, inVertex, ...)``; pairs that are no edges are not added."""
    if rows is None:
        return graph
    rows = _latest(rows.withColumnsRenamed({"outVertex": "src", "inVertex": "dst"}), ["src", "dst"])
    if "label" in rows.columns:
        rows = rows.withColumnRenamed("label", "_label")
    kept = graph.edges.drop(*[c for c in rows.columns if c not in ("src", "dst")]).join(rows, ["src", "dst"], "left")
    if "_label" in kept.columns:
        kept = kept.withColumn("label", F.coalesce("_label", "label")).drop("_label")
    return graph.with_(edges=kept)


_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]*")
#: Bytes that an uploaded file may have.
UPLOAD_BYTES = 100 << 20


def load_graph(spark: SparkSession, name: str, graph: str, vertex_file: str | None = None, edge_file: str | None = None, options: Options | None = None) -> PropertyGraph:
    """A named graph from its topology and optional property files."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no graph name")
    loaded = read_graph(spark, graph)
    loaded = PropertyGraph(loaded.vertices, loaded.edges, options)
    loaded = attach_vertex_properties(loaded, read_properties(spark, vertex_file, ("vertex",)))
    return attach_edge_properties(loaded, read_properties(spark, edge_file, ("outVertex", "inVertex")))


class GraphStore:
    """Graphs by name in a folder that all executors share: one saved graph a subfolder.

    ``open`` gives the saved graph, or a new empty one; ``upload`` reads files, saves the graph under its name and gives it;
    ``reload`` gives it again as it is now on disk.
    """

    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options

    def _path(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no graph name")
        return f"{self.folder}/{name}"

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, name: str) -> bool:
        files, target = self._file(f"{self._path(name)}/edges/_SUCCESS")
        return files.exists(target)

    def open(self, name: str) -> PropertyGraph:
        if not self.exists(name):
            PropertyGraph.empty(self.spark).save(self._path(name), "overwrite")
        return PropertyGraph.load(self.spark, self._path(name), self.options)

    def reload(self, name: str) -> PropertyGraph:
        self.spark.catalog.refreshByPath(self._path(name))
        return self.open(name)

    def save(self, name: str, graph: PropertyGraph) -> PropertyGraph:
        """Replace the graph of that name. It may be made from the saved one: the new files are written beside the old ones first."""
        new, path = f"{self._path(name)}.new", self._path(name)
        graph.save(new, "overwrite")
        files, old = self._file(path)
        files.delete(old, True)
        files.rename(self._file(new)[1], old)
        return self.reload(name)

    def upload(self, name: str, graph: str, vertex_file: str | None = None, edge_file: str | None = None) -> PropertyGraph:
        """Suffixes and sizes are checked first: ``.graph``, ``.csv`` or ``.json``, up to ``UPLOAD_BYTES`` each."""
        for path, suffixes in ((graph, (".graph",)), (vertex_file, (".csv", ".json")), (edge_file, (".csv", ".json"))):
            if path is None:
                continue
            if not path.endswith(suffixes):
                raise ValueError(f"{path} does not end with {' or '.join(suffixes)}")
            files, target = self._file(path)
            if files.getContentSummary(target).getLength() > UPLOAD_BYTES:
                raise ValueError(f"{path} has more than {UPLOAD_BYTES} bytes")
        return self.save(name, load_graph(self.spark, name, graph, vertex_file, edge_file, self.options))


def synthetic(spark: SparkSession, n_vertices: int = 10_000, n_edges: int = 20_000, seed: int = 7) -> PropertyGraph:
    """``user`` vertices 1..n with an age of 18 to 77 and random ``follows`` edges with a weight, without self-loops."""
    v = spark.range(1, n_vertices + 1).select(F.col("id").alias("vid"), F.lit("user").alias("label"), F.concat(F.lit("user_"), "id").alias("name"), (18 + F.col("id") % 60).alias("age"))
    pick = lambda s: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(s)), F.lit(n_vertices)) + 1)
    e = spark.range(n_edges).select(pick(1).alias("src"), pick(2).alias("dst"), F.lit("follows").alias("label"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), F.lit(100)) / 100).alias("weight"))
    return PropertyGraph(v, e.where("src <> dst").dropDuplicates(["src", "dst"]))
