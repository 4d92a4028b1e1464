"""The text topology format: ``t n m``, ``v id label community``, ``e src dst``."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.model import PropertyGraph


class GraphFormatError(ValueError):
    """A line that the format does not allow."""


def read_graph(spark: SparkSession, path: str, check: bool = True) -> PropertyGraph:
    """Read a topology file or folder. Blank lines and lines of other kinds are skipped, the label field is not kept.

    Tokens are separated by white space, the community may be missing, edges come in any order. Vertices are 0..n-1 of the
    header, so one without a ``v`` line is there too. With ``check`` short lines, bad numbers and vertices or edge
    ends out of range raise :class:`GraphFormatError`; that is one aggregate over the file.
    """
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t"))
    kind = F.element_at("t", 1)
    number = lambda i: F.try_element_at("t", F.lit(i)).try_cast("long")
    parsed = lines.select(kind.alias("k"), F.size("t").alias("n"), number(2).alias("a"), number(3).alias("b"), F.try_element_at("t", F.lit(4)).try_cast("int").alias("c"), F.element_at("t", -1).try_cast("int").alias("last"))
    header = parsed.where("k = 't'").agg(F.max(F.struct("a", "b")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    if check and (not header["n"] or header["h"]["a"] is None or header["h"]["b"] is None):
        raise GraphFormatError("the header 't n m' is missing or broken")
    size = header["h"]["a"] if header["n"] else 0
    if check:
        vertex_bad = (F.col("k") == "v") & (F.col("a").isNull() | (F.col("n") < 3) | ~F.col("a").between(0, size - 1) | F.col("last").isNull())
        edge_bad = (F.col("k") == "e") & (F.col("a").isNull() | F.col("b").isNull() | ~F.col("a").between(0, size - 1) | ~F.col("b").between(0, size - 1))
        bad = parsed.where(vertex_bad | edge_bad).limit(3).collect()
        if bad:
            raise GraphFormatError(f"bad lines, for instance {[tuple(r)[:4] for r in bad]}")
    stated = parsed.where("k = 'v' AND a IS NOT NULL").groupBy(F.col("a").alias("vid")).agg(F.max(F.coalesce("c", F.when(F.col("n") > 2, F.col("last")))).alias("community"))
    vertices = spark.range(size).select(F.col("id").alias("vid")).join(stated, "vid", "left")
    edges = parsed.where("k = 'e' AND a IS NOT NULL AND b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return PropertyGraph(vertices, edges)


def write_graph(graph: PropertyGraph, path: str) -> None:
    """The inverse of :func:`read_graph`, as a folder of text files; ``vid`` must be 0..n-1."""
    v = graph.vertices.select(F.concat_ws(" ", F.lit("v"), "vid", F.lit("0"), F.coalesce("community", F.lit(0))).alias("value"))
    e = graph.edges.select(F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))
    h = graph.counts().select(F.concat_ws(" ", F.lit("t"), "n_vertices", "n_edges").alias("value"))
    h.unionByName(v).unionByName(e).write.mode("overwrite").text(path)


#: Bytes of a file that one task reads.
SPLIT_BYTES = 32 << 20


class _Reader(DataSourceReader):
    """Byte ranges of the files, parsed by Arrow. A line belongs to the range that its first byte is in."""

    def __init__(self, path: str, part: str):
        self.path, self.part = path if "://" in path else "file://" + path, part

    def partitions(self):
        files, path = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(path)
        if found.type == fs.FileType.Directory:
            found = sorted((f for f in files.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        else:
            found = [found]
        return [InputPartition((f.path, at, min(at + SPLIT_BYTES, f.size))) for f in found for at in range(0, f.size, SPLIT_BYTES)]

    def read(self, partition):
        path, start, end = partition.value
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(path) as f:
            begin = max(0, start - 1)
            f.seek(begin)
            data = f.read(end - begin)
            while not data.endswith(b"\n") and (more := f.read(1 << 16)):  # the rest of the last line
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
        if start:
            data = data[data.find(b"\n") + 1 :] if b"\n" in data[: end - begin] else b""
        lines = pa.array(data.decode().splitlines(), pa.string())
        tokens = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines))
        tokens = tokens.filter(pc.equal(pc.list_element(tokens, 0), self.part[0]))
        size = pc.list_value_length(tokens)
        if len(tokens) and pc.min(size).as_py() < 3:
            raise GraphFormatError(f"a line of {path} is too short")
        first = pc.list_element(tokens, 1).cast(pa.int64())
        if self.part == "edges":
            yield pa.RecordBatch.from_arrays([first, pc.list_element(tokens, 2).cast(pa.int64())], names=["src", "dst"])
        else:
            last = pc.take(pc.list_flatten(tokens), pc.subtract(pc.cumulative_sum(size), 1))
            yield pa.RecordBatch.from_arrays([first, last.cast(pa.int32())], names=["vid", "community"])


class GraphDataSource(DataSource):
    """``spark.read.format("graph").option("part", "edges" | "vertices").load(path)`` after :func:`register`; any file system that Arrow knows.

    Bad lines raise, as in :func:`read_graph`, which also checks ranges.
    """

    @classmethod
    def name(cls) -> str:
        return "graph"

    def schema(self) -> str:
        return "src long, dst long" if self.options.get("part", "edges") == "edges" else "vid long, community int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("part", "edges"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GraphDataSource)


def edges_from(df: DataFrame, src: str, dst: str, *rest: str) -> DataFrame:
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), *rest)
