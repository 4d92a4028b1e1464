"""Session helpers and lineage cuts in the folder that all executors share.

Iterative operators write their state as Parquet below ``spark.checkpoint.dir`` and read it back, so a
lost executor never loses state and a plan never grows with the number of rounds.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LIVE: set[str] = set()


def session(app: str = "loomgraph", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use. A cluster brings its own session."""
    base = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    builder = SparkSession.builder
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete the table behind a frame that :func:`materialize` returned and nobody reads any more."""
    path = getattr(df, "_loom_path", None)
    if path in _LIVE:
        _LIVE.discard(path)
        _delete(spark, path)


def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_LIVE):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            pass
        _LIVE.discard(path)


atexit.register(_release_all)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/loomgraph/{os.getpid()}-{name}-{uuid.uuid4().hex}"
    _LIVE.add(path)
    return path


def _observed(seen: Observation) -> int | None:
    """The observed row count; None if Spark's listener has lost it."""
    box: list[int] = []
    waiting = threading.Thread(target=lambda: box.append(seen.get["rows"]), daemon=True)
    waiting.start()
    waiting.join(60)
    return box[0] if box else None


def materialize(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it: the lineage ends here.

    Files are zstd Parquet, deleted by :func:`release` or when the process ends. Rows are counted while they are written.
    """
    spark, seen = df.sparkSession, Observation()
    path = scratch(spark, name)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path, out._loom_rows = path, _observed(seen)
    return out


def n_rows(df: DataFrame) -> int:
    """Its number of rows: known of a frame that :func:`materialize` returned, else counted."""
    known = getattr(df, "_loom_rows", None)
    return df.count() if known is None else known


class Grown:
    """A table that rounds append to. Parts are written once and folded into one when there are more than ``most``, so a plan
    that reads it stays small however many rounds there are."""

    def __init__(self, name: str, most: int = 8):
        self.name, self.most, self.parts = name, most, []

    def add(self, df: DataFrame) -> DataFrame:
        """Append ``df``; the frame that comes back reads what was written."""
        part = materialize(df, self.name)
        if len(self.parts) >= self.most:
            whole = materialize(self.frame(), self.name)
            for old in self.parts:
                release(df.sparkSession, old)
            self.parts = [whole]
        self.parts.append(part)
        return part

    def frame(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions that a stage of ours should have at most; adaptive execution merges the small ones."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_schema(schema):
    """The Arrow schema that Spark's Arrow exchanges expect for ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
