"""Edge changes as a stream: an append-only log whose latest state is kept per edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.changes import apply_changes

FEED = "delta_id long, src long, dst long, ts long, op int, since long, recv_at timestamp"


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The Parquet files of a change log as a stream, in the order they arrive."""
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(feed: DataFrame, log: str, checkpoint: str):
    """Append a feed to the log table once each, by the stream's own checkpoint; returns the running query.

    Applying is a read of the log, where order and repeats no longer matter: late rows are never dropped.
    """
    return feed.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, base: DataFrame, log: str) -> DataFrame:
    """The edges now: the base with the whole log applied."""
    return apply_changes(base, spark.read.schema(FEED).parquet(log))


def compact(spark: SparkSession, base: DataFrame, log: str, path: str) -> None:
    """Write the current edges as a new base; an add keeps the ``ts`` and ``delta_id`` it rests on."""
    current(spark, base, log).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def activity(feed: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Changes per window of their own time and kind, for monitoring a running stream: rows later than ``late`` are left out of this count
    only, and Spark reports their number as ``numRowsDroppedByWatermark`` of the query's progress. :func:`activity_of` is exact.
    """
    timed = feed.where("ts IS NOT NULL").withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "op").agg(F.count(F.lit(1)).alias("n"))


def activity_of(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """The same count over an ingested log, with every row however late it came."""
    timed = log.where("ts IS NOT NULL").withColumn("at", F.timestamp_micros("ts"))
    return timed.groupBy(F.window("at", window), "op").agg(F.count(F.lit(1)).alias("n"))


def rows_left_out(query) -> int:
    """How many rows a running or ended :func:`activity` query has left out so far."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
