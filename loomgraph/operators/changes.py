"""A feed of edge changes applied to a base table as a signed multiset of row images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADD, REMOVE = 0, 1


def deciding_changes(feed: DataFrame) -> DataFrame:
    """``(src, dst, ts, delta_id, op, since)``: per edge the change with the largest ``ts``.

    On equal ``ts`` the smallest ``delta_id`` decides (a null ``delta_id`` comes last). Rows with a null ``src``, ``dst``,
    ``ts`` or ``op`` and rows with a reserved ``op`` are ignored; repeated and late rows change nothing. It is a partial
    aggregate before the shuffle, so an edge with a third of the feed costs one row per task.
    """
    rows = feed.select("src", "dst", "ts", "op", "delta_id", "since").where(
        F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("ts").isNotNull() & F.col("op").isin(ADD, REMOVE)
    )
    top = F.max(F.struct("ts", F.negative("delta_id").alias("neg"), "op", "since")).alias("top")
    return rows.groupBy("src", "dst").agg(top).select("src", "dst", F.col("top.ts").alias("ts"), F.negative("top.neg").alias("delta_id"), F.col("top.op").alias("op"), F.col("top.since").alias("since"))


def apply_changes(base: DataFrame, feed: DataFrame) -> DataFrame:
    """``(src, dst, delta_id, since, ts)``: the current edges and the change each rests on.

    Every deduplicated change puts a -1 before-image (the base row of its edge) and, if it is an add, a +1 after-image
    on the multiset; images are summed with the +1 images of the base, and those with a positive multiplicity stay.
    An edge that rests on the base has a null ``delta_id``, ``since`` and ``ts``; repeated base rows are one edge, base rows
    with a null end are none. Removing an absent edge leaves a negative image, which is dropped.
    """
    none = F.lit(None).cast("long")
    last = deciding_changes(feed)
    images = F.array(
        F.struct(none.alias("delta_id"), none.alias("since"), none.alias("ts"), F.lit(-1).alias("m")),
        F.struct(F.col("delta_id"), F.col("since").cast("long").alias("since"), F.col("ts"), F.when(F.col("op") == ADD, 1).otherwise(0).alias("m")),
    )
    changed = last.select("src", "dst", F.inline(images))
    stored = base.select(F.col("src").cast("long"), F.col("dst").cast("long")).where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    stored = stored.select("src", "dst", none.alias("delta_id"), none.alias("since"), none.alias("ts"), F.lit(1).alias("m"))
    total = stored.unionByName(changed).groupBy("src", "dst", "delta_id", "since", "ts").agg(F.sum("m").alias("m"))
    return total.where(F.col("m") > 0).drop("m")
