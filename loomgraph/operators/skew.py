"""Lookup joins that keep their balance when a third of all rows ask for one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import materialize, n_rows, release

#: Tasks over which the rows of one key are spread.
SALTS = 16
#: Rows of a looked-up table that is broadcast; a few MB for tables of two or three numbers.
SMALL_ROWS = 100_000
#: Rows from which a key counts as hot where the rows of every key are known.
HOT_ROWS = 1 << 20


def is_small(table: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Counted, not estimated."""
    known = getattr(table, "_loom_rows", None)
    if known is not None:
        return known <= most
    return table.limit(most + 1).count() <= most


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "left", salts: int = SALTS, small_rows: int = SMALL_ROWS, counts: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row for every ``key`` (a column or several); a null key finds nothing.

    A ``table`` of at most ``small_rows`` counted rows is broadcast. Of a larger one every row is copied ``salts`` times, and every one of
    ``rows`` asks for one of the copies by a hash of all its columns, so the rows of a hot key meet in ``salts`` tasks.
    If the column ``counts`` of ``table`` says how many of ``rows`` have its key, only keys of more than ``hot_rows`` are copied; else ``table``
    should be much smaller than ``rows``. It is counted, so it should be written out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if is_small(table, small_rows):
        return rows.join(F.broadcast(table), keys, how)
    last, salt = F.lit(salts - 1), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
    if counts:
        is_hot = F.col(counts) > hot_rows
        hot = table.where(is_hot).select(*keys, F.lit(True).alias("_hot"))
        if hot.isEmpty() or not is_small(hot):  # none, or so many that they balance each other
            return rows.join(table.hint("merge"), keys, how)
        last, salt = F.when(is_hot, last).otherwise(0), F.when(F.col("_hot"), salt).otherwise(0)
        rows = rows.join(F.broadcast(hot), keys, "left")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("_salt", salt).drop("_hot").join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


class Spread:
    """Rows, such as edges by their source, that are joined again and again; those of a hot key are spread over salts.

    The rows are written once. If there are more than ``hot_rows``, keys with more than that are found by one count.
    """

    def __init__(self, rows: DataFrame, key: str | list[str], hot_rows: int = HOT_ROWS, salts: int = SALTS):
        self.key, self.salts, self.hot = [key] if isinstance(key, str) else key, salts, None
        self.table = self.rows = materialize(rows, "spread")
        if not is_small(self.rows, hot_rows):
            hot = materialize(self.rows.groupBy(*self.key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*self.key), "hot")
            if is_small(hot) and n_rows(hot):  # so many that they balance each other need no salt
                self.hot = hot.withColumn("_hot", F.lit(True))
                salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)).cast("int")
                self.rows = self.rows.join(F.broadcast(self.hot), self.key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")

    def join(self, asking: DataFrame) -> DataFrame:
        """All pairs of a row and one of ``asking`` with the same key."""
        if self.hot is None:
            return asking.join(self.rows, self.key)
        last = F.when(F.col("_hot"), F.lit(self.salts - 1)).otherwise(0)
        asking = asking.join(F.broadcast(self.hot), self.key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
        return asking.join(self.rows, [*self.key, "_salt"]).drop("_salt")

    def release(self) -> None:
        release(self.table.sparkSession, self.table)
