"""References to records that do not exist: direct orphans, and their inherited orphans down the foreign keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import is_small, lookup
from loomgraph.operators.sweep import running_totals
from loomgraph.storage import Grown, materialize, n_rows, release

#: Microseconds; before and after every timestamp.
_BEFORE = -(1 << 62)


@dataclass(frozen=True)
class ForeignKey:
    """``child.columns`` refer to ``parent.parent_columns``; with ``child_time`` the parent is versioned.

    A versioned parent row exists during ``[parent_from, parent_to)``, and the reference is judged at ``child_time``.
    """

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    child_time: str | None = None
    parent_from: str | None = None
    parent_to: str | None = None

    @property
    def name(self) -> str:
        return ",".join(self.columns)


def dangling(child: DataFrame, row_id: str, refs: Sequence[str], time: str, parent: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``(row_id, ref_column, reason, period)``: references without a parent row valid at ``time``.

    A parent row is valid during ``[start, end)``, for good if ``end`` is null, never if ``start`` is null or ``end`` is not
    after it. ``reason`` is ``missing`` if the key has no parent row at all, else ``late`` if none had started by ``time``, else
    ``deleted``; a null ``time`` finds no parent valid or started, and its ``period`` (``YYYY-MM``) is null. Null references are no
    cases. Keys and references must be LONG, ``row_id`` unique; repeated child rows come out repeated.

    Parent events and references are swept together in (key, time) order with carried counts, so neither a key that
    holds a third of the references nor one with countless versions meets in one task, and no pair is formed.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    versions = parent.select(F.col(key).cast("long").alias("v"), micros(start).alias("a"), micros(end).alias("b")).where(F.col("v").isNotNull())
    event = lambda t, kind, when: F.when(when, F.struct(t.alias("t"), F.lit(kind).alias("rank")))
    started = F.col("a").isNotNull()
    events = versions.select("v", F.explode(F.array_compact(F.array(
        event(F.lit(_BEFORE), 0, F.lit(True)),
        event(F.col("a"), 1, started),
        event(F.greatest("a", "b"), 2, started & F.col("b").isNotNull()),
    ))).alias("e"))
    events = events.groupBy("v", F.col("e.t").alias("t"), F.col("e.rank").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    events = events.select("v", "t", "rank", *[F.when(F.col("rank") == r, F.col("n")).otherwise(none).alias(c) for r, c in enumerate(("present", "started", "ended"))], F.lit(None).cast(child.schema[row_id].dataType).alias("id"), F.lit(-1).alias("ref"))
    asked = child.select(F.col(row_id).alias("id"), F.coalesce(micros(time), F.lit(_BEFORE + 1)).alias("t"), F.posexplode(F.array(*[F.col(c).cast("long") for c in refs])).alias("ref", "v"))
    asked = asked.where(F.col("v").isNotNull()).select("v", "t", F.lit(3).alias("rank"), none.alias("present"), none.alias("started"), none.alias("ended"), "id", "ref")
    counts = ["present", "started", "ended"]
    is_ref = F.col("rank") == 3
    orphan = F.col("run_started") <= F.col("run_ended")
    swept = running_totals(events.unionByName(asked), "v", ["t", "rank", "id", "ref"], counts, is_ref & orphan)
    reason = F.when(F.col("run_present") == 0, "missing").when(F.col("run_started") == 0, "late").otherwise("deleted")
    at = F.when(F.col("t") > _BEFORE + 1, F.timestamp_micros("t"))
    return swept.where(is_ref & orphan).select(
        F.col("id").alias(row_id), F.element_at(F.array(*map(F.lit, refs)), F.col("ref") + 1).alias("ref_column"), reason.alias("reason"), F.date_format(at, "yyyy-MM").alias("period")
    )


def _references(child: DataFrame, row_id: str, fk: ForeignKey, time: str | None) -> tuple[DataFrame, list[str]]:
    """``(row_id, k0, ..., period)`` of the references of one foreign key without a null, and the names of its columns there."""
    names = [f"k{i}" for i in range(len(fk.columns))]
    period = F.date_format(time, "yyyy-MM") if time else F.lit(None).cast("string")
    return child.select(F.col(row_id), *[F.col(c).alias(n) for c, n in zip(fk.columns, names)], period.alias("period")).dropna(subset=names), names


def _plain_dangling(child: DataFrame, row_id: str, fk: ForeignKey, parent: DataFrame, time: str | None) -> DataFrame:
    """As :func:`dangling` for an unversioned parent. Distinct keys are compared, so a hot one costs a row a task; then the rows are looked up."""
    rows, names = _references(child, row_id, fk, time)
    keys = parent.select(*[F.col(c).alias(n) for c, n in zip(fk.parent_columns, names)]).dropna().distinct()
    asked = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
    lost = materialize(asked.join(keys, names, "left_anti"), "lost")
    return lookup(rows, lost, names, "inner", counts="n_rows").select(row_id, F.lit(fk.name).alias("ref_column"), F.lit("missing").alias("reason"), "period")


def _heirs(tables: dict[str, DataFrame], row_ids: dict[str, str], fk: ForeignKey, gone: DataFrame, fresh: DataFrame, time: str | None, used: list) -> DataFrame:
    """``(row_id, ref_column, period)``: references to keys all of whose parent rows are ``gone (id)``, at least one of them ``fresh (id)``.

    ``used`` gets the tables that the result reads.
    """
    rows, names = _references(tables[fk.child], row_ids[fk.child], fk, time)
    held = tables[fk.parent].select(F.col(row_ids[fk.parent]).alias("id"), *[F.col(c).alias(n) for c, n in zip(fk.parent_columns, names)]).dropna(subset=names)
    mark = materialize(gone.join(fresh.withColumn("fresh", F.lit(1)), "id", "left"), "gone")
    # ids are unique, so none is hot: "fresh" is 1 at most
    touched = lookup(held, mark, "id", "inner", counts="fresh").groupBy(*names).agg(F.count(F.lit(1)).alias("lost"), F.count("fresh").alias("fresh"))
    touched = materialize(touched.where("fresh > 0").select(*names, "lost"), "touched")
    if is_small(touched):
        held = held.join(F.broadcast(touched.select(*names)), names, "left_semi")
    full = held.groupBy(*names).agg(F.count(F.lit(1)).alias("all"))
    dead = materialize(full.join(touched, names).where(F.col("lost") == F.col("all")).select(*names), "dead")
    release(dead.sparkSession, mark)
    release(dead.sparkSession, touched)
    used.append(dead)
    return lookup(rows, dead, names, "inner").select(row_ids[fk.child], F.lit(fk.name).alias("ref_column"), "period")


def cascade(tables: dict[str, DataFrame], row_ids: dict[str, str], keys: Sequence[ForeignKey], times: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Per child table ``(row_id, ref_column, reason, period, level)``; ``level`` 0 are direct, others inherited orphans.

    A row is inherited if it refers to parent rows all of which are orphans themselves. Starting from the direct
    orphans, semi-joins run down the foreign keys until no table gains a row, so cycles end too. ``reason`` of an
    inherited orphan is ``inherited``; a row comes out once per direct reference, and at its first level if inherited
    (then with its first foreign key). Row ids must be unique and non-null. ``times`` names the column that dates a
    table's rows for ``period``.

    Only distinct keys meet in joins of two tables; the rows of a key, hot or not, are then looked up by salted copies of it. Every
    level is written once.
    """
    times = times or {}
    found: dict[str, Grown] = {}
    gone: dict[str, Grown] = {}  # the ids alone, each once
    spark = next(iter(tables.values())).sparkSession
    grouped: dict[tuple, list[ForeignKey]] = {}
    for fk in keys:
        grouped.setdefault((fk.child, fk.parent, fk.parent_columns, fk.child_time, len(fk.columns) == 1 and bool(fk.child_time), fk.name * (not fk.child_time)), []).append(fk)
    direct: dict[str, DataFrame] = {}
    for fks in grouped.values():
        fk, rid = fks[0], row_ids[fks[0].child]
        if fk.child_time:
            lost = dangling(tables[fk.child], rid, [f.columns[0] for f in fks], fk.child_time, tables[fk.parent], fk.parent_columns[0], fk.parent_from, fk.parent_to)
        else:
            lost = _plain_dangling(tables[fk.child], rid, fk, tables[fk.parent], times.get(fk.child))
        lost = lost.withColumn("level", F.lit(0))
        direct[fk.child] = direct[fk.child].unionByName(lost) if fk.child in direct else lost
    fresh: dict[str, DataFrame] = {}
    for t, rows in direct.items():
        found[t], gone[t] = Grown("orphans"), Grown("gone")
        fresh[t] = gone[t].add(found[t].add(rows).select(F.col(row_ids[t]).alias("id")).distinct())
    level = 0
    while fresh:
        level += 1
        gained: dict[str, DataFrame] = {}
        used: list[DataFrame] = []
        for fk in keys:
            if fk.parent in fresh:
                heirs = _heirs(tables, row_ids, fk, gone[fk.parent].frame(), fresh[fk.parent], times.get(fk.child), used)
                gained[fk.child] = gained[fk.child].unionByName(heirs) if fk.child in gained else heirs
        fresh = {}
        for t, heirs in gained.items():
            rid = row_ids[t]
            one = heirs.groupBy(rid).agg(F.min(F.struct("ref_column", "period")).alias("x")).select(rid, "x.ref_column", F.lit("inherited").alias("reason"), "x.period", F.lit(level).alias("level"))
            one = materialize(one.join(gone[t].frame().withColumnRenamed("id", rid), rid, "left_anti").select(rid, "ref_column", "reason", "period", "level"), "heirs")
            if n_rows(one):
                fresh[t] = gone[t].add(found[t].add(one).select(F.col(rid).alias("id")))
            release(spark, one)
        for old in used:
            release(spark, old)
    return {t: rows.frame() for t, rows in found.items()}
