"""Running totals per key that no hot key can slow down.

A window over ``partitionBy(key)`` puts a key's rows into one task. Here the rows are range-partitioned by
(key, order), so a hot key spreads over many tasks; each task sums its own stretch, and what a key held in
earlier stretches is added afterwards from one summary row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.storage import arrow_schema, materialize

PID, HEAD, LAST, FIRST = "_pid", "_head", "_last", "_first"


def _stretches(key: str | None, values: list[str], out: pa.Schema):
    """Sums within one sorted partition; a row of the partition's first key is marked ``_head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        first, previous, at_head = None, None, True
        carry = np.zeros(len(values), np.int64)
        held: dict | None = None

        def emit(columns: dict, last: bool) -> pa.RecordBatch:
            n = len(columns[HEAD])
            flags = np.zeros(n, bool)
            flags[-1] = last
            columns[LAST] = pa.array(flags)
            known = pa.array([first] * last, out.field(FIRST).type) if key else pa.array([0] * last, out.field(FIRST).type)
            columns[FIRST] = pa.concat_arrays([pa.nulls(n - last, out.field(FIRST).type), known])
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield emit(held, False)
            if key:
                keys = batch.column(key)
                change = np.zeros(n, bool)
                if n > 1:
                    change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                here, there = keys[0].as_py(), keys[n - 1].as_py()
            else:
                change, here, there = np.zeros(n, bool), 0, 0
            if previous is None:
                first, same = here, False
            else:
                same = here == previous
                at_head = at_head and same
            stretch = np.cumsum(change)
            starts = np.flatnonzero(np.concatenate([[True], change[1:]]))
            columns = {f.name: batch.column(f.name) for f in out if f.name in batch.schema.names}
            for k, name in enumerate(values):
                v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                base = total[starts] - v[starts]
                if same:
                    base[0] -= carry[k]
                total = total - base[stretch]
                carry[k] = total[-1]
                columns[f"run_{name}"] = pa.array(total)
            head = (stretch == 0) & at_head
            at_head = bool(head[-1])
            columns[HEAD] = pa.array(head)
            columns[PID] = pa.array(np.full(n, pid, np.int32))
            previous, held = there, columns
        if held is not None:
            yield emit(held, True)

    return run


def running_totals(df: DataFrame, key: str | None, order: list[str], values: list[str], needed: Column | None = None) -> DataFrame:
    """Add ``run_<v>``, the sum of ``v`` (LONG) over the rows of the same ``key`` up to and including this one.

    Rows are ordered by ``order`` within a key; with ``key=None`` there is one order over all rows. ``key`` and
    ``values`` must not be null. ``needed`` may drop rows before they are written: it sees the totals within
    the partition and is applied only to rows whose totals are already final. Ties in ``order`` come in
    any sequence, so callers end ``order`` with a unique column. An empty input gives an empty result.

    The driver sees one summary row per shuffle partition, never data that grows with a key.
    """
    spark = df.sparkSession
    lead = [key] if key else []
    ordered = df.repartitionByRange(*[F.col(c) for c in lead + order]).sortWithinPartitions(*lead, *order)
    fields = [f for f in df.schema.fields] + [T.StructField(f"run_{v}", T.LongType()) for v in values]
    fields += [T.StructField(PID, T.IntegerType()), T.StructField(HEAD, T.BooleanType()), T.StructField(LAST, T.BooleanType())]
    fields += [T.StructField(FIRST, df.schema[key].dataType if key else T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    swept = ordered.mapInArrow(_stretches(key, values, arrow_schema(schema)), schema)
    if needed is not None:
        swept = swept.where(F.col(HEAD) | F.col(LAST) | needed)
    swept = materialize(swept, "sweep")
    key_of = F.col(key) if key else F.lit(0)
    ends = swept.where(LAST).select(PID, F.col(FIRST).alias("f"), key_of.alias("k"), F.col(HEAD).alias("h"), *[f"run_{v}" for v in values])
    carry, state, totals = [], None, [0] * len(values)
    for row in sorted(ends.collect(), key=lambda r: r[PID]):
        into = totals if state is not None and row["f"] == state else [0] * len(values)
        if any(into):
            carry.append((row[PID], *into))
        mine = [row[f"run_{v}"] for v in values]
        state, totals = row["k"], [a + b * row["h"] for a, b in zip(mine, into)]
    names = [f"_carry_{v}" for v in values]
    if carry:
        brought = spark.createDataFrame(carry, T.StructType([T.StructField(PID, T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names]]))
        swept = swept.join(F.broadcast(brought), PID, "left")  # at most one row per partition
        swept = swept.withColumns({f"run_{v}": F.col(f"run_{v}") + F.when(F.col(HEAD), F.coalesce(F.col(c), F.lit(0))).otherwise(0) for v, c in zip(values, names)})
    return swept.select(*df.columns, *[f"run_{v}" for v in values])
