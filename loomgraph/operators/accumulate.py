"""Per-key results where a few keys hold most rows: dictionary codes, dense accumulators, summed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.storage import arrow_schema, width

#: Rows gathered before their accumulators are flushed, and keys per array block. They bound a splitting worker's memory; a summing one
#: holds two numbers for each distinct key of its blocks, as a hash aggregate does.
SPLIT_ROWS, BLOCK_KEYS = 1 << 19, 256


def _accumulate(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Dictionary-encode the keys and scatter both measures into dense arrays, one slot per code."""
    keys = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    codes, n = keys.indices.to_numpy(zero_copy_only=False), len(keys.dictionary)
    rows, items = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(rows, codes, np.concatenate([p[1] for p in parts]))
    np.add.at(items, codes, np.concatenate([p[2] for p in parts]))
    return keys.dictionary, rows, items, codes


def _split_blocks(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, rows, items, codes = _accumulate([h[:3] for h in held])
            block = np.zeros(len(keys), np.int32)
            block[codes] = np.concatenate([h[3] for h in held])
            order = np.argsort(block, kind="stable")
            block = block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            edges = np.concatenate([[0], cuts, [len(block)]])
            cut = sorted({int(i) for a, b in zip(edges[:-1], edges[1:]) for i in range(a, b, BLOCK_KEYS)})
            keys, rows, items = keys.take(pa.array(order)), rows[order], items[order]
            offsets = pa.array([*cut, len(block)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys, pa.array(rows), pa.array(items))]
            yield pa.RecordBatch.from_arrays([pa.array(block[cut]), *[x.cast(f.type) for x, f in zip(lists, list(out)[1:])]], schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("k"), b.column("rows").to_numpy(), b.column("items").to_numpy(), b.column("block").to_numpy()))
            count += b.num_rows
            if count >= SPLIT_ROWS:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return run


def _sum_blocks(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = [], [], 0

        def fold() -> list:
            keys, rows, items, _ = _accumulate(total + held)
            return [(keys, rows, items)]

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("keys").flatten()
            held.append((keys, b.column("rows").flatten().to_numpy(), b.column("items").flatten().to_numpy()))
            size += len(keys)
            if size >= 4 * SPLIT_ROWS:
                total, held, size = fold(), [], 0
        if total or held:
            keys, rows, items = fold()[0]
            whole = pa.RecordBatch.from_arrays([keys.cast(out.field(0).type), pa.array(rows), pa.array(items)], schema=out)
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

    return run


def key_totals(df: DataFrame, key: str, item: str) -> DataFrame:
    """``(key, n_rows, n_items)``: rows and distinct non-null ``item`` values of every non-null ``key``.

    Equal (key, item) rows are merged first, hashed by the pair, so a key with a third of all rows is spread
    over all tasks. Each task encodes its keys, scatter-adds into dense arrays and sends them as array blocks;
    blocks are summed by a second, much smaller shuffle. Null keys are left aside; a key with only null items has
    ``n_items`` 0. An empty table gives no rows. Columns other than the two are not read.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    pairs = df.select(F.col(key).alias("k"), F.col(item).alias("i")).where(F.col("k").isNotNull()).groupBy("k", "i").agg(F.count(F.lit(1)).alias("rows"))
    blocks = 8 * width(spark)
    pairs = pairs.select("k", "rows", F.col("i").isNotNull().cast("long").alias("items"), F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"))
    lists = [T.StructField(n, T.ArrayType(t)) for n, t in (("keys", kind), ("rows", T.LongType()), ("items", T.LongType()))]
    sent = T.StructType([T.StructField("block", T.IntegerType()), *lists])
    done = T.StructType([T.StructField(key, kind), T.StructField("n_rows", T.LongType()), T.StructField("n_items", T.LongType())])
    partial = pairs.mapInArrow(_split_blocks(arrow_schema(sent)), sent)
    return partial.repartition("block").mapInArrow(_sum_blocks(arrow_schema(done)), done)
