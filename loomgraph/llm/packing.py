"""Filling containers of fixed capacity by harmonic packing, every worker on its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.tokens import Sizer, byte_tokens
from loomgraph.storage import arrow_schema

#: Items of the classes from this one on first fill what the containers of larger items leave free.
FILLER_CLASS = 7
#: Documents that a worker packs at a time; bounds its memory.
CHUNK = 200_000


def _fill(rest: np.ndarray, small: np.ndarray) -> np.ndarray:
    """For every item of ``small`` (sizes, largest first) a container with room in ``rest``, or -1. ``rest`` is updated.

    Containers are visited from the roomiest on; a container takes items while they fit.
    """
    out = np.full(len(small), -1)
    order = np.argsort(-rest, kind="stable")
    prefix = np.concatenate([[0], np.cumsum(small)])
    at = 0
    for c in order:
        while at < len(small) and small[at] > rest[c]:
            at += 1  # larger than the room of this and of every later container
        if at == len(small):
            break
        end = int(np.searchsorted(prefix, prefix[at] + rest[c], "right")) - 1
        out[at:end] = c
        rest[c] -= prefix[end] - prefix[at]
        at = end
    return out


def pack(sizes: np.ndarray, capacity: int, filler_class: int = FILLER_CLASS, filled: np.ndarray | None = None) -> np.ndarray:
    """Container numbers from 0 for items of at most ``capacity``.

    An item of class k has a size in (capacity/(k+1), capacity/k], and k of them make a full container of their class.
    Small items first go to the space that containers of larger classes leave; the others make containers of
    their own class. Containers short of their count are opened again, and their items packed best-fit. ``filled``, if given, is set
    for the items that were not packed in a full container of their class.
    """
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    if filled is not None:
        filled[:] = True
    if not n:
        return out
    order = np.argsort(-sizes, kind="stable")
    classes = capacity // np.maximum(sizes, 1)
    loads: list[int] = []

    def harmonic(items: np.ndarray) -> np.ndarray:
        """Full containers of one class each; returns the items left over."""
        over = []
        ks = classes[items]
        for k in np.unique(ks):
            mine = items[ks == k]
            full = len(mine) // k * k
            if full:
                first = len(loads)
                out[mine[:full]] = first + np.arange(full) // k
                if filled is not None:
                    filled[mine[:full]] = False
                loads.extend(np.add.reduceat(sizes[mine[:full]], np.arange(0, full, k)).tolist())
            over.append(mine[full:])
        return np.concatenate(over) if over else items[:0]

    def fill(items: np.ndarray) -> np.ndarray:
        if not len(items) or not loads:
            return items
        rest = capacity - np.array(loads, np.int64)
        place = _fill(rest, sizes[items])
        out[items] = place
        loads[:] = (capacity - rest).tolist()
        return items[place < 0]

    small = classes[order] >= filler_class
    left = harmonic(order[~small])
    for i in sorted(left, key=lambda i: -sizes[i]):  # fewer than filler_class**2 / 2 of them
        rest = capacity - np.array(loads[-4 * filler_class :], np.int64)
        fits = np.flatnonzero(rest >= sizes[i])
        if len(fits):
            c = len(loads) - len(rest) + int(fits[np.argmin(rest[fits])])
            loads[c] += int(sizes[i])
        else:
            c = len(loads)
            loads.append(int(sizes[i]))
        out[i] = c
    left = fill(order[small])
    left = fill(harmonic(left))
    while len(left):  # what is left is open: gather it in whole containers by size
        loads.append(0)
        left = fill(left)
    return out


def _pack_chunks(capacity: int, kind: pa.DataType, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            ids = pa.concat_arrays([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            # an item above the capacity is divided: whole containers, and a rest that is packed like the others
            pieces = np.maximum(1, -(-size // capacity))
            doc = np.repeat(np.arange(len(size)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            part = np.minimum(size[doc] - start, capacity)
            filled = np.zeros(len(part), bool)
            box = pack(part, capacity, filled=filled)
            columns = [pa.array(base + box), ids.take(pa.array(doc)).cast(kind), *map(pa.array, (number, start, part, pieces[doc], filled))]
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)
            base += int(box.max()) + 1
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0), b.column(1).to_numpy()))
            count += b.num_rows
            if count >= CHUNK:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return run


def fill_containers(docs: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text", size: Sizer = byte_tokens) -> DataFrame:
    """``(container_id, doc_id, piece, start, tokens, n_pieces, filled)``: a container of ``capacity`` tokens for every document.

    ``filled`` tells what went to space left free from what is in a full container of its own class. Only documents above the capacity are divided, into ``n_pieces`` ranges ``[start, start + tokens)`` of their tokens.
    Empty and null texts have 0 tokens and come out once; repeated rows are documents of their own; null ids stay null;
    an empty table gives no rows. Each input split is packed alone from (id, size) pairs without a shuffle, in
    the order of ids, so a retried task numbers its containers alike.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    sized = docs.select(F.col(doc_id).alias("id"), size(F.col(text)).alias("n")).sortWithinPartitions("id", "n")
    schema = T.StructType([T.StructField("container_id", T.LongType()), T.StructField(doc_id, docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("piece", "start", "tokens", "n_pieces")], T.StructField("filled", T.BooleanType())])
    arrow = arrow_schema(schema)
    return sized.mapInArrow(_pack_chunks(capacity, arrow.field(1).type, arrow), schema)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, items in full containers of their class and in space left free, share of the space used, and what the
    tokens would need at least."""
    total = packed.agg(
        F.countDistinct("container_id").alias("n_containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("piece") == 0, 1)).alias("n_documents"),
        F.count(F.when(~F.col("filled"), 1)).alias("n_by_class"), F.count(F.when(F.col("filled"), 1)).alias("n_by_filling"),
    )
    return total.withColumns({"least_containers": F.ceil(F.col("tokens") / capacity), "used_share": F.when(F.col("n_containers") > 0, F.col("tokens") / (F.col("n_containers") * capacity))})
