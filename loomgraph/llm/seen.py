"""Has this key been seen before? A slot filter in order of arrival routes what is certainly new; the rest is looked up exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.storage import arrow_schema, materialize

#: Bits that ``bitmap_construct_agg`` holds in one value, and its bytes.
_BITS, _BYTES = 32768, 4096
#: Rows and bytes of keys that a worker holds while it settles repeats.
SPLIT_ROWS, SPLIT_BYTES = 1 << 18, 64 << 20
#: Before every arrival, for keys that are stored; after every arrival, for a null ``request_id``.
_STORED, _LAST = -(1 << 63), (1 << 63) - 1


def _settle(out: pa.Schema):
    """Mark what repeats an earlier request of the same stretch of input, by full keys; of every key one arrival stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, kinds, keys = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            kind, key = kinds.dictionary_encode(null_encoding="encode"), keys.dictionary_encode()
            code = kind.indices.to_numpy() * len(key.dictionary) + key.indices.to_numpy()
            _, group = np.unique(code, return_inverse=True)
            at = ids.to_numpy()
            first = np.full(group.max() + 1, _LAST)
            np.minimum.at(first, group, at)
            settled = pa.array(at > first[group])
            whole = pa.RecordBatch.from_arrays([ids, kinds, pc.if_else(settled, pa.scalar(None, keys.type), keys), settled], schema=out)
            for start in range(0, whole.num_rows, 10_000):
                yield whole.slice(start, 10_000)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= SPLIT_ROWS or size >= SPLIT_BYTES:
                yield from flush()
                held, rows, size = [], 0, 0
        if held:
            yield from flush()

    return run


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct values of each stretch of a text column."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b.column(0))
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= SPLIT_ROWS or size >= SPLIT_BYTES:
            yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays(held))], names=["key"])
            held, rows, size = [], 0, 0
    if held:
        yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays(held))], names=["key"])


def _marked(rows: DataFrame, slots: DataFrame, blocks: int) -> DataFrame:
    """Add ``hit``: true if the ``slot`` of a row is among ``slots``, and for a few others: a broadcast bitmap of ``blocks`` times 4 KB tells."""
    block, bit = F.pmod("slot", F.lit(blocks)), F.pmod(F.floor(F.col("slot") / blocks), F.lit(_BITS))
    bits = slots.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.ascii(F.decode(F.substring(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
    joined = rows.withColumn("_block", block).join(F.broadcast(bits), "_block", "left")
    return joined.withColumn("hit", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("_block", "_bits")


def seen_before(
    requests: DataFrame,
    stored: DataFrame,
    stored_kind: str = "edge",
    bits_per_key: int = 16,
    slots_per_key: int = 64,
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """``(request_id, kind, seen, route, mistake)``: one row per request with a key.

    ``requests`` has ``(request_id, kind, key STRING)``: a request is ``seen`` if one of its kind with a smaller
    ``request_id`` has the same key, byte for byte, or, for ``stored_kind``, if ``stored`` (``key STRING``) has it. Keys
    that are null are no case and give no row; an empty string is a key. ``request_id`` is unique; rows that repeat an id
    and key count as one arrival, and a null id comes after all others.

    Every worker first settles, by full keys, the requests that repeat an earlier one of its own stretch of input
    (``route='exact'``, seen), so a key with a third of all rows goes on as one row a stretch. The others take a slot,
    one of ``slots_per_key`` times as many as there are keys. The filter keeps the first arrival of every slot, or that a stored
    key has it; it is built from (slot, id) pairs alone. The first arrival in a slot without a stored key is new
    (``route='filter'``) and stays where it is. All others are positive and carry their full key to an exact lookup among the keys
    on disk that share their slot (``route='exact'``). There ``mistake`` is ``collision`` for every positive that the
    lookup disproved; otherwise it is null.

    Rows of slots with a single arrival are kept out of the shuffle of full keys, and stored keys whose slot no
    request has out of every shuffle, by bitmaps of ``bits_per_key`` bits a request, broadcast if they have at most
    ``max_broadcast_bytes`` together. Where they would be larger a row must travel to its slot to ask the filter, and its key goes with it:
    open requests and stored keys, repeats of a stretch merged, meet by slot in one shuffle, with the same verdicts.
    """
    own = lambda kind: F.xxhash64(kind, "key")
    rows = requests.select(F.coalesce("request_id", F.lit(_LAST)).cast("long").alias("id"), "kind", "key").where(F.col("key").isNotNull())
    kept = stored.select("key").where(F.col("key").isNotNull())
    fields = [("id", T.LongType()), ("kind", T.StringType()), ("key", T.StringType()), ("settled", T.BooleanType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    swept = rows.mapInArrow(_settle(arrow_schema(schema)), schema).withColumn("hash", F.when(~F.col("settled"), own("kind")))
    swept = materialize(swept, "arrivals")
    n_rows = swept.count()
    slots = 1 << max(1, (slots_per_key * (n_rows + kept.count())).bit_length())
    blocks = max(1, -(-n_rows * bits_per_key // _BITS))
    small = 2 * blocks * _BYTES <= max_broadcast_bytes
    slot = lambda h: F.pmod(h, F.lit(slots)).alias("slot")
    arrivals = swept.where(~F.col("settled")).select("id", "kind", "key", slot(F.col("hash")))
    if small:
        asked = arrivals.where(F.col("kind") == stored_kind).select("slot")
        kept = kept.select("key", slot(own(F.lit(stored_kind))))
        kept = materialize(_marked(kept, asked, blocks).where("hit").select("slot", "key"), "stored")
        pairs = arrivals.select("slot", "id").unionByName(kept.select("slot", F.lit(_STORED).alias("id")))
        busy = pairs.groupBy("slot").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("slot")
        marked = _marked(arrivals, busy, blocks)
        looked, alone, kept = marked.where("hit").drop("hit"), marked.where(~F.col("hit")), kept.distinct()
    else:
        looked, alone, kept = arrivals, None, kept.mapInArrow(_unique, "key string").select("key", slot(own(F.lit(stored_kind))))
    looked = looked.unionByName(kept.select("slot", F.lit(stored_kind).alias("kind"), "key", F.lit(_STORED).alias("id")))
    earliest = lambda *by: F.min("id").over(Window.partitionBy(*by))
    looked = looked.withColumn("first", earliest("slot")).withColumn("same", earliest("slot", "kind", "key")).where(F.col("id") != _STORED)
    positive, seen, none = F.col("first") < F.col("id"), F.col("same") < F.col("id"), F.lit(None).cast("string")
    verdicts = looked.select("id", "kind", seen.alias("seen"), F.when(positive, "exact").otherwise("filter").alias("route"), F.when(positive & ~seen, "collision").alias("mistake"))
    repeated = swept.where("settled").select("id", "kind", F.lit(True).alias("seen"), F.lit("exact").alias("route"), none.alias("mistake"))
    out = repeated.unionByName(verdicts)
    if alone is not None:
        out = out.unionByName(alone.select("id", "kind", F.lit(False).alias("seen"), F.lit("filter").alias("route"), none.alias("mistake")))
    return out.select(F.when(F.col("id") != _LAST, F.col("id")).cast(requests.schema["request_id"].dataType).alias("request_id"), "kind", "seen", "route", "mistake")


def error_rates(verdicts: DataFrame) -> DataFrame:
    """Per kind: requests, the positives, those disproved, the negatives, and the measured rates of wrong answers of the filter.

    ``false_positive_rate`` is collisions among the requests whose key is neither repeated nor stored, ``wrong_rate`` among all.
    """
    of = lambda c: F.count(F.when(c, 1))
    out = verdicts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_requests"), of(F.col("seen")).alias("n_seen"), of(F.col("route") == "exact").alias("n_positive"),
        of(F.col("mistake") == "collision").alias("n_collisions"), of(F.col("route") == "filter").alias("n_negative"),
    )
    new = F.col("n_negative") + F.col("n_collisions")
    return out.withColumns({"false_positive_rate": F.when(new > 0, F.col("n_collisions") / new), "wrong_rate": F.col("n_collisions") / F.col("n_requests")})
