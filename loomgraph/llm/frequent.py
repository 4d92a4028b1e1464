"""The most frequent values among billions: identified by a code, then counted exactly.

Values are hashed to groups. Inside a group the 64 bits of a value are written as 16 symbols of 4 bits plus 8 parity
symbols (two Reed-Solomon codewords of length 12 over GF(16)), and a counter is kept for every symbol at every
position. A frequent value dominates its symbols, so it can be read off the counters; the code repairs the
positions where other values of the group are louder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.storage import materialize, release

DATA, CODE, WORDS = 8, 12, 2
POSITIONS = CODE * WORDS
_CELLS = POSITIONS * 16


def _field() -> np.ndarray:
    """Products in GF(16) with the polynomial x^4 + x + 1."""
    def mul(a: int, b: int) -> int:
        out = 0
        for i in range(4):
            if b >> i & 1:
                out ^= a << i
        for i in (6, 5, 4):
            if out >> i & 1:
                out ^= 0b10011 << (i - 4)
        return out

    return np.array([[mul(a, b) for b in range(16)] for a in range(16)], np.uint8)


MUL = _field()
INVERSE = np.array([0, *[int(np.flatnonzero(MUL[a] == 1)[0]) for a in range(1, 16)]], np.uint8)


def _power(a: int, n: int) -> int:
    out = 1
    for _ in range(n):
        out = int(MUL[out][a])
    return out


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gauss-Jordan over GF(16); the matrices here are never singular."""
    m = np.concatenate([matrix, right], axis=1).astype(np.uint8)
    n = len(matrix)
    for i in range(n):
        p = i + int(np.flatnonzero(m[i:, i])[0])
        m[[i, p]] = m[[p, i]]
        m[i] = MUL[INVERSE[m[i, i]]][m[i]]
        for j in range(n):
            if j != i and m[j, i]:
                m[j] ^= MUL[m[j, i]][m[i]]
    return m[:, n:]


#: Row i holds the powers of the i-th point: symbol i of a codeword is the message polynomial there. Made systematic.
_POINTS = np.array([[_power(x, k) for k in range(DATA)] for x in range(1, CODE + 1)], np.uint8)
GENERATOR = np.zeros((CODE, DATA), np.uint8)
_BASE = _solve(_POINTS[:DATA], np.eye(DATA, dtype=np.uint8))
for _r in range(CODE):
    for _c in range(DATA):
        for _k in range(DATA):
            GENERATOR[_r, _c] ^= MUL[_POINTS[_r, _k]][_BASE[_k, _c]]


def _encode_word(data: np.ndarray) -> np.ndarray:
    """(n, 8) symbols to (n, 12)."""
    out = np.zeros((len(data), CODE), np.uint8)
    out[:, :DATA] = data
    for r in range(DATA, CODE):
        for c in range(DATA):
            out[:, r] ^= MUL[GENERATOR[r, c]][data[:, c]]
    return out


def encode(values: np.ndarray) -> np.ndarray:
    """int64 values to (n, 24) symbols."""
    v = values.astype(np.int64).view(np.uint64)
    nibbles = np.stack([(v >> np.uint64(4 * i)).astype(np.uint8) & 15 for i in range(16)], axis=1)
    return np.concatenate([_encode_word(nibbles[:, :DATA]), _encode_word(nibbles[:, DATA:])], axis=1)


def _decode_word(counts: np.ndarray) -> np.ndarray | None:
    """The codeword that agrees with most of the 12 loudest symbols, if it agrees with at least 10 of them."""
    loud = counts.argmax(axis=1)
    two = np.sort(counts, axis=1)[:, -2:]
    trust = np.argsort(-(two[:, 1] - two[:, 0]), kind="stable")
    for skip in range(3):  # the eight most trusted symbols, then others in place of one or two of them
        for out in combinations(range(DATA), skip):
            use = [p for k, p in enumerate(trust) if k not in out][:DATA]
            word = _encode_word(_solve(GENERATOR[use], loud[use][:, None].astype(np.uint8)).T)[0]
            if (word == loud).sum() >= CODE - 2:  # as close as this, there is only one codeword
                return word
    return None


def decode(counts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``(value, estimate)`` for values of one group with about ``least`` rows or more, loudest first.

    ``counts`` is (24, 16). A decoded value is subtracted and the rest decoded again.
    """
    counts, out = counts.copy(), []
    while counts.max(axis=1).min() >= least and len(out) < 64:
        words = [_decode_word(counts[w * CODE : (w + 1) * CODE]) for w in range(WORDS)]
        if any(w is None for w in words):
            break
        word = np.concatenate(words)
        nibbles = np.concatenate([words[0][:DATA], words[1][:DATA]])
        value = int(np.array([sum(int(x) << (4 * i) for i, x in enumerate(nibbles))], np.uint64).view(np.int64)[0])
        mine = counts[np.arange(POSITIONS), word]
        estimate = int(np.median(mine))
        if estimate < least // 2 or any(v == value for v, _ in out):
            break
        out.append((value, estimate))
        counts[np.arange(POSITIONS), word] = np.maximum(0, mine - estimate)
    return out


def _group(hashes: np.ndarray, rep: int, groups: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> np.uint64(24 * rep)) & np.uint64(groups - 1)).astype(np.int64)


def _sketch(columns: int, reps: int, groups: int):
    """One counter table per task, column and repetition, sent as one block of 64 groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((columns, reps, groups * _CELLS), np.int64)
        held: list[list] = [[] for _ in range(columns)]

        def fold(c: int) -> None:
            values, hashes = (np.concatenate([h[i] for h in held[c]]) for i in (0, 1))
            values, first, n = np.unique(values, return_index=True, return_counts=True)
            hashes = hashes[first]
            cells = encode(values).astype(np.int64) + np.arange(POSITIONS) * 16
            for r in range(reps):
                at = (_group(hashes, r, groups) * _CELLS)[:, None] + cells
                tables[c, r] += np.bincount(at.ravel(), np.repeat(n, POSITIONS), groups * _CELLS).astype(np.int64)
            held[c] = []

        size = 0
        for b in batches:
            for c in range(columns):
                v, h = b.column(f"v{c}"), b.column(f"h{c}").drop_null()
                v = v.drop_null().to_numpy(zero_copy_only=False)
                h = h.to_numpy(zero_copy_only=False)
                held[c].append((v, h))
            size += b.num_rows
            if size >= 1 << 17:
                for c in range(columns):
                    fold(c)
                size = 0
        if size:
            for c in range(columns):
                fold(c)
        span = min(groups, 64)
        for c in range(columns):
            for r in range(reps):
                for k in range(0, groups, span):
                    part = tables[c, r, k * _CELLS : (k + span) * _CELLS]
                    if part.any():
                        yield pa.RecordBatch.from_pydict({"col": pa.array([c], pa.int32()), "rep": pa.array([r], pa.int32()), "first": pa.array([k], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    return run


def _add_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the blocks of all tasks; one block is in memory at a time."""
    total = None
    for b in batches:
        for x in b.column("counts"):
            part = np.frombuffer(x.as_buffer(), np.int64)
            total = part.copy() if total is None else total + part
    c, r, k = (s.as_py() for s in key)
    yield pa.RecordBatch.from_pydict({"col": pa.array([c], pa.int32()), "rep": pa.array([r], pa.int32()), "first": pa.array([k], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _each_group(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for row in b.to_pylist():
            counts = np.frombuffer(row["counts"], np.int64).reshape(-1, POSITIONS, 16)
            for i, table in enumerate(counts):
                yield row["col"], row["rep"], row["first"] + i, table


def _candidates(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _, _, table in _each_group(batches):
            found = decode(table, least[c])
            if found:
                yield pa.RecordBatch.from_pydict({"col": pa.array([c] * len(found), pa.int32()), "v": pa.array([f[0] for f in found], pa.int64()), "estimate": pa.array([f[1] for f in found], pa.int64())})

    return run


def _unresolved(least: list[int], known: dict[tuple[int, int, int], list[tuple[int, int]]]):
    """Groups of the first repetition that could still hide a frequent value once the known counts are taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, r, g, table in _each_group(batches):
            if r:
                continue
            table = table.copy()
            for value, n in known.get((c, r, g), []):
                table[np.arange(POSITIONS), encode(np.array([value]))[0]] -= n
            if table.max(axis=1).min() >= least[c]:
                yield pa.RecordBatch.from_pydict({"col": pa.array([c], pa.int32()), "g": pa.array([g], pa.int32())})

    return run


def frequent_values(df: DataFrame, columns: list[str], permille: int, repetitions: int = 2) -> DataFrame:
    """``(ref_column, value, approx_count, n, n_column)``: values that fill at least ``permille``/1000 of a column.

    Columns are integral; the share is of a column's non-null rows and all rows count. ``approx_count`` is read off the
    counters, ``n`` is the exact count. Ties at the threshold all come out; an empty or all-null column gives no rows.

    A task keeps counters for the power of two above 4000/``permille`` groups, whatever the data's size: 6 KB a group and
    column. Decoded candidates, fewer than a fixed number per group, are counted exactly. What they account for is then
    subtracted: any group whose counters could still hold a frequent value sends its rows through further passes
    with other hashes, until no such group is left, so no frequent value is missed and none is capped away.
    """
    if permille <= 0:
        raise ValueError("permille must be positive")
    spark, groups = df.sparkSession, 64
    while groups < 4000 / permille:
        groups *= 2
    if groups > 1 << 16:
        raise ValueError("a share this small needs more counters than a task should hold")
    totals = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    totals = [totals[f"n{i}"] for i in range(len(columns))]
    least = [max(1, -(-n * permille // 1000)) for n in totals]
    estimates: dict[tuple[int, int], int] = {}
    exact: dict[tuple[int, int], int] = {}
    wanted: list[set[int]] | None = None
    rows = df.select(*[F.col(c).cast("long").alias(f"v{i}") for i, c in enumerate(columns)])
    unpivot = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"v{i}").alias("v")) for i in range(len(columns))])).alias("x")).select("x.col", "x.v").where(F.col("v").isNotNull())
    block = T.StructType([T.StructField("col", T.IntegerType()), T.StructField("rep", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    seed = 0
    while any(totals):
        hashed = rows
        for i in range(len(columns)):
            hashed = hashed.withColumn(f"h{i}", F.when(F.col(f"v{i}").isNotNull(), F.xxhash64(f"v{i}", F.lit(seed))))
        if wanted is not None:
            # rows of the unresolved groups of the pass before, found by that pass's hash
            for i in range(len(columns)):
                group = F.xxhash64(f"v{i}", F.lit(seed - 1)).bitwiseAND(groups - 1)
                keep = group.isin(sorted(wanted[i])) if wanted[i] else F.lit(False)
                hashed = hashed.withColumns({f"h{i}": F.when(keep, F.col(f"h{i}")), f"v{i}": F.when(keep, F.col(f"v{i}"))})
        blocks = hashed.mapInArrow(_sketch(len(columns), repetitions, groups), block).groupBy("col", "rep", "first").applyInArrow(_add_blocks, block)
        blocks = materialize(blocks, "sketch")
        fresh = blocks.mapInArrow(_candidates(least), "col int, v long, estimate long").groupBy("col", "v").agg(F.min("estimate").alias("estimate"))
        fresh = {(r["col"], r["v"]): r["estimate"] for r in fresh.collect() if (r["col"], r["v"]) not in exact}
        if fresh:
            asked = spark.createDataFrame([(c, v) for c, v in fresh], "col int, v long")
            counted = unpivot.join(F.broadcast(asked), ["col", "v"]).groupBy("col", "v").agg(F.count(F.lit(1)).alias("n")).collect()
            exact |= {k: 0 for k in fresh} | {(r["col"], r["v"]): r["n"] for r in counted}
            estimates |= fresh
        known: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        if exact:
            at = spark.createDataFrame([(c, v) for c, v in exact], "col int, v long").select("col", "v", F.xxhash64("v", F.lit(seed)).alias("h"), F.xxhash64("v", F.lit(seed - 1)).bitwiseAND(groups - 1).alias("before"))
            for r in at.collect():
                if wanted is None or r["before"] in wanted[r["col"]]:
                    g = int(_group(np.array([r["h"]], np.int64), 0, groups)[0])
                    known.setdefault((r["col"], 0, g), []).append((r["v"], exact[r["col"], r["v"]]))
        left = blocks.mapInArrow(_unresolved(least, known), "col int, g int").collect()
        release(spark, blocks)
        if not left:
            break
        if seed >= 16:
            raise RuntimeError("some groups could not be resolved")
        wanted = [{r["g"] for r in left if r["col"] == i} for i in range(len(columns))]
        seed += 1
    out = [(columns[c], v, estimates[c, v], n, totals[c]) for (c, v), n in exact.items() if n * 1000 >= permille * totals[c]]
    return spark.createDataFrame(out, "ref_column string, value long, approx_count long, n long, n_column long")
