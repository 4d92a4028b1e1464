"""Skewed totals, change feeds and orphan references against brute force on small, awkward tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from loomgraph.operators.accumulate import key_totals
from loomgraph.operators.changes import apply_changes
from loomgraph.operators.orphans import ForeignKey, cascade, dangling
from loomgraph.operators.sweep import running_totals


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_key_totals_hot_key_nulls_and_repeats(spark, kind):
    rng = random.Random(3)
    data = [(7 if rng.random() < 0.4 else rng.choice([None, *range(20)]), rng.choice([None, *range(50)])) for _ in range(3000)]
    df = spark.createDataFrame([(k, i, "x") for k, i in data], "k long, item long, n_rows string")
    df = df.withColumn("k", df.k.cast(kind))
    want = {}
    for k, i in data:
        if k is not None:
            n, s = want.setdefault(k, [0, set()])
            want[k][0] += 1
            s.add(i)
    want = sorted(((k if kind == "long" else str(k), n, len(s - {None})) for k, (n, s) in want.items()), key=str)
    assert rows(key_totals(df, "k", "item")) == want
    assert rows(key_totals(df.limit(0), "k", "item")) == []


@pytest.mark.parametrize("key", ["k", None])
def test_running_totals_cross_partitions(spark, key):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(40), i, rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, o int, id long, v long").repartition(5)
    got = {r["id"]: r["run_v"] for r in running_totals(df, key, ["o", "id"], ["v"]).collect()}
    sums, want = {}, {}
    for k, o, i, v in sorted(data, key=lambda r: (r[0] if key else "", r[1], r[2])):
        k = k if key else ""
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert got == want
    assert running_totals(df.limit(0), key, ["o", "id"], ["v"]).collect() == []


FEED = "delta_id long, src long, dst long, ts long, op int, since long, extra string"


def feed(spark, *changes):
    return spark.createDataFrame([(*c, "x") for c in changes], FEED)


@pytest.mark.parametrize(
    "changes, want",
    [
        ([(1, 0, 4, 1, 0, None), (2, 0, 5, 2, 0, None)], {1, 2, 3, 4, 5}),
        ([(1, 0, 2, 1, 1, None), (2, 0, 1, 2, 1, None)], {3}),
        ([(1, 0, 2, 1, 1, None), (2, 0, 4, 2, 0, None), (3, 0, 2, 3, 0, None)], {1, 2, 3, 4}),
        ([(1, 0, 4, 1, 0, None), (2, 0, 4, 2, 1, None), (3, 0, 4, 3, 0, None)], {1, 2, 3, 4}),
        ([], {1, 2, 3}),
        ([(9, 0, 7, 5, 1, None), (8, 0, 7, 5, 0, None)], {1, 2, 3, 7}),  # a tie: the smaller id decides
        ([(1, 0, 3, 9, 2, None), (2, 0, None, 9, 0, None), (3, 0, 3, None, 1, None), (4, 0, 3, 9, None, None)], {1, 2, 3}),
        ([(1, 0, 9, 5, 1, None), (2, 0, 9, 4, 0, None)], {1, 2, 3}),  # out of order, and a removal of what is absent
    ],
)
def test_overlay(spark, changes, want):
    base = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (0, 3), (None, 1), (0, None)], "src long, dst long")
    out = apply_changes(base, feed(spark, *changes)).collect()
    assert {r["dst"] for r in out} == want and len(out) == len(want)


def test_update_replaces_the_image(spark):
    base = spark.createDataFrame([(0, 1)], "src long, dst long")
    out = apply_changes(base, feed(spark, (5, 0, 1, 10, 0, 1999), (6, 0, 1, 20, 0, 2001), (6, 0, 1, 20, 0, 2001)))
    assert [tuple(r) for r in out.select("src", "dst", "delta_id", "since", "ts").collect()] == [(0, 1, 6, 2001, 20)]


def test_random_feed_against_replay(spark):
    rng = random.Random(11)
    base = {(rng.randrange(6), rng.randrange(6)) for _ in range(12)}
    changes = [(i, rng.randrange(6), rng.randrange(6), rng.randrange(30), rng.randrange(2), rng.choice([None, i])) for i in range(300)]
    state = {e: None for e in base}
    for d, s, t, ts, op, _ in sorted(changes, key=lambda c: (c[3], -c[0])):
        state.pop((s, t), None)
        if op == 0:
            state[s, t] = d
    out = apply_changes(spark.createDataFrame(list(base), "src long, dst long"), feed(spark, *changes)).collect()
    assert {(r["src"], r["dst"]): r["delta_id"] for r in out} == state and len(out) == len(state)


DAY = datetime(2024, 1, 1)


def test_dangling_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda: DAY + timedelta(days=rng.randrange(90))
    parents = [(rng.choice([None, 3, 3, *range(12)]), rng.choice([None, day(), day(), day()]), rng.choice([None, day()])) for _ in range(60)]
    parents += parents[:10]
    children = [(i, rng.choice([None, 3, 3, 3, *range(16)]), rng.choice([None, *range(16)]), rng.choice([None, *[day() for _ in range(9)]])) for i in range(800)]
    want = []
    for i, a, b, t in children:
        for name, v in (("a", a), ("b", b)):
            mine = [(s, e) for k, s, e in parents if k == v]
            if v is None or any(t and s and s <= t and (e is None or e > t) for s, e in mine):
                continue
            why = "missing" if not mine else "late" if not any(t and s and s <= t for s, _ in mine) else "deleted"
            want.append((i, name, why, t and t.strftime("%Y-%m")))
    c = spark.createDataFrame(children, "id long, a long, b long, t timestamp").withColumnRenamed("t", "n")
    p = spark.createDataFrame(parents, "v long, t timestamp, id timestamp")
    assert rows(dangling(c, "id", ["a", "b"], "n", p, "v", "t", "id")) == sorted(want, key=str)
    assert dangling(c.limit(0), "id", ["a", "b"], "n", p, "v", "t", "id").collect() == []
    none = dangling(c, "id", ["a", "b"], "n", p.limit(0), "v", "t", "id")
    assert {r["reason"] for r in none.collect()} == {"missing"}


def test_cascade_levels_and_cycles(spark):
    nodes = spark.createDataFrame([(1, 99), (2, 1), (3, 2), (4, 4), (5, None), (6, 5), (7, 8), (8, 7)], "id long, up long")
    leaves = spark.createDataFrame([(10, 3), (11, 6), (12, 77)], "leaf long, node long")
    keys = [ForeignKey("nodes", ("up",), "nodes", ("id",)), ForeignKey("leaves", ("node",), "nodes", ("id",))]
    found = cascade({"nodes": nodes, "leaves": leaves}, {"nodes": "id", "leaves": "leaf"}, keys)
    assert sorted((r["id"], r["reason"], r["level"]) for r in found["nodes"].collect()) == [(1, "missing", 0), (2, "inherited", 1), (3, "inherited", 2)]
    assert sorted((r["leaf"], r["reason"], r["level"]) for r in found["leaves"].collect()) == [(10, "inherited", 3), (12, "missing", 0)]


@pytest.mark.parametrize("small_rows", [100, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_of_a_hot_key(spark, small_rows, how):
    """Broadcast and salted: the same rows, hot, repeated, unknown and null keys included."""
    from loomgraph.operators.skew import lookup

    rows = [(None if i % 11 == 0 else 7 if i % 3 else i % 20, i // 2, "x") for i in range(300)]
    table = {7: "seven", 3: "three", 18: None}
    df = spark.createDataFrame(rows, "k long, v long, _s string")
    got = lookup(df, spark.createDataFrame(list(table.items()), "k long, name string"), "k", how, small_rows=small_rows)
    want = [(k, v, s, table.get(k)) for k, v, s in rows if how == "left" or k in table]
    assert got.columns == ["k", "v", "_s", "name"] and Counter(map(tuple, got.collect())) == Counter(want)
    counted = spark.createDataFrame([(k, sum(r[0] == k for r in rows)) for k in table], "k long, n long")
    assert lookup(df, counted, "k", how, small_rows=small_rows, counts="n", hot_rows=20).where("n > 0").count() == sum(k in table for k, _, _ in rows)
    assert lookup(df.limit(0), got.select("k", "name").limit(0), "k", how, small_rows=small_rows).collect() == []
