"""Training-data operators against brute force, exact round trips and awkward rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm.frequent import decode, encode, frequent_values
from loomgraph.llm.groups import connected_groups, same_rows, union
from loomgraph.llm.mixing import mixture
from loomgraph.llm.packing import container_report, fill_containers, pack
from loomgraph.llm.seen import error_rates, seen_before
from loomgraph.llm.splitting import split_texts


@pytest.mark.parametrize("limit", [64 << 20, 1])
def test_seen_against_replay(spark, limit):
    """With filters that are broadcast, and with filters joined by block: the same answers."""
    rng = random.Random(4)
    keys = [None, "", "hot", "a", "A", "a ", *[f"k{i}" for i in range(1500)]]
    data = [(i, rng.choice(["vertex", "edge"]), "hot" if rng.random() < 0.4 else rng.choice(keys)) for i in range(3000)]
    kept = {f"k{i}" for i in range(0, 1500, 7)}
    want, past = {}, set()
    for i, kind, key in data:
        if key is not None:
            want[i] = (kind, key) in past or (kind == "edge" and key in kept)
            past.add((kind, key))
    rows = spark.createDataFrame([(*r, "x") for r in data], "request_id long, kind string, key string, seen string").repartition(3)
    stored = spark.createDataFrame([(k,) for k in [*kept, *kept]] + [(None,)], "key string")
    out = seen_before(rows, stored, max_broadcast_bytes=limit)
    got = out.collect()
    assert {r["request_id"]: r["seen"] for r in got} == want and len(got) == len(want)
    assert all(r["route"] == "exact" for r in got if r["seen"])
    assert all((r["mistake"] is not None) == (r["route"] == "exact" and not r["seen"]) for r in got)
    assert sum(r["route"] == "filter" for r in got) > 0
    rates = {r["kind"]: r for r in error_rates(out).collect()}
    assert sum(r["n_requests"] for r in rates.values()) == len(want)
    assert seen_before(rows.limit(0), stored.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_seen_awkward_rows(spark, limit):
    """Null kinds are a kind of their own, null ids come last, an id and key that come twice are one arrival, keys may be very long."""
    long = "x" * 100_000
    rows = [(1, None, "a"), (2, None, "a"), (3, "vertex", "a"), (None, "vertex", "a"), (None, "vertex", "b"), (5, "edge", "c"), (5, "edge", "c"), (6, "edge", "c"), (7, "edge", long), (8, "edge", long), (9, "edge", ""), (10, "edge", None), (11, "vertex", "s"), (12, "edge", "s")]
    df = spark.createDataFrame(rows, "request_id long, kind string, key string").repartition(2)
    got = [(r["request_id"], r["kind"], r["seen"]) for r in seen_before(df, spark.createDataFrame([("s",), ("s",), (None,)], "key string"), max_broadcast_bytes=limit).collect()]
    want = [(1, None, False), (2, None, True), (3, "vertex", False), (None, "vertex", True), (None, "vertex", False), (5, "edge", False), (5, "edge", False), (6, "edge", True), (7, "edge", False), (8, "edge", True), (9, "edge", False), (11, "vertex", False), (12, "edge", True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def groups_of(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in parent}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), min_size=1))
def test_local_union(pairs):
    ids, rep = union(*map(np.array, zip(*pairs)))
    assert dict(zip(ids.tolist(), rep.tolist())) == groups_of(pairs)


@pytest.mark.parametrize("cell", [1 << 19, 20])
def test_groups_on_one_cell_and_on_a_grid(spark, cell):
    rng = random.Random(8)
    chain = list(zip(range(100, 260), range(101, 261)))
    star = [(999, i) for i in range(500, 700)]
    pairs = chain + star + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, None), (None, 6), (77, 77), (101, 100), (101, 100), (-3, 2**40)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "g") for a, b in pairs], "a long, b long, group_id string")
    got = connected_groups(df, "a", "b", edges_per_cell=cell).collect()
    assert {r["vertex"]: r["group_id"] for r in got} == groups_of(pairs) and len(got) == len(groups_of(pairs))


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, " same_AS "), (2, 3, "not_same_as"), (4, 5, None)], "a long, b long, label string")
    assert same_rows(df).count() == 1
    assert connected_groups(same_rows(df), "a", "b").collect() == []


def test_code_repairs_loud_positions():
    rng = np.random.default_rng(1)
    for _ in range(50):
        value = rng.integers(-(2**62), 2**62, 1)
        word = encode(value)[0]
        counts = rng.integers(0, 20, (24, 16))
        counts[np.arange(24), word] += 100
        for p in rng.choice(12, 2, False):  # two positions of a codeword where another symbol is louder
            counts[p, (word[p] + 3) % 16] += 400
        assert (int(value[0]) in [v for v, _ in decode(counts, 90)])


def test_code_separates_two_frequent_values():
    a, b = encode(np.array([12345]))[0], encode(np.array([-7]))[0]
    counts = np.zeros((24, 16), np.int64)
    counts[np.arange(24), a] += 1000
    counts[np.arange(24), b] += 600
    assert {v for v, _ in decode(counts, 500)} == {12345, -7}


@pytest.mark.parametrize("permille", [5, 60])
def test_frequent_against_counts(spark, permille):
    rng = random.Random(6)
    a = [7 if rng.random() < 0.35 else rng.choice([None, -(2**50), *range(400)]) for _ in range(6000)]
    b = [int(rng.paretovariate(0.8)) % 5000 for _ in range(6000)]
    df = spark.createDataFrame([(x, y, "n") for x, y in zip(a, b)], "a long, b long, n string")
    want = set()
    for name, values in (("a", a), ("b", b)):
        known = [v for v in values if v is not None]
        want |= {(name, v, known.count(v)) for v in set(known) if known.count(v) * 1000 >= permille * len(known)}
    got = frequent_values(df, ["a", "b"], permille).collect()
    assert {(r["ref_column"], r["value"], r["n"]) for r in got} == want and len(got) == len(want)
    assert all(r["approx_count"] > 0 for r in got)


def test_frequent_ties_empty_and_null_columns(spark):
    df = spark.createDataFrame([(i % 4, None) for i in range(400)], "a long, b long")
    assert {(r["ref_column"], r["value"]) for r in frequent_values(df, ["a", "b"], 250).collect()} == {("a", i) for i in range(4)}
    assert frequent_values(df.limit(0), ["a", "b"], 250).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=120))
def test_pack_keeps_every_item_within_capacity(sizes):
    sizes = np.array(sizes, np.int64)
    box = pack(sizes, 1000)
    assert len(box) == len(sizes) and (box >= 0).all()
    if len(sizes):
        assert np.bincount(box, sizes).max() <= 1000
        assert len(np.unique(box)) <= 2 * -(-int(sizes.sum()) // 1000) + 1


def test_containers(spark):
    rng = random.Random(9)
    texts = ["", "x" * 1000, "é" * 1700, None, *["w" * int(rng.lognormvariate(5, 0.7) % 900 + 1) for _ in range(500)]]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "null id", 5), (3, "again", 5)], "doc_id long, text string, tokens int").repartition(2)
    rows = fill_containers(docs, 1000).collect()
    load, mine = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
        mine.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["tokens"], r["n_pieces"]))
    assert max(load.values()) <= 1000
    assert sorted(mine[2]) == [(0, 0, 1000, 4), (1, 1000, 1000, 4), (2, 2000, 1000, 4), (3, 3000, 400, 4)]
    assert mine[0] == [(0, 0, 0, 1)] and mine[1] == [(0, 0, 1000, 1)] and len(mine[3]) == 2 and mine[None] == [(0, 0, 7, 1)]
    report = container_report(fill_containers(docs, 1000), 1000).first()
    assert report["used_share"] > 0.9 and report["n_documents"] == 506
    assert fill_containers(docs.limit(0), 1000).collect() == []


def test_mixture_shares_and_caps(spark):
    rng = random.Random(10)
    docs = [(i, rng.choice(["a", " A", "b", "b", "b", None, "other"]) if i % 3 else "a", "t" * rng.randrange(0, 200)) for i in range(1500)] + [(5000, "c", "t" * 50), (5001, "c", "t" * 30)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, copy int").repartition(3)
    goals = spark.createDataFrame([("A ", 0.3, 3), ("b", 0.5, 2), ("c", 0.15, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixture(df, goals)
    rows, budget = mixed.collect(), sum(len(t) for _, _, t in docs)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert all(r["copy"] < {"a": 3, "b": 2, "c": 4}[r["source"]] for r in rows)
    own = {}
    for _, s, t in docs:
        own[s and s.strip().lower()] = own.get(s and s.strip().lower(), 0) + len(t)
    report = {r["source"]: r for r in shares.collect()}
    short = {s for s, w, m in (("a", 0.3, 3), ("b", 0.5, 2), ("c", 0.15, 4), ("none", 0.05, 2)) if m * own.get(s, 0) < w * budget}
    assert {s for s, r in report.items() if r["used_up"]} == short and {"c", "none"} <= short
    used = sum(r["tokens"] for r in rows)
    assert budget - 400 <= used <= budget or all(report[s]["used_tokens"] == report[s]["max_repeats"] * own.get(s, 0) for s in report)
    small, few = mixture(df, goals.where("target_share >= 0.3").withColumn("target_share", goals.target_share / 0.8), budget=20000)
    got = {r["source"]: r["reached_share"] for r in few.collect()}
    assert abs(got["a"] - 0.375) < 0.02 and abs(got["b"] - 0.625) < 0.02
    assert mixture(df.limit(0), goals)[0].collect() == [] and len(mixture(df.limit(0), goals)[1].collect()) == 4


TEXTS = [
    "", "short", "word " * 400, "x" * 3000, "。".join(["漢字かな"] * 300), "é" * 900, "a\r\n\r\nb " * 300, "😀" * 500,
    "".join(f"\n{i}. The device of claim {i - 1}, wherein the part is {'very ' * (i % 9)}small." for i in range(2, 60)), " ".join(["line of text"] * 200), "\n" * 2000, "a\x00b " * 500,
]


@pytest.mark.parametrize("limit, overlap", [(200, 30), (200, 0), (64, 50), (16, 5)])
def test_pieces_round_trip(spark, limit, overlap):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "n " * 300, 0), (77, None, 0)], "doc_id long, text string, piece int")
    rows = {}
    for r in split_texts(docs, limit, overlap).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert set(rows) == {*range(len(TEXTS)), None}
    for i, text in [*enumerate(TEXTS), (None, "n " * 300)]:
        data, pieces = text.encode(), sorted(rows[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and all(p["n_pieces"] == len(pieces) for p in pieces)
        assert (len(pieces) > 1) == (len(data) > limit)
        joined = b""
        for p in pieces:
            assert p["tokens"] == len(p["text"].encode()) <= limit
            assert data[p["start"] : p["start"] + p["tokens"]] == p["text"].encode()
            assert p["piece"] == 0 and p["overlap"] == 0 or min(overlap, len(joined)) <= p["overlap"] <= overlap + 3 * bool(overlap)
            joined += p["text"].encode()[p["overlap"] :]
        assert joined == data


def test_pieces_end_at_natural_places(spark):
    text = "".join(f"[{i:04d}] Some sentence here. Another one, with a clause; and more text follows it.\n" for i in range(80))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = [r["text"] for r in split_texts(docs, 500, 40).orderBy("piece").collect()]
    assert all(p.endswith("\n") for p in pieces) and len(pieces) > 10


def test_pieces_of_one_very_long_text(spark):
    docs = spark.createDataFrame([(1, "no break" * 200_000)], "doc_id long, text string")
    rows = split_texts(docs, 4096, 256).collect()
    assert sum(r["tokens"] - r["overlap"] for r in rows) == 1_600_000
