"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import Sizer, byte_tokens
from loomgraph.operators.sweep import running_totals
from loomgraph.storage import materialize


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def _virtual_end(budget: float, queues: list[tuple[float, float]]) -> float:
    """The virtual time at which queues of (weight, tokens in all) have served ``budget`` tokens; infinite if they can't."""
    served, now = 0.0, 0.0
    for end, weight, _ in sorted((cap / w, w, cap) for w, cap in queues):
        rate = sum(w for w, cap in queues if cap / w >= end)
        if served + rate * (end - now) >= budget:
            return now + (budget - served) / rate
        served, now = served + rate * (end - now), end
    return float("inf")


def mixture(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, doc_id: str = "doc_id", size: Sizer = byte_tokens) -> tuple[DataFrame, DataFrame]:
    """``(mixture, shares)``.

    ``mixture`` has ``(doc_id, source, copy, tokens, finish)``: the documents in the order of their virtual finish times, cut
    where ``budget`` tokens (by default those of all documents) are full. A document's copy finishes when its source has
    served everything before it, cumulative tokens divided by the target share; documents are shuffled by a seeded
    hash of their id. ``copy`` counts from 0 and stays below ``max_repeats``.

    ``shares`` has one row per target: ``(source, target_share, max_repeats, n_documents, own_tokens, used_tokens, reached_share,
    used_up)``, ``used_up`` if all permitted copies were used before the source had its share of the budget.

    Sources compare without outer spaces and in lower case. A null source and a source without a target count only in the
    total; a target without documents reaches 0. Null shares or repeats count as 0. Null and empty texts have no tokens.
    ``doc_id`` should be unique; equal ids tie by size. Empty tables give no mixture.

    Cumulative tokens come from range-sorted sweeps, so a source with most documents is spread over all tasks; the
    driver sees one row per target. ``targets`` is a configuration table; only Catalyst's size check may broadcast it.
    """
    sized = docs.select(F.col(doc_id).alias("id"), source_key(F.col("source")).alias("source"), size(F.col("text")).alias("tokens"))
    sized = materialize(sized, "sizes")
    goals = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats")).where(F.col("source").isNotNull())
    own = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("own_tokens"))
    if budget is None:
        budget = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    plan = goals.join(own, "source", "left").na.fill(0, ["n_documents", "own_tokens"])
    rows = plan.collect()
    queues = [(r["target_share"], float(r["own_tokens"] * r["max_repeats"])) for r in rows if r["target_share"] > 0 and r["own_tokens"] * r["max_repeats"] > 0]
    # rounding to whole documents may hold back at most one of them per source
    largest = sized.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("n")).first()["n"]
    last = _virtual_end(budget + largest * (len(queues) + 1), queues) if queues else 0.0
    live = plan.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("n_documents") > 0))
    queued = sized.join(live, "source").withColumn("shuffled", F.xxhash64("id", F.lit(seed)))
    queued = running_totals(queued, "source", ["shuffled", "id", "tokens"], ["tokens"])
    needed = F.lit(1 << 40) if last == float("inf") else F.floor((F.lit(last) * F.col("target_share") - F.col("run_tokens")) / F.greatest(F.col("own_tokens"), F.lit(1))) + 1
    copies = F.least(F.col("max_repeats"), F.greatest(needed.cast("long"), F.lit(0)))
    queued = queued.withColumn("copies", copies).where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    queued = queued.select("id", "source", "copy", "tokens", ((F.col("copy") * F.col("own_tokens") + F.col("run_tokens")) / F.col("target_share")).alias("finish"))
    total = running_totals(queued, None, ["finish", "source", "copy", "id"], ["tokens"])
    mixed = total.where(F.col("run_tokens") <= budget).select(F.col("id").alias(doc_id), "source", "copy", "tokens", "finish")
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_used"))
    shares = plan.join(used, "source", "left").na.fill(0, ["used_tokens", "n_used"])
    all_used = F.col("n_used") == F.col("n_documents") * F.col("max_repeats")
    reached = F.when(F.lit(budget) > 0, F.col("used_tokens") / F.lit(budget))
    return mixed, shares.select(
        "source", "target_share", "max_repeats", "n_documents", "own_tokens", "used_tokens", reached.alias("reached_share"),
        ((all_used | (F.col("target_share") <= 0)) & (F.col("used_tokens") < F.col("target_share") * F.lit(budget))).alias("used_up"),
    )
