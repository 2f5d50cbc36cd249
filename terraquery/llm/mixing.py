"""Mixtures of sources with target shares, by weighted fair queueing.

The documents of a source are shuffled by a hash of their ids and queue up, source by
source and repetition by repetition.  The virtual finish time of a document is the
number of its source's tokens up to and including it, divided by the source's target.
All sources are served in the order of virtual time until the total budget is reached.
A source that has used up its repetitions drops out; the others share what it leaves in
proportion to their targets, which is as near to the targets as the limits allow.

Running sums are taken in two steps, over hash buckets and inside them, so no source,
however large, is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents aimed at in a hash bucket of a source.
BUCKET_DOCS = 4000
#: A target list is a configuration; it must not be longer.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Plan:
    budget: int
    level: float  # virtual time at which the budget is used up
    rows: list[tuple]  # source, target, max_repeats, documents, tokens


def one_row_each(targets: DataFrame) -> DataFrame:
    """Targets with a row for each source: shares of repeated rows add up, the most repeats hold."""
    return targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan(items: DataFrame, targets: DataFrame, budget: int | None = None) -> Plan:
    """Total tokens per target source, the budget and its virtual time.

    The budget is by default the size of all documents of the target sources, once each.
    It is lowered to what the repetitions can supply.
    """
    totals = items.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    rows = one_row_each(targets).join(totals, "source").select("source", "target_share", "max_repeats", "documents", "tokens").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    known = [tuple(r) for r in rows if r["target_share"] and r["target_share"] > 0 and r["max_repeats"] and r["max_repeats"] > 0]
    supply = sum(r[2] * r[4] for r in known)
    budget = min(sum(r[4] for r in known) if budget is None else budget, supply)
    # serve until the sources that run out, run out; then share the rest among the others
    level, left, active = 0.0, float(budget), sorted(known, key=lambda r: r[2] * r[4] / r[1])
    for i, r in enumerate(active):
        weight = sum(x[1] for x in active[i:])
        step = min(left / weight, r[2] * r[4] / r[1] - level)
        level += step
        left -= step * weight
        if left <= 1e-9:
            break
    return Plan(budget, level, known)


def mixture(items: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1) -> DataFrame:
    """``doc_id, source, copy, tokens, finish`` of the drawn documents, sorted by virtual finish time.

    ``items`` has ``doc_id, source, tokens``; documents without tokens and documents of
    sources without a target are never drawn.  ``copy`` counts from 1.  Documents are
    drawn whole, so the mixture ends at most one document of each source below the budget.
    """
    items = items.where(F.col("tokens") > 0)
    p = plan(items, targets, budget)
    spark = items.sparkSession
    chosen = spark.createDataFrame(
        [(s, float(w), int(m), int(n), int(t), max(1, -(-int(n) // BUCKET_DOCS)), max(1, min(int(m), int(w * p.level / t) + 1))) for s, w, m, n, t in p.rows],
        "source string, target double, most int, documents long, total long, buckets int, copies int")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # the list of sources is a short configuration (at most MOST_SOURCES rows)
    df = items.join(F.broadcast(chosen), "source").withColumn("order", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 16), F.col("buckets")))
    sums = df.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("served", F.sum("tokens").over(inside)).join(sums, ["source", "bucket"]).withColumn("served", F.col("served") + F.col("before"))
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    total = (F.col("copy") - 1) * F.col("total") + F.col("served")
    df = df.withColumn("finish", total / F.col("target")).withColumn("start", (total - F.col("tokens")) / F.col("target"))
    df = df.select("doc_id", "source", "copy", "tokens", "finish", "start")
    whole = df.where(F.col("finish") <= p.level)
    # the one document of each source that is being served when the budget runs out
    cut = df.where((F.col("finish") > p.level) & (F.col("start") < p.level))
    used = df.where(F.col("finish") <= p.level).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used")).first()["used"]
    fits = cut.withColumn("upto", F.sum("tokens").over(Window.orderBy("finish", "source", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= p.budget - used)
    cols = ["doc_id", "source", "copy", "tokens", "finish"]
    return whole.select(*cols).unionByName(fits.select(*cols)).orderBy("finish", "source", "doc_id", "copy")


def shares(items: DataFrame, targets: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per source its target, what it has, what was drawn and the actual share.

    Lists the sources of both tables; without a target or a document the numbers are 0.
    """
    have = items.groupBy("source").agg(F.count_if(F.col("tokens") > 0).alias("documents"), F.sum("tokens").alias("available"))
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("draws"), F.max("copy").alias("copies"))
    total = got.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    df = one_row_each(targets).join(have, "source", "full").join(got, "source", "left").na.fill(0, ["target_share", "max_repeats", "documents", "available", "tokens", "draws", "copies"])
    share = F.col("tokens") / F.lit(total) if total else F.lit(0.0)
    return df.select("source", "target_share", "max_repeats", "documents", "available", "tokens", "draws", "copies", F.round(share, 6).alias("actual_share"))
