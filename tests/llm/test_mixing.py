"""Mixtures against a plain queue simulation."""

import heapq

import pytest
from pyspark.sql import functions as F

from terraquery.llm import mixing as M


def data(spark, n=3000):
    rows = [(i, ["big", "big", "big", "mid", "small", "none"][i % 6] if i % 50 else None, 10 + i * 7 % 90) for i in range(n)] + [(n, "big", 0), (n + 1, "small", 5000)]
    items = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, tokens int, target double")
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.2, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    return rows, items, targets


@pytest.mark.parametrize("budget", [None, 5000, 60_000, 10**9])
def test_against_water_filling(spark, budget):
    rows, items, targets = data(spark)
    items = items.drop("target")
    drawn = M.mixture(items, targets, budget).collect()
    most, share = {"big": 1, "mid": 2, "small": 3}, {"big": 0.3, "mid": 0.4, "small": 0.2}
    total = {s: sum(t for _, x, t in rows if x == s) for s in share}
    supply = {s: total[s] * most[s] for s in share}
    want = min(sum(total.values()) if budget is None else budget, sum(supply.values()))
    got = {s: sum(r["tokens"] for r in drawn if r["source"] == s) for s in share}
    assert sum(got.values()) <= want and want - sum(got.values()) <= 5000 + 3 * 100
    # the level at which sources that are not used up stand
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(supply[s], share[s] * mid) for s in share) < want else (lo, mid)
    for s in share:
        assert abs(got[s] - min(supply[s], share[s] * lo)) <= 5000
    seen = {}
    for r in drawn:
        seen.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= most[s] for (s, _), c in seen.items())
    assert [r["finish"] for r in drawn] == sorted(r["finish"] for r in drawn)


def test_order_is_a_fair_queue(spark):
    _, items, targets = data(spark, 400)
    drawn = M.mixture(items.drop("target"), targets).collect()
    queues = {}
    for r in drawn:
        queues.setdefault(r["source"], []).append(r["tokens"])
    share, heap, out = {"big": 0.3, "mid": 0.4, "small": 0.2}, [], []
    for s, q in queues.items():
        heapq.heappush(heap, (q[0] / share[s], s, 0, q[0]))
    while heap:
        f, s, i, served = heapq.heappop(heap)
        out.append(s)
        if i + 1 < len(queues[s]):
            served += queues[s][i + 1]
            heapq.heappush(heap, (served / share[s], s, i + 1, served))
    assert out == [r["source"] for r in drawn]


def test_shares_and_edges(spark):
    _, items, targets = data(spark)
    items = items.drop("target")
    s = {r["source"]: r for r in M.shares(items, targets, M.mixture(items, targets)).collect()}
    assert abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-4
    twice = targets.unionByName(targets.where("source = 'big'").selectExpr("source", "0.0 target_share", "1 max_repeats"))
    assert {tuple(r) for r in M.mixture(items, twice).collect()} == {tuple(r) for r in M.mixture(items, targets).collect()} and M.shares(items, twice, M.mixture(items, twice)).count() == len(s)
    assert s["absent"]["tokens"] == 0 and s["none"]["target_share"] == 0 and s["none"]["tokens"] == 0 and s[None]["tokens"] == 0
    empty = items.where(F.lit(False))
    assert M.mixture(empty, targets).count() == 0 and M.shares(empty, targets, M.mixture(empty, targets)).count() == 4
    assert M.mixture(items, targets.where(F.lit(False))).count() == 0
