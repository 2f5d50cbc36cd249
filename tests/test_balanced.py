"""Balanced per-key results against plain grouping."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from terraquery.operators import balanced as B


def rows(n=6000, seed=4):
    rng = random.Random(seed)
    keys = ["hot"] * 4 + ["warm"] * 2 + [None] + [f"k{i}" for i in range(30)]
    out = [(rng.choice(keys[:7]) if rng.random() < 0.8 else rng.choice(keys), rng.choice([5, 5, 5, rng.randint(0, 10_000)]), rng.choice([None, float("nan"), 1.5, 2.5])) for _ in range(n)]
    return out + [("hot", 77, 1.0)] * 3000 + [("late", None, 1.0)] * 2 + [("hot", None, 2.0), (None, None, None)]


def test_ordered_runs(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "k string, o long, v double, n int")
    got = {r["k"]: r for r in B.ordered_runs(df, "k", "o", "v", 7).collect()}
    want = defaultdict(list)
    for k, o, v in data:
        want[k].append((o, v))
    assert set(got) == set(want)
    for k, x in want.items():
        o = sorted(a for a, _ in x if a is not None)
        v = [b for _, b in x if b is not None and b == b]
        r = got[k]
        assert (r["n"], r["first"], r["last"]) == (len(x), *((o[0], o[-1]) if o else (None, None)))
        assert r["max_gap"] == (max([b - a for a, b in zip(o, o[1:])], default=0) if o else None)
        assert (r["mean"] is None) == (not v) and (not v or abs(r["mean"] - sum(v) / len(v)) < 1e-9)


def test_heavy_key_spans_partitions(spark):
    df = spark.createDataFrame([("hot", 1) for _ in range(8000)] + [("x", i) for i in range(2000)], "k string, o long")
    parts = B.ranged(df, ["k"], ["o"], 8).withColumn("p", F.spark_partition_id())
    sizes = [r["n"] for r in parts.groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3000 and parts.where("k = 'hot'").select("p").distinct().count() >= 4


def test_heavy_keys_and_counts(spark):
    df = spark.createDataFrame([("a", i) for i in range(97)] + [(None, 1)] * 3 + [("b", 1)] * 3, "k string, o long")
    assert {(r["k"], r["n"]) for r in B.heavy_keys(df, "k", ["o"], 3).collect()} == {("a", 97)}
    assert {r["k"] for r in B.heavy_keys(df.limit(100), "k", ["o"], 3).collect()} <= {"a", "b"}
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k string, id long")
    got = {r["k"]: (r["n_left"], r["n_right"], r["n_pairs"]) for r in B.matched_counts(df, right, "k", "o", "id").collect()}
    assert got == {"a": (97, 2, 194), "b": (3, 0, 0), "c": (0, 1, 0)}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, o long, v double")
    assert B.ordered_runs(df, "k", "o", "v").count() == 0
    assert B.heavy_keys(df, "k", ["o"], 3).count() == 0
    assert B.matched_counts(df, df, "k", "o", "o").count() == 0
