"""Per-key results when a few keys hold most of the rows.

Rows are range-partitioned on the composite ``(key, secondary order)`` whose
boundaries Spark takes from sampled quantiles.  A heavy key therefore spans
several partitions instead of filling one.  Every partition reduces each run of
equal keys to one partial state; only runs at a partition's edges can share a key
with a neighbour, and those few states are stitched.  The stitch moves
``keys + partitions`` rows, never the input.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ranged(df: DataFrame, key: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``key`` and then ``order``.

    Rows equal in both would share a partition however many they are, so the row's
    place in its input split is the last component of the order.
    """
    df = df.withColumn("__place", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    by = [F.col(c) for c in (*key, *order, "__place")]
    return (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).drop("__place")


def balanced_aggregate(df: DataFrame, key: Sequence[str], order: Sequence[str], partitions: int | None = None, **aggs: Column) -> DataFrame:
    """Mergeable aggregates (count, min, max, sum, avg ...) per key.

    The aggregates run as partial states inside each range partition; Catalyst
    exchanges those states only and merges them.  Null keys form a group of
    their own.  An empty input gives an empty result.
    """
    part = ranged(df, key, order, partitions)
    return part.groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()])


def _runs(key: str, order: str, value: str):
    names = [key, "unknown", "n", "first", "last", "gap", "nv", "sv"]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One state per run of equal keys, of rows with and without an order; a run may go on over batches."""
        open_: list | None = None  # key, unknown, n, first, last, max_gap, n_value, sum_value
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[key]
            unknown = pdf["unknown"]
            code = k.ne(k.shift()) & ~(k.isna() & k.shift().isna()) | unknown.ne(unknown.shift())
            code.iloc[0] = True
            starts = np.flatnonzero(code.to_numpy())
            ends = np.append(starts[1:], len(pdf)) - 1
            o = pdf[order].to_numpy("int64")
            v = pdf[value].to_numpy("float64")
            ok = ~np.isnan(v)
            gap = np.zeros(len(o), "int64")
            gap[1:] = o[1:] - o[:-1]
            gap[starts] = 0
            out = {
                "k": [None if pd.isna(x) else x for x in k.iloc[starts]],
                "unknown": unknown.to_numpy(bool)[starts].tolist(), "n": (ends - starts + 1).tolist(), "first": o[starts].tolist(), "last": o[ends].tolist(),
                "gap": np.maximum.reduceat(gap, starts).tolist(),
                "nv": np.add.reduceat(ok.astype("int64"), starts).tolist(),
                "sv": np.add.reduceat(np.where(ok, v, 0.0), starts).tolist(),
            }
            rows = [list(r) for r in zip(*out.values())]
            if open_ is not None:
                head = rows[0]
                if head[:2] == open_[:2]:
                    rows[0] = [*head[:2], open_[2] + head[2], open_[3], head[4], max(open_[5], head[5], head[3] - open_[4]), open_[6] + head[6], open_[7] + head[7]]
                else:
                    rows.insert(0, open_)
            open_ = rows.pop()
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if open_ is not None:
            yield pd.DataFrame([open_], columns=names)

    return reduce


def ordered_runs(df: DataFrame, key: str, order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Per key: ``n``, ``first``, ``last``, ``max_gap`` of ``order`` and ``mean`` of ``value``.

    ``max_gap`` (the longest step between neighbours in order) needs the rows of a
    key in order, so the partial states are ordered too and the gap between one
    partition's last and the next one's first row is added when they are stitched.
    Rows with a null order count in ``n`` and ``mean`` of their key, but have no place
    in its order; null and NaN values do not enter the mean, which is null where no value
    is left.
    """
    o = F.col(order).cast("bigint")
    narrow = df.select(key, o.isNull().alias("unknown"), F.coalesce(o, F.lit(0)).alias(order), F.col(value).cast("double").alias(value))
    part = ranged(narrow, [key, "unknown"], [order], partitions).sortWithinPartitions(key, "unknown", order)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("unknown", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n", "first", "last", "gap", "nv")], T.StructField("sv", T.DoubleType())])
    states = part.mapInPandas(_runs(key, order, value), schema)
    # A key has at most one state per range partition: the window is that small.
    w = Window.partitionBy(key, "unknown").orderBy("first", "last")
    seen = states.withColumn("step", F.col("first") - F.lag("last").over(w))
    known = lambda c: F.when(~F.col("unknown"), F.col(c))
    return seen.groupBy(key).agg(
        F.sum("n").alias("n"), F.min(known("first")).alias("first"), F.max(known("last")).alias("last"),
        F.greatest(F.max(known("gap")), F.max(known("step"))).alias("max_gap"),
        F.when(F.sum("nv") > 0, F.sum("sv") / F.sum("nv")).alias("mean"),
    )


def heavy_keys(df: DataFrame, key: str, order: Sequence[str], percent: int, partitions: int | None = None) -> DataFrame:
    """Keys that hold at least ``percent`` % of all rows, with their number ``n``.

    Rows with a null key count in the total only.
    """
    total = df.count()
    counts = balanced_aggregate(df, [key], order, partitions, n=F.count(F.lit(1)))
    return counts.where(F.col(key).isNotNull() & (F.col("n") * 100 >= F.lit(total) * percent))


def matched_counts(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, partitions: int | None = None) -> DataFrame:
    """Per key the number of left rows, of right rows and of their pairs.

    Equals what grouping the equi-join would give, without producing its pairs:
    both sides are tagged and go through one balanced aggregation.  Null keys match
    nothing and are left out; keys of one side have 0 on the other.
    """
    both = left.select(F.col(key).alias("__k"), F.lit(0).alias("__side"), F.col(left_id).cast("bigint").alias("__id")).unionByName(
        right.select(F.col(key).alias("__k"), F.lit(1).alias("__side"), F.col(right_id).cast("bigint").alias("__id"))
    ).where(F.col("__k").isNotNull())
    out = balanced_aggregate(
        both, ["__k"], ["__side", "__id"], partitions,
        n_left=F.count_if(F.col("__side") == 0), n_right=F.count_if(F.col("__side") == 1),
    )
    return out.select(F.col("__k").alias(key), "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("n_pairs"))
