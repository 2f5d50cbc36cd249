"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full", "same")


def live_keys(rows: DataFrame, deletes: DataFrame, key: Sequence[str], written: str, deleted: str) -> DataFrame:
    """Keys with a write later than every delete of that key.

    One aggregation over the union of writes and deletes.  A key never deleted is
    live even where its only write has no time; with a delete, a write without a
    time proves nothing.  Deletes without a time are ignored.
    """
    cols = list(key)
    both = rows.select(*cols, F.col(written).alias("__w"), F.lit(None).cast("timestamp_ntz").alias("__d"), F.lit(1).alias("__row")).unionByName(
        deletes.where(F.col(deleted).isNotNull()).select(*cols, F.lit(None).cast("timestamp_ntz").alias("__w"), F.col(deleted).alias("__d"), F.lit(0).alias("__row"))
    )
    state = both.groupBy(*cols).agg(F.max("__w").alias("__w"), F.max("__d").alias("__d"), F.max("__row").alias("__row"))
    return state.where((F.col("__row") == 1) & (F.col("__d").isNull() | (F.col("__w") > F.col("__d")))).select(*cols)


def orphans(refs: DataFrame, parents: DataFrame, key: Sequence[str], match: str = "simple") -> DataFrame:
    """References whose composite ``key`` finds no parent, with their ``null_mask``.

    References are grouped by the mask of null key columns (bit i set: ``key[i]`` is
    null) and every mask is anti-joined on its non-null columns alone.  All null refers
    to nothing under each rule.

    * ``simple``: a reference with any null refers to nothing and is no orphan.
    * ``partial``: the non-null columns must match some parent.
    * ``full``: a reference with some but not all columns null is an orphan.
    * ``same``: null is a part like any other: the parent has the same mask and the same
      non-null columns.

    Under ``partial`` and ``same`` the masks that occur are found by one small
    aggregation, at most 2 to the number of key columns, and each is one join.  Parents
    with a null in a compared column match no one.  References that occur several times
    come out as often.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    key = list(key)

    def masked(df: DataFrame) -> DataFrame:
        return df.withColumn("null_mask", sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(key)), F.lit(0)).cast("int"))

    refs, whole = masked(refs), (1 << len(key)) - 1

    def lost(mask: int) -> DataFrame:
        on = [c for i, c in enumerate(key) if not mask >> i & 1]
        having = masked(parents.select(*key)).where(F.col("null_mask") == mask) if match == "same" else parents
        return refs.where(F.col("null_mask") == mask).join(having.select(*on), on, "left_anti").select(*refs.columns)

    found = lost(0)
    if match == "full":
        return found.unionByName(refs.where((F.col("null_mask") > 0) & (F.col("null_mask") < whole)))
    if match in ("partial", "same"):
        masks = {r["null_mask"] for r in refs.select("null_mask").distinct().collect()} - {0, whole}
        for m in sorted(masks):
            found = found.unionByName(lost(m))
    return found


def orphan_report(found: DataFrame, table: str, day: str) -> DataFrame:
    """Orphans per table and month of an ``yyyyMMdd`` number (null: month unknown)."""
    return found.groupBy(F.col(table).alias("table_name"), F.floor(F.col(day) / 100).cast("int").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
