"""Normalisation of identifiers and keys (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often they are used.

    A one-element generator keeps the optimizer from substituting the expressions
    into every later use, filters included.
    """
    made = F.struct(*[c.alias(n) for n, c in cols.items()])
    kept = [c for c in df.columns if c not in cols]
    df = df.select(*kept, F.explode(F.array(made)).alias("__once"))
    return df.select(*kept, *[F.col(f"__once.{n}").alias(n) for n in cols])


_EDGES = "".join(map(chr, range(33)))


def trimmed(c: Column) -> Column:
    """Text without outer blanks and control characters (all up to U+0020)."""
    return F.btrim(c, F.lit(_EDGES))


def point_sim_id(c: Column) -> Column:
    """Point identifier: trimmed; digits with an all-zero fraction lose it."""
    return F.regexp_replace(trimmed(c), "^([0-9]+)\\.0+$", "$1")


def _side(c: Column) -> Column:
    t = trimmed(c)
    # Only decimal text counts as a number, so that names such as "nan" stay text.
    num = F.when(t.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?$"),
                 F.regexp_replace(t, "[dDfF]$", "").try_cast("double"))
    whole = (num == F.floor(num)) & (F.abs(num) < F.lit(9.2e18))
    return F.when(whole, F.when(whole, num).otherwise(F.lit(0.0)).cast("bigint").cast("string")).otherwise(t)


def voxel_sim_id(c: Column) -> Column:
    """Voxel identifier ``a/b``: each integral side becomes whole-number text.

    Anything without exactly one inner slash is only trimmed.  Null stays null.
    """
    t = trimmed(c)
    # trailing empty parts do not count as parts
    p = F.split(F.regexp_replace(t, "/+$", ""), "/", -1)
    return F.when(F.size(p) == 2, F.concat(_side(F.get(p, 0)), F.lit("/"), _side(F.get(p, 1)))).otherwise(t)


def row_key_text(c: Column) -> Column:
    """Row key for comparison: outer blanks, case and the legacy ``tile_`` do not matter.

    A blank key becomes null: it refers to nothing.
    """
    k = F.replace(F.lower(trimmed(c)), F.lit("tile_"), F.lit(""))
    return F.when(k != "", k)
