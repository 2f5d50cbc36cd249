"""Dense gridded volumes: bricks, retrieval, masks and reassembly.

A grid is an array ordered x fastest: element z*nx*ny + y*nx + x.  Bricks hold
16 x 16 x 8 cells, padded with NoData.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquery.functions import codes as C
from terraquery.functions.codec import decode_payload
from terraquery.plans import predicates as P

BX, BY, BZ = C.BRICK
CELLS = BX * BY * BZ
STEP_TOLERANCE = 1e-9


def decode(models: DataFrame, payload: str = "payload_b64") -> DataFrame:
    """Models with ``vals`` for ``payload``; null where the payload does not hold nx*ny*nz floats."""
    return models.withColumn("vals", decode_payload(F.col(payload), F.col("nx") * F.col("ny") * F.col("nz"))).drop(payload)


def checked(parsed: DataFrame, payload: str = "payload_b64") -> DataFrame:
    """Parsed models with ``vals``; a sound line whose payload does not hold its grid gets the error ``payload``."""
    df = decode(parsed, payload)
    return df.withColumn("error", F.coalesce("error", F.when(F.col("vals").isNull(), "payload")))


def has_data(vals: Column) -> Column:
    return F.exists(vals, lambda v: v != F.lit(C.NODATA).cast("float"))


def tile(models: DataFrame) -> DataFrame:
    """One row per brick: ``tile_i, tile_j, tile_k, brick_key, brick`` and the model's columns.

    Built from array expressions, so a brick is cut where its model is.
    """
    def count(n: str, b: int) -> Column:
        return F.ceil(F.col(n) / F.lit(b)).cast("int")

    df = models.where(F.col("vals").isNotNull() & (F.col("nx") > 0) & (F.col("ny") > 0) & (F.col("nz") > 0))
    for name, n, b in (("tile_i", "nx", BX), ("tile_j", "ny", BY), ("tile_k", "nz", BZ)):
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), count(n, b) - 1)))

    def cell(p: Column) -> Column:
        x = F.col("tile_i") * BX + p % BX
        y = F.col("tile_j") * BY + F.floor(p / BX).cast("int") % BY
        z = F.col("tile_k") * BZ + F.floor(p / (BX * BY)).cast("int")
        inside = (x < F.col("nx")) & (y < F.col("ny")) & (z < F.col("nz"))
        return F.when(inside, F.get("vals", z * F.col("nx") * F.col("ny") + y * F.col("nx") + x)).otherwise(F.lit(C.NODATA).cast("float"))

    df = df.withColumn("brick", F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell))
    key = F.concat_ws("|", "model_id", F.col("time_ms").cast("string"), F.col("tile_i").cast("string"), F.col("tile_j").cast("string"), F.col("tile_k").cast("string"))
    return df.withColumn("brick_key", key).drop("vals")


def brick_facts(bricks: DataFrame) -> DataFrame:
    """Bricks with the numbers of the fixed grid, their day, and whether they are indexed.

    A brick is indexed if it holds data and its model has the fixed step.
    """
    step = [(F.col(f"{a}_max") - F.col(f"{a}_min")) / F.col(n) for a, n in (("lon", "nx"), ("lat", "ny"), ("z", "nz"))]
    fits = P.both(*[F.abs(s - F.lit(f)) <= F.lit(STEP_TOLERANCE) for s, f in zip(step, C.VOLUME_STEP)])
    at = [F.col(f"{a}_min") + F.col(t) * F.lit(b * f) for a, t, b, f in (("lon", "tile_i", BX, C.VOLUME_STEP[0]), ("lat", "tile_j", BY, C.VOLUME_STEP[1]), ("z", "tile_k", BZ, C.VOLUME_STEP[2]))]
    gi, gj, gk = (C.volume_brick(v, i) for i, v in enumerate(at))
    return bricks.withColumns({"gi": gi, "gj": gj, "gk": gk, "day_bucket": C.day_bucket(F.col("time_ms")), "indexed": has_data(F.col("brick")) & fits})


def volume_query(facts: DataFrame, model_type: str, time: P.TimeRange, box: P.Box, engine: str = "unified") -> DataFrame:
    """Indexed bricks of a type and time whose cell is among those of the box.

    The cells are ranges of the three brick numbers; membership is by the brick's lower
    corner.  ``incremental`` gives the same by key sets.
    """
    from terraquery.operators.engines import run

    lo, hi = ([C.volume_brick_py(box.axis(i)[e], i) for i in range(3)] for e in (0, 1))
    cells = P.within_blocks((F.col("gi"), F.col("gj"), F.col("gk")), (1, 1, 1), tuple(lo), tuple(hi))
    days = time.implied("day_bucket", "month" if "month" in facts.columns else None)
    steps = [(F.col("indexed") & (F.col("model_type") == model_type), None), (cells, cells), (time.exact("time_ms"), days)]
    return run(facts, "brick_key", steps, engine)


def coverage(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """Per model and time: bricks hit, bricks in all, and their ratio."""
    alls = facts.groupBy("model_id", "time_ms").agg(F.first(F.ceil(F.col("nx") / BX) * F.ceil(F.col("ny") / BY) * F.ceil(F.col("nz") / BZ)).cast("bigint").alias("bricks"))
    hit = hits.groupBy("model_id", "time_ms").agg(F.countDistinct("brick_key").alias("hit"))
    return hit.join(alls, ["model_id", "time_ms"]).select("model_id", "time_ms", "hit", "bricks", F.round(F.col("hit") / F.col("bricks"), 6).alias("ratio"))


_META = "model_id string, time_ms bigint, model_type string, lon_min double, lon_max double, lat_min double, lat_max double, z_min double, z_max double, nx int, ny int, nz int"


def reassemble(hits: DataFrame, box: P.Box | None = None, nodata: float = C.NODATA) -> DataFrame:
    """Whole grids from bricks: one row per model and time with ``vals``, ``missing`` and ``kept``.

    Cells without a brick are ``nodata``.  With ``box`` only cells whose centre is in
    the half-open box are copied.  A group is the bricks of one model at one time, which
    its grid bounds.  Models of no brick do not occur; repeated bricks count once.
    """
    cols = [c.split()[0] for c in _META.split(", ")]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.iloc[0]
        nx, ny, nz = int(m["nx"]), int(m["ny"]), int(m["nz"])
        grid = np.full((nz, ny, nx), nodata, "float32")
        keep = np.ones((nz, ny, nx), bool)
        if box is not None:
            for axis, (name, n) in enumerate((("lon", nx), ("lat", ny), ("z", nz))):
                lo, step = m[f"{name}_min"], (m[f"{name}_max"] - m[f"{name}_min"]) / n
                centre = lo + (np.arange(n) + 0.5) * step
                a, b = box.axis(axis)
                keep &= ((centre >= a) & (centre < b)).reshape([-1 if 2 - axis == d else 1 for d in range(3)])
        kept, seen = 0, set()
        for i, j, k, brick in zip(pdf["tile_i"], pdf["tile_j"], pdf["tile_k"], pdf["brick"]):
            if (i, j, k) in seen:
                continue
            seen.add((i, j, k))
            part = np.asarray(brick, "float32").reshape(BZ, BY, BX)
            at = (slice(k * BZ, min((k + 1) * BZ, nz)), slice(j * BY, min((j + 1) * BY, ny)), slice(i * BX, min((i + 1) * BX, nx)))
            part = part[tuple(slice(0, s.stop - s.start) for s in at)]
            grid[at] = np.where(keep[at], part, nodata)
            kept += int(keep[at].sum())
        total = -(-nx // BX) * -(-ny // BY) * -(-nz // BZ)
        return pd.DataFrame([[*[m[c] for c in cols], grid.ravel(), total - len(seen), kept]], columns=[*cols, "vals", "missing", "kept"])

    used = hits.select(*cols, "tile_i", "tile_j", "tile_k", "brick")
    return used.groupBy("model_id", "time_ms").applyInPandas(build, _META + ", vals array<float>, missing int, kept int")


def masked_cells(hits: DataFrame, box: P.Box) -> DataFrame:
    """Per model and time the cells whose centre is in the half-open box, by array expressions alone."""
    def centre(a: str, n: str, t: str, b: int, p: Column) -> tuple[Column, Column]:
        step = (F.col(f"{a}_max") - F.col(f"{a}_min")) / F.col(n)
        i = F.col(t) * b + p
        return i < F.col(n), F.col(f"{a}_min") + (i + F.lit(0.5)) * step

    def inside(p: Column) -> Column:
        at = (p % BX, F.floor(p / BX).cast("int") % BY, F.floor(p / (BX * BY)).cast("int"))
        tests = []
        for axis, (a, n, t, b) in enumerate((("lon", "nx", "tile_i", BX), ("lat", "ny", "tile_j", BY), ("z", "nz", "tile_k", BZ))):
            real, c = centre(a, n, t, b, at[axis])
            lo, hi = box.axis(axis)
            tests += [real, c >= F.lit(lo), c < F.lit(hi)]
        return P.both(*tests)

    n = F.size(F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), inside))
    return hits.withColumn("n", n).groupBy("model_id", "time_ms").agg(F.sum("n").cast("bigint").alias("kept"))


def with_meta(bricks: DataFrame, meta: DataFrame) -> DataFrame:
    """Bricks with their model's metadata, by model and time; ``skipped`` where there is none.

    Where a model and time have several rows of metadata, each gives a row.
    """
    on = ["model_id", "time_ms"]
    found = bricks.join(meta.withColumn("__meta", F.lit(True)), on, "left")
    return found.withColumn("skipped", F.col("__meta").isNull()).drop("__meta")
