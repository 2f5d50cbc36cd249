"""Retrieval by attribute, time and box over SENSOR, POINT and VOXEL facts.

Three engines give one answer:

* ``exact``       the conditions on the raw columns;
* ``unified``     these, and the ranges of cell, day and bucket that they imply - one scan,
  which skips the folders, files and row groups of stored facts;
* ``incremental`` one key set per condition from a two-column projection, intersected by
  semi-joins and then looked up; kept for equivalence, it reads the facts several times.

Each returns a DataFrame of whole fact rows; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquery.functions import codes as C
from terraquery.plans import predicates as P

ENGINES = ("exact", "unified", "incremental")


def intersect_keys(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that are in every set; distinct."""
    out = sets[0].select(key)
    for other in sets[1:]:
        out = out.join(other.select(key), key, "left_semi")
    return out.distinct()


def lookup(facts: DataFrame, keys: DataFrame, key: str, probe: int = 0) -> DataFrame:
    """Fact rows with one of the keys; keys without a row vanish.

    Up to ``probe`` keys are looked for by value, which a scan of facts sorted by key, or
    with a bloom filter, can skip by; more are joined.
    """
    keys = keys.select(key)
    if probe:
        few = [r[0] for r in keys.distinct().limit(probe + 1).collect()]
        if len(few) <= probe:
            return facts.where(F.col(key).isin(few))
    return facts.join(keys, key, "left_semi")


def _stored(facts: DataFrame, *cols: str) -> bool:
    return all(c in facts.columns for c in cols)


def run(facts: DataFrame, key: str, steps: Sequence[tuple[Column | None, Column | None]], engine: str) -> DataFrame:
    """``steps`` are pairs (exact condition, implied condition) in the order attribute, space, time."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {ENGINES}")
    exact = P.both(*[e for e, _ in steps])
    if engine == "exact":
        return facts.where(exact)
    if engine == "unified":
        # Pruning by stored columns does not depend on the order; where they are computed
        # on the fly, the cheap conditions on raw columns come first and spare most rows.
        return facts.where(exact).where(P.both(*[i for _, i in steps]))
    sets = [facts.where(i if i is not None else e).select(key) for e, i in steps if e is not None or i is not None]
    if not sets:
        return facts
    return lookup(facts.where(exact), intersect_keys(sets, key), key)


def _cells(facts: DataFrame, corner: Sequence[tuple[int, int, int]], level: int, max_cells: int | None) -> Column:
    """The cells of a box, and the ranges of the code that facts are sorted by where it is stored."""
    cell = P.world_cells(F.col("ix"), F.col("iy"), F.col("iz"), *corner, level, max_cells)
    if not _stored(facts, "z_code"):
        return cell
    s = C.BITS - level
    lo, hi = tuple(v >> s << s for v in corner[0]), tuple((v >> s << s) + (1 << s) - 1 for v in corner[1])
    return cell & P.code_cover("z_code", lo, hi)


def _days(facts: DataFrame, time: P.TimeRange) -> Column:
    return time.implied("day_bucket", "month" if _stored(facts, "month") else None)


# --- SENSOR


def sensor_facts(df: DataFrame) -> DataFrame:
    """SENSOR rows with normalised indices, day and time of day."""
    ix, iy, iz = C.world_index(F.col("longitude"), F.col("latitude"), F.col("altitude"))
    return df.withColumns({"ix": ix, "iy": iy, "iz": iz, "day_bucket": C.day_bucket(F.col("time_ms")), "time_of_day": C.time_of_day(F.col("time_ms"))})


def sensor_query(facts: DataFrame, conditions: Sequence, engine: str = "unified", level: int | None = C.SENSOR_LEVEL, max_cells: int | None = None) -> DataFrame:
    """Any subset of id, type, time and box; ``level`` None leaves out the cells."""
    steps: dict[int, list] = {0: [], 1: [], 2: []}
    for c in conditions:
        if isinstance(c, P.IdEquals):
            steps[0].append((F.col("sensor_id") == c.value, None))
        elif isinstance(c, P.TypeEquals):
            steps[0].append((F.col("sensor_type") == c.value, None))
        elif isinstance(c, P.Box):
            cell = None
            if level is not None:
                at = [tuple(C.axis_index_py(c.axis(i)[e], *C.WORLD[a]) for i, a in enumerate("xyz")) for e in (0, 1)]
                cell = _cells(facts, at, level, max_cells)
            steps[1].append((c.contains("longitude", "latitude", "altitude"), cell))
        elif isinstance(c, P.TimeRange):
            steps[2].append((c.exact("time_ms"), _days(facts, c)))
        else:
            raise TypeError(f"no condition: {c!r}")
    return run(facts, "row_key", [s for k in sorted(steps) for s in steps[k]], engine)


# --- POINT


def point_bounds(df: DataFrame) -> C.Bounds | None:
    """Extent of all finite points; None without any.  One row comes to the driver."""
    cols = ("x", "y", "z")
    ok = P.both(*[F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in cols])
    r = df.where(ok).agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    return None if r[0] is None else C.Bounds(*r)


def point_facts(df: DataFrame, bounds: C.Bounds) -> DataFrame:
    """POINT rows with indices at the finest level, buckets, hash, day and time of day."""
    v = {f"{a}_bucket": C.vel_bucket(F.col(a), s) for a, s in zip(("vx", "vy", "vz"), C.POINT_VEL_STEP)}
    return df.withColumns({
        **{f"i{a}": bounds.index(F.col(a), a) for a in "xyz"}, **v, "temp_bucket": C.temp_bucket(F.col("t")),
        "day_bucket": C.day_bucket(F.col("time_ms")), "time_of_day": C.time_of_day(F.col("time_ms"))})


def _attr_steps(sim_id: str | None, temp: P.Range | None, vel: Sequence[P.Range] | None, vel_step: Sequence[float]) -> list:
    steps = []
    if sim_id is not None:
        steps.append((F.col("sim_id") == sim_id, None))
    if temp is not None:
        lo, hi = sorted((C.temp_bucket_py(temp.lo), C.temp_bucket_py(temp.hi)))
        steps.append((temp.exact("t"), F.col("temp_bucket").between(lo, hi)))
    if vel is not None:
        for a, r, s in zip(("vx", "vy", "vz"), vel, vel_step):
            lo, hi = sorted((C.vel_bucket_py(r.lo, s), C.vel_bucket_py(r.hi, s)))
            steps.append((r.exact(a), F.col(f"{a}_bucket").between(lo, hi)))
    return steps


def point_query(facts: DataFrame, bounds: C.Bounds, time: P.TimeRange, box: P.Box, sim_id: str | None = None, temp: P.Range | None = None,
                vel: Sequence[P.Range] | None = None, engine: str = "unified", level: int = 9, max_cells: int | None = None) -> DataFrame:
    """Points by id, temperature or velocity, in a time and a box."""
    corner = [tuple(bounds.index_py(box.axis(i)[e], a) for i, a in enumerate("xyz")) for e in (0, 1)]
    cell = _cells(facts, corner, level, max_cells)
    steps = [*_attr_steps(sim_id, temp, vel, C.POINT_VEL_STEP), (box.contains("x", "y", "z"), cell), (time.exact("time_ms"), _days(facts, time))]
    return run(facts, "dk", steps, engine)


# --- VOXEL


def latest(df: DataFrame, key: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``newest``: an upsert with a defined winner."""
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest)])
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("__r")).select(*key, "__r.*")


@dataclass(frozen=True)
class GridReport:
    grid: C.Grid
    rows: int
    mismatched: int


def voxel_grid(df: DataFrame, line: str) -> GridReport | None:
    """Grid of a voxel set in one aggregation: step of the first line, mismatches, bias."""
    first = df.agg(F.min_by(F.struct((F.col("x_max") - F.col("x_min")).alias("dx"), (F.col("y_max") - F.col("y_min")).alias("dy"), (F.col("z_max") - F.col("z_min")).alias("dz")), line)).first()[0]
    if first is None or min(first) <= 0:
        return None
    off = [F.abs(F.col(f"{a}_max") - F.col(f"{a}_min") - F.lit(d)) > F.lit(max(1.0, abs(d)) * 1e-6) for a, d in zip("xyz", first)]
    lows = [F.min(C.grid_index(F.col(f"{a}_min"), 0.0, d)) for a, d in zip("xyz", first)]
    sizes = [F.max(F.col(f"{a}_max") - F.col(f"{a}_min")) for a in "xyz"]
    r = df.agg(F.count(F.lit(1)), F.count_if(off[0] | off[1] | off[2]), *lows, *sizes).first()
    return GridReport(C.Grid((0.0, 0.0, 0.0), tuple(first), tuple(-v if v < 0 else 0 for v in r[2:5]), tuple(r[5:8])), r[0], r[1])


def voxel_facts(df: DataFrame, grid: C.Grid) -> DataFrame:
    v = {f"{a}_bucket": C.vel_bucket(F.col(a), s) for a, s in zip(("vx", "vy", "vz"), C.VOXEL_VEL_STEP)}
    return df.withColumns({
        **{f"{n}b": grid.index(F.col(f"{a}_min"), i) for i, (n, a) in enumerate(zip("ijk", "xyz"))}, **v, "temp_bucket": C.temp_bucket(F.col("t")),
        "day_bucket": C.day_bucket(F.col("time_ms")), "time_of_day": C.time_of_day(F.col("time_ms"))})


def voxel_query(facts: DataFrame, grid: C.Grid, time: P.TimeRange, box: P.Box, sim_id: str | None = None, temp: P.Range | None = None,
                vel: Sequence[P.Range] | None = None, engine: str = "unified", level: int = C.VOXEL_LEVEL, mode: str = "exact", max_cells: int | None = None) -> DataFrame:
    """Voxels that overlap a box.

    ``mode`` ``exact`` tests the overlap alone; ``indexed`` also demands that the block of
    the lower corner is among the blocks of the rounded box corners, which can miss
    voxels that reach in from outside.  In exact mode the implied condition is the range
    of lower corners of voxels no larger than ``grid.extent`` that can reach the box.
    """
    if level not in C.BLOCK_SIZE:
        raise ValueError(f"level must be one of {sorted(C.BLOCK_SIZE)}")
    inside, index = box.intersects("x_min", "x_max", "y_min", "y_max", "z_min", "z_max"), tuple(F.col(f"{n}b") for n in "ijk")
    cell = None
    if mode == "indexed":
        size = C.BLOCK_SIZE[level]
        corner = [tuple(C.block_of_py(grid.index_py(box.axis(i)[e], i), size[i]) for i in range(3)) for e in (0, 1)]
        cell = P.within_blocks(index, size, *corner, max_cells)
        inside = inside & cell
    elif grid.extent is not None:
        # one index more on either side keeps what rounding may have moved
        cell = P.both(*[index[i].between(F.lit(grid.index_py(box.axis(i)[0] - grid.extent[i], i) - 1), F.lit(grid.index_py(box.axis(i)[1], i) + 1)) for i in range(3)])
    steps = [*_attr_steps(sim_id, temp, vel, C.VOXEL_VEL_STEP), (inside, cell), (time.exact("time_ms"), _days(facts, time))]
    return run(facts, "brick_key", steps, engine)


# --- many boxes at once


def in_boxes(facts: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """``(box_id, dk)`` for many boxes: an equi-join on coarse columns, then the exact test.

    ``boxes`` has ``box_id, x0, y0, z0, x1, y1, z1``; ``cell`` is the side of the columns in x and y.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    wide = boxes.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    rows = facts.withColumn("cx", at("x")).withColumn("cy", at("y"))
    hit = rows.join(wide, ["cx", "cy"]).where(P.both(*[F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")) for a in "xyz"]))
    return hit.select("box_id", "dk")


# --- what a query did


def query_stats(facts: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row: rows scanned, rows left after each step in turn, and the share of the last in the first."""
    counts, so_far = [F.count(F.lit(1)).alias("scanned")], F.lit(True)
    for name, cond in steps:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    df = facts.agg(*counts)
    first, last = steps[0][0], steps[-1][0]
    return df.withColumn("precision", F.when(F.col(first) > 0, F.round(F.col(last) / F.col(first), 6)).otherwise(F.lit(0.0)))
