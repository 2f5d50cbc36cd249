"""Registered queries of the retrieval engine, with their SQL twins."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquery import line_twins
from terraquery.functions import codes as C
from terraquery.functions.codec import decode_payload, encode_payload
from terraquery.functions.keys import point_sim_id, row_key_text
from terraquery.operators import engines as E
from terraquery.operators import volume as V
from terraquery.operators.boxes import count_in_boxes
from terraquery.plans import predicates as P
from terraquery.plans import ranges as R
from terraquery.session import shared_dir
from terraquery.sources import catalog, exports, jobs, lines, records
from terraquery.sources import views as S

BOX = P.Box(4144100, 647030, -2650, 4144800, 647170, -2350)
TIME = P.TimeRange(820454400000, 946684800000)
TEMP = P.Range(300, 350)
POINT_VEL = (P.Range(-2e-4, 3e-4), P.Range(-3e-4, 2e-4), P.Range(-5e-3, 5e-3))
VOXEL_BOX = P.Box(103, 96, 2, 307, 304, 21)
VOXEL_VEL = (P.Range(-2e-6, 3e-6), P.Range(-3e-6, 2e-6), P.Range(-5e-5, 5e-5))
VOLUME_TIME = P.TimeRange(1762300800000, 1763596800000)
MANY_BOX = P.Box(113.30, 22.27, 20, 113.62, 22.60, 70)
VOLUME_BOX = P.Box(113.30, 22.30, 0, 114.00, 22.90, 1000)
SENSOR_ID = P.IdEquals("SENS_007")
SENSOR_TIME = P.TimeRange(1704153600000, 1706486400000)
SENSOR_BOX = P.Box(111, 21.3, 50, 119, 24.7, 950)
LEVEL = 9

# --- scalar functions


def z3d_encode(spark: SparkSession, sf: str) -> DataFrame:
    f = E.sensor_facts(S.sensors(spark, sf))
    z = C.morton(F.col("ix"), F.col("iy"), F.col("iz"))
    return f.select("row_key", z.alias("z"), C.from_big_endian(C.big_endian(z)).alias("z_again"))


def block_id_level(spark: SparkSession, sf: str) -> DataFrame:
    f = E.sensor_facts(S.sensors(spark, sf))
    return f.select("row_key", *[C.block_code(F.col("ix"), F.col("iy"), F.col("iz"), n).alias(f"block_{n}") for n in (4, 9, 19)])


def curve_code(spark: SparkSession, sf: str) -> DataFrame:
    f = E.sensor_facts(S.sensors(spark, sf))
    return f.select("row_key", C.curve_code(F.col("ix"), F.col("iy"), F.col("iz")).alias("code"))


def fnv1a_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "documents").select("doc_id", "subject")
    return d.select("doc_id", C.attr_hash(F.col("subject")).alias("h31"), C.fnv1a32(F.col("subject")).alias("h32"))


def day_bucket(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("time_ms")
    return S.sensors(spark, sf).select("row_key", C.day_bucket(ms).alias("day_bucket"), C.time_of_day(ms).alias("time_of_day"), C.format_instant(ms).alias("iso"), (C.parse_instant(C.format_instant(ms)) - ms + ms % 1000).alias("lost"))


def days_of_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = S.table(spark, sf, "chunk_task")
    return t.select("task_id", F.size(C.days_between(F.col("day_from"), F.col("day_to"))).alias("days"), F.size(C.days_between(F.col("day_to"), F.col("day_from"), swap=True)).alias("swapped"))


def temp_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return S.points(spark, sf).select("dk", C.temp_bucket(F.col("t")).alias("b"), C.temp_bucket(F.col("t"), 2.0, 400.0).alias("b400"))


def vel_bucket(spark: SparkSession, sf: str) -> DataFrame:
    b = [C.vel_bucket(F.col(a), s) for a, s in zip(("vx", "vy", "vz"), C.POINT_VEL_STEP)]
    return S.points(spark, sf).select("dk", *[c.alias(f"b_{a}") for c, a in zip(b, ("vx", "vy", "vz"))], C.flip_sign(b[0]).alias("flipped"), C.flip_sign(C.flip_sign(b[1])).alias("back"))


def unified_key(spark: SparkSession, sf: str) -> DataFrame:
    f = S.table(spark, sf, "geosim_point_idx_unified")
    k = C.unified_key(C.KIND["id"], F.col("attr_hash"), F.col("z_cell"), F.col("day_bucket"), F.col("time_of_day"), F.col("dk"))
    return f.select("entry_id", F.length(k).alias("bytes"), C.unified_key_parts(k).alias("p")).select("entry_id", "bytes", F.col("p.attr").alias("attr"), F.col("p.z_cell").alias("z_cell"), F.col("p.day_bucket").alias("day_bucket"), F.col("p.time_of_day").alias("time_of_day"), F.col("p.dk").alias("dk"))


def unified_key_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The five keys of each point, one a kind of attribute, as hexadecimal text."""
    b = C.Bounds(4_144_000.0, 4_145_000.0, 647_000.0, 648_000.0, -2_700.0, -2_300.0)
    p = S.points(spark, sf)
    velocity = {a: C.flip_sign(C.vel_bucket(F.col(a), s)) for a, s in zip(("vx", "vy", "vz"), C.POINT_VEL_STEP)}
    attr = {"id": C.attr_hash(F.col("sim_id")), "temp": C.temp_bucket(F.col("t")), **velocity}
    cell = C.block_code(*[b.index(F.col(a), a) for a in "xyz"], LEVEL)
    keys = [F.struct(F.lit(k).alias("kind"), F.hex(C.unified_key(C.KIND[k], a, cell, C.day_bucket(F.col("time_ms")), C.time_of_day(F.col("time_ms")), F.col("dk"))).alias("key_hex")) for k, a in attr.items()]
    return p.select("dk", F.explode(F.array(*keys)).alias("k")).select("dk", "k.kind", "k.key_hex")


def point_index_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries of stored points, derived anew: hash, level-4 cell, day and time of day."""
    b = C.Bounds(4_140_000.0, 4_160_000.0, 640_000.0, 660_000.0, -3_200.0, 0.0)
    d = S.table(spark, sf, "geosim_point_data").select("row_key", point_sim_id(F.col("sim_id")).alias("sim_id"), "time_millis", "x", "y", "z").distinct()
    cell = C.block_code(b.index(F.col("x"), "x"), b.index(F.col("y"), "y"), b.index(F.col("z"), "z"), 4)
    return d.select("row_key", "time_millis", C.attr_hash(F.col("sim_id")).alias("attr_hash"), cell.alias("z_cell"), C.day_bucket(F.col("time_millis")).alias("day_bucket"), C.time_of_day(F.col("time_millis")).alias("time_of_day"))


def z_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in a box by code ranges, then exactly on the indices; the ranges alone never miss one."""
    lo, hi = R.world_box((SENSOR_BOX.x0, SENSOR_BOX.y0, SENSOR_BOX.z0), (SENSOR_BOX.x1, SENSOR_BOX.y1, SENSOR_BOX.z1))
    z = C.morton(F.col("ix"), F.col("iy"), F.col("iz"))
    hit = F.lit(False)
    for a, b in R.code_ranges(lo, hi, 64):
        hit = hit | F.col("z").between(a, b)
    f = E.sensor_facts(S.sensors(spark, sf)).withColumn("z", z).where(hit)
    return f.where(P.both(*[F.col(f"i{a}").between(lo[i], hi[i]) for i, a in enumerate("xyz")])).select("row_key")


def curve_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same by ranges of the permuted code."""
    lo, hi = R.world_box((SENSOR_BOX.x0, SENSOR_BOX.y0, SENSOR_BOX.z0), (SENSOR_BOX.x1, SENSOR_BOX.y1, SENSOR_BOX.z1))
    hit = F.lit(False)
    for a, b in R.code_ranges(lo, hi, 64, curve=True):
        hit = hit | F.col("code").between(a, b)
    f = E.sensor_facts(S.sensors(spark, sf)).withColumn("code", C.curve_code(F.col("ix"), F.col("iy"), F.col("iz"))).where(hit)
    return f.where(P.both(*[F.col(f"i{a}").between(lo[i], hi[i]) for i, a in enumerate("xyz")])).select("row_key")


# --- SENSOR

_SENSOR = {
    "sensor_spatial": (SENSOR_ID, SENSOR_BOX, SENSOR_TIME), "sensor_bbox": (SENSOR_BOX, SENSOR_TIME), "sensor_type": (P.TypeEquals("click"), SENSOR_BOX, SENSOR_TIME),
    "sensor_time": (SENSOR_ID, SENSOR_TIME), "sensor_id": (SENSOR_ID,), "sensor_any_type": (P.TypeEquals("error"),)}


def _sensor(spark: SparkSession, sf: str, name: str, engine: str) -> DataFrame:
    return E.sensor_query(E.sensor_facts(S.sensors(spark, sf)), _SENSOR[name], engine, LEVEL).select("row_key", "time_ms", "sensor_id", "longitude", "latitude", "altitude", "sensor_type")


# --- POINT

_POINT = {"sim_point": {"sim_id": "2"}, "sim_point_temp": {"temp": TEMP}, "sim_point_vel": {"vel": POINT_VEL}}


def _point(spark: SparkSession, sf: str, name: str, engine: str, level: int = LEVEL, max_cells: int | None = None) -> DataFrame:
    raw = S.points(spark, sf)
    bounds = E.point_bounds(raw)
    if bounds is None:
        return raw.select("dk")
    return E.point_query(E.point_facts(raw, bounds), bounds, TIME, BOX, engine=engine, level=level, max_cells=max_cells, **_POINT[name]).select("dk", "sim_id", "time_ms", "x", "y", "z", "t")


def point_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return S.points(spark, sf).agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))], F.count(F.lit(1)).alias("n"))


def point_query_stats(spark: SparkSession, sf: str) -> DataFrame:
    return E.query_stats(S.points(spark, sf), [("by_id", F.col("sim_id") == "2"), ("in_box", BOX.contains("x", "y", "z")), ("in_time", TIME.exact("time_ms"))])


def keys_intersect(spark: SparkSession, sf: str) -> DataFrame:
    p = S.points(spark, sf)
    return E.intersect_keys([p.where(r.exact(a)).select("dk") for a, r in zip(("vx", "vy", "vz"), POINT_VEL)] + [p.where(BOX.contains("x", "y", "z")), p.where(TIME.exact("time_ms"))], "dk")


def keys_union(spark: SparkSession, sf: str) -> DataFrame:
    p = S.points(spark, sf)
    return p.where(TEMP.exact("t")).select("sim_id", "time_ms").unionByName(p.where(BOX.contains("x", "y", "z")).select("sim_id", "time_ms")).distinct()


def point_cell_stats(spark: SparkSession, sf: str) -> DataFrame:
    """How many points each condition leaves, the implied ones of cells and days before the exact ones."""
    raw = S.points(spark, sf)
    bounds = E.point_bounds(raw)
    corner = [tuple(bounds.index_py(BOX.axis(i)[e], a) for i, a in enumerate("xyz")) for e in (0, 1)]
    cells = P.world_cells(F.col("ix"), F.col("iy"), F.col("iz"), *corner, LEVEL)
    steps = [("by_id", F.col("sim_id") == "2"), ("in_cells", cells), ("in_days", TIME.implied("day_bucket")), ("in_box", BOX.contains("x", "y", "z")), ("in_time", TIME.exact("time_ms"))]
    return E.query_stats(E.point_facts(raw, bounds), steps)


def keys_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Points of few keys, which are looked for by value."""
    p = S.points(spark, sf)
    few = p.where(TEMP.exact("t") & BOX.contains("x", "y", "z") & F.col("vx").between(0, 1e-6) & F.col("vy").between(0, 1e-6))
    return E.lookup(p, few, "dk", probe=100).select("dk", "sim_id")


def bucket_cell_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Bucket times cell task list of a temperature query: two short generated lists."""
    lo, hi = C.temp_bucket_py(TEMP.lo), C.temp_bucket_py(TEMP.hi)
    df = spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("bucket"))
    box = R.world_box((114.0, 23.2, 200), (114.2, 23.3, 220))
    return df.select("bucket", F.explode(F.lit(R.cells(*box, 9))).alias("z_cell"))


def boxes_all(spark: SparkSession, sf: str) -> DataFrame:
    """Points in one box per part, of all parts; the offsets wrap inside the extent of the points."""
    p = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("box_id"), *[F.expr(e).cast("double").alias(n) for n, e in (
            ("x0", "4144000 + p_partkey * 9 % 980"), ("y0", "647000 + p_partkey * 8 % 970"), ("z0", "-2700"), ("x1", "4144020 + p_partkey * 9 % 980"), ("y1", "647030 + p_partkey * 8 % 970"), ("z1", "-2500"))])
    return count_in_boxes(S.points(spark, sf), p)


# --- VOXEL

_VOXEL = {"sim_voxel": {"sim_id": "2/3"}, "sim_voxel_temp": {"temp": TEMP}, "sim_voxel_vel": {"vel": VOXEL_VEL}}
GRID = C.Grid((0.0, 0.0, 0.0), (10.0, 10.0, 5.0), (8, 8, 4), (10.0, 10.0, 5.0))


def _voxel(spark: SparkSession, sf: str, name: str, engine: str, level: int = 4, mode: str = "exact") -> DataFrame:
    f = E.voxel_facts(S.voxels(spark, sf), GRID)
    return E.voxel_query(f, GRID, TIME, VOXEL_BOX, engine=engine, level=level, mode=mode, **_VOXEL[name]).select("brick_key", "sim_id", "t", "vx")


def voxel_cells(spark: SparkSession, sf: str) -> DataFrame:
    f = E.voxel_facts(S.voxels(spark, sf), GRID)
    cell = lambda n: C.morton(*[C.block_of(F.col(f"{a}b"), s) for a, s in zip("ijk", C.BLOCK_SIZE[n])])
    return f.select("brick_key", cell(4).alias("cell_4"), cell(8).alias("cell_8"))


def voxel_grid(spark: SparkSession, sf: str) -> DataFrame:
    r = E.voxel_grid(S.voxels(spark, sf), "brick_key")
    return spark.createDataFrame([(*r.grid.step, *r.grid.bias, r.rows, r.mismatched)], "dx double, dy double, dz double, bi long, bj long, bk long, n long, mismatched long")


def voxel_grid_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of voxels of which some are longer than the first one."""
    v = S.voxels(spark, sf).withColumn("x_max", F.col("x_max") + F.when(F.col("x_min") % 70 == 0, 5.0).otherwise(0.0))
    r = E.voxel_grid(v, "brick_key")
    return spark.createDataFrame([(*r.grid.step, *r.grid.extent, r.rows, r.mismatched)], "dx double, dy double, dz double, ex double, ey double, ez double, n long, mismatched long")


def brick_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The latest version of each stored brick, keys in either spelling."""
    d = S.table(spark, sf, "volume_brick_data").select(row_key_text(F.col("row_key")).alias("key"), "written_at", "t", "vx", "vy", "vz")
    return E.latest(d, ["key"], [F.col("written_at"), F.coalesce("t", F.lit(-1e9)), F.col("vx"), F.col("vy"), F.col("vz")]).select("key", "written_at", "t", "vx")


def brick_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries and the stored bricks that they find, keys in either spelling."""
    idx = S.table(spark, sf, "volume_idx_unified").select("entry_id", row_key_text(F.col("dk")).alias("key"))
    data = S.table(spark, sf, "volume_brick_data").select(row_key_text(F.col("row_key")).alias("key"))
    return E.lookup(idx, data, "key").select("entry_id")


# --- stored facts

#: Row groups in the small test tables, a thousandth of the usual size.
ROW_GROUP = 128 << 10
#: Rows of a slice of months that is written at a time, and the most slices, as each reads its source.
SLICE_ROWS, SLICES = 2_000_000, 6
_AT: dict[tuple, str] = {}


def _dated(df: DataFrame) -> DataFrame:
    return df.select(C.day_bucket(F.col("time_ms")).alias("day_bucket"))


def stored(spark: SparkSession, sf: str, family: str, layout: str = "unified") -> str:
    """Root of the facts of a family in a layout over the test tables, written once in an application."""
    key = (spark.sparkContext.applicationId, sf, family, layout)
    if key not in _AT or not catalog.exists(spark, _AT[key]):
        root, meta, days = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}", {}, None
        if family == "point":
            days = S.points(spark, sf)
            meta["bounds"] = E.point_bounds(days)
            df = E.point_facts(days, meta["bounds"])
        elif family == "voxel":
            days = S.voxel_places(spark, sf)  # its grid is that of the voxels, as versions share their place
            meta["grid"] = E.voxel_grid(days, "brick_key").grid
            df = E.voxel_facts(S.voxels(spark, sf), meta["grid"])
        elif family == "sensor":
            days = S.sensors(spark, sf)
            df = E.sensor_facts(days)
        else:
            df = _bricks(spark, sf)
        cuts = catalog.month_cuts(_dated(days), SLICE_ROWS, SLICES) if days is not None else []
        catalog.write_facts(df, root, family, "test", layout, row_group=ROW_GROUP, cuts=cuts)
        if meta:
            catalog.write_meta(spark, jobs.meta_path(root, family, "test"), **meta)
        catalog.delete_on_exit(spark, root)
        _AT[key] = root
    return _AT[key]


_OPEN: dict[tuple, tuple] = {}


def opened(spark: SparkSession, sf: str, family: str, layout: str = "unified") -> tuple:
    """Stored facts and their bounds or grid, listed and read once in an application."""
    root = stored(spark, sf, family, layout)
    key = (root, family, layout)
    if key not in _OPEN:
        _OPEN[key] = jobs.facts(spark, root, family, "test", layout)
    return _OPEN[key]


_LAYOUT_OF = {"": "unified", "_temp": "temp_unified", "_vel": "vel_unified"}


def _stored_point(spark: SparkSession, sf: str, name: str) -> DataFrame:
    facts, bounds = opened(spark, sf, "point", _LAYOUT_OF[name.removeprefix("sim_point")])
    return E.point_query(facts, bounds, TIME, BOX, level=LEVEL, **_POINT[name]).select("dk", "sim_id", "time_ms", "x", "y", "z", "t")


def _stored_voxel(spark: SparkSession, sf: str, name: str) -> DataFrame:
    facts, grid = opened(spark, sf, "voxel", _LAYOUT_OF[name.removeprefix("sim_voxel")])
    return E.voxel_query(facts, grid, TIME, VOXEL_BOX, **_VOXEL[name]).select("brick_key", "sim_id", "t", "vx")


def _stored_sensor(spark: SparkSession, sf: str) -> DataFrame:
    facts, _ = opened(spark, sf, "sensor")
    return E.sensor_query(facts, _SENSOR["sensor_spatial"], level=LEVEL).select("row_key", "time_ms", "sensor_id", "longitude", "latitude", "altitude", "sensor_type")


def _stored_volume(spark: SparkSession, sf: str) -> DataFrame:
    facts, _ = opened(spark, sf, "volume")
    return V.volume_query(facts, "channelized", VOLUME_TIME, VOLUME_BOX).select("brick_key", "model_id", "time_ms")


# --- VOLUME


def _models(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    return S.grids(spark, sf) if many else S.volumes(spark, sf)


def _bricks(spark: SparkSession, sf: str, many: bool = False) -> DataFrame:
    return V.brick_facts(V.tile(_models(spark, sf, many)))


def _hits(spark: SparkSession, sf: str, engine: str = "unified", many: bool = False) -> DataFrame:
    return V.volume_query(_bricks(spark, sf, many), "channelized", VOLUME_TIME, MANY_BOX if many else VOLUME_BOX, engine)


def _volume_tile(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    real = F.filter("brick", lambda v: v != F.lit(C.NODATA).cast("float"))
    return V.tile(_models(spark, sf, many)).select("brick_key", F.size("brick").alias("cells"), F.size(real).alias("filled"), F.round(F.aggregate(real, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def _volume_cells(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    return _bricks(spark, sf, many).select("brick_key", "gi", "gj", "gk", C.morton(F.col("gi"), F.col("gj"), F.col("gk")).alias("z_cell"), "indexed")


def _volume_bricks(spark: SparkSession, sf: str, engine: str) -> DataFrame:
    return _hits(spark, sf, engine).select("brick_key", "model_id", "time_ms")


def _volume_coverage(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    b = _bricks(spark, sf, many)
    return V.coverage(b, V.volume_query(b, "channelized", VOLUME_TIME, MANY_BOX if many else VOLUME_BOX))


def _volume_mask(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    m = V.reassemble(_hits(spark, sf, many=many), MANY_BOX if many else VOLUME_BOX)
    left = F.size(F.filter("vals", lambda v: v != F.lit(C.NODATA).cast("float")))
    return m.select("model_id", "time_ms", "kept", left.alias("filled"), "missing")


def _volume_mask_cells(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    return V.masked_cells(_hits(spark, sf, many=many), MANY_BOX if many else VOLUME_BOX)


def volume_mask_report(spark: SparkSession, sf: str) -> DataFrame:
    """The text statistics beside a masked export."""
    return exports.mask_report(V.reassemble(_hits(spark, sf, many=True), MANY_BOX))


def _volume_lines(models: DataFrame, payload) -> DataFrame:
    cols = ["model_id", C.format_instant(F.col("time_ms")), "model_type", *[F.col(f"{a}_{e}").cast("string") for e in ("min", "max") for a in ("lon", "lat", "z")], *[F.col(n).cast("string") for n in ("nx", "ny", "nz")]]
    return models.select(F.concat_ws("\t", *cols, payload).alias("raw_line"))


def _volume_export(spark: SparkSession, sf: str, many: bool) -> DataFrame:
    """Tile, reassemble, encode, parse, decode: the grids must come back whole."""
    m = V.reassemble(V.tile(_models(spark, sf, many))).where("missing = 0")
    back = V.decode(records.parse_volumes(_volume_lines(m, encode_payload(F.col("vals")))).where("error is null"))
    return back.select("model_id", "time_ms", F.size("vals").alias("cells"), F.round(F.aggregate("vals", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def volume_load_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded and failed lines by reason; some lines are broken in each of the ways a line can be."""
    broken = F.col("broken")
    m = S.volumes(spark, sf).withColumn("broken", F.expr("cast(substr(model_id, 2) as bigint) % 10")).withColumns({"nx": F.when(broken == 1, 0).when(broken == 2, 5).otherwise(F.col("nx")), "model_id": F.when(broken == 3, "").otherwise(F.col("model_id"))})
    payload = encode_payload(F.col("vals"))
    payload = F.when(broken == 4, F.substr(payload, F.lit(1), F.lit(40))).when(broken == 5, F.lit(None)).when(broken == 6, "").when(broken == 7, "%%%").otherwise(payload)
    found = V.checked(records.parse_volumes(_volume_lines(m, payload)))
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("lines"))


def brick_export(spark: SparkSession, sf: str) -> DataFrame:
    """Bricks as they are exported; the payload is read back."""
    rows = exports.brick_rows(_hits(spark, sf, many=True))
    back = decode_payload(F.col("payload_b64"), F.lit(V.CELLS))
    real = F.filter(back, lambda v: v != F.lit(C.NODATA).cast("float"))
    return rows.select("model_id", "time_iso", "time_millis", "model_type", "tile_i", "tile_j", "tile_k", "nx", F.size(real).alias("filled"))


def volume_types(spark: SparkSession, sf: str) -> DataFrame:
    return S.volumes(spark, sf).groupBy("model_type").agg(F.count(F.lit(1)).alias("models"))


def brick_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Bricks of all models joined to the metadata of some; the others are skipped and counted as such."""
    meta = S.volumes(spark, sf).where("model_type = 'layered'").select("model_id", "time_ms", F.col("nx").alias("meta_nx"))
    return V.with_meta(V.tile(S.volumes(spark, sf)), meta).select("brick_key", "meta_nx", "skipped")


# --- text in and out


def _sensor_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = S.table(spark, sf, "events")
    bad = F.when(F.col("event_id") % 10 == 3, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("user_id").cast("string"), (F.col("event_id") % 1000).cast("string"), F.lit("22"), bad, "event_type").alias("raw_line"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    catalog.delete_on_exit(spark, path)
    return path


def lines_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a text file with their numbers."""
    path = _folder(spark, "text")
    e = S.table(spark, sf, "events").orderBy("event_id").select(F.concat_ws(",", F.col("event_id").cast("string"), "event_type").alias("value"))
    e.coalesce(1).write.text(path)
    return records.read_numbered(spark, path).select("line_no", "raw_line")


def _load_report(spark: SparkSession, sf: str, family: str) -> DataFrame:
    """Text files written, loaded as facts and read back: lines by what became of them."""
    path, root = _folder(spark, "text"), _folder(spark, "loaded")
    if family == "sensor":
        _sensor_lines(spark, sf).select(F.col("raw_line").alias("value")).write.text(path)
    else:
        t = S.table(spark, sf, f"geosim_{family}_line")
        t.repartition("file_name").sortWithinPartitions("file_name", "line_no").select("file_name", F.col("raw_line").alias("value")).write.partitionBy("file_name").text(path)
    out = jobs.LOADERS[family](spark, path, root, "d")
    stored = jobs.facts(spark, root, family, "d")[0]
    rows = [("loaded", out["loaded"]), ("failed", out["failed"]), *out["reasons"].items()]
    if family == "point":
        rows.append(("stored", stored.where("ix is not null").count()))
    elif family == "sensor":
        rows.append(("stored", stored.where("day_bucket is not null").count()))
    return spark.createDataFrame(rows, "what string, n long")


def parse_sensor(spark: SparkSession, sf: str) -> DataFrame:
    p = records.parse_sensors(_sensor_lines(spark, sf))
    return p.groupBy("sensor_id", "sensor_type").agg(F.count(F.lit(1)).alias("n"), F.min("time_ms").alias("first_ms"), F.max("longitude").alias("max_lon"))


def export_sensor_csv(spark: SparkSession, sf: str) -> DataFrame:
    return exports.sensor_csv(S.sensors(spark, sf))


def export_sensor_json(spark: SparkSession, sf: str) -> DataFrame:
    j = exports.sensor_json(S.sensors(spark, sf))
    return j.select(F.get_json_object("value", "$.row_key").alias("row_key"), F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.timestamp").cast("bigint").alias("time"))


def export_raw_json(spark: SparkSession, sf: str) -> DataFrame:
    """Point lines as objects under the names of a header."""
    names = ["sim_id", "time", "x", "y", "z", "T", "P", "vx", "vy", "vz"]
    rows = exports.raw_json(S.table(spark, sf, "geosim_point_line").where("raw_line is not null and not contains(raw_line, '\"') and not contains(raw_line, '\\\\')"), names)
    return rows.groupBy(F.get_json_object("value", "$.sim_id").alias("sim_id"), F.get_json_object("value", "$.vz").alias("vz")).agg(F.count(F.lit(1)).alias("n"))


def export_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return exports.envelope(S.sensors(spark, sf)).select("total_count")


def rows_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Points that the cells of a box select and its exact bounds refuse."""
    raw = S.points(spark, sf)
    bounds = E.point_bounds(raw)
    corner = [tuple(bounds.index_py(BOX.axis(i)[e], a) for i, a in enumerate("xyz")) for e in (0, 1)]
    return exports.rejected(E.point_facts(raw, bounds), P.world_cells(F.col("ix"), F.col("iy"), F.col("iz"), *corner, LEVEL), BOX.contains("x", "y", "z")).select("dk")


def keys_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries whose key has no stored brick."""
    idx = S.table(spark, sf, "volume_idx_unified").select("entry_id", row_key_text(F.col("dk")).alias("key"))
    return exports.missing(idx, S.table(spark, sf, "volume_brick_data").select(row_key_text(F.col("row_key")).alias("key")), "key").select("entry_id")

def export_raw_csv(spark: SparkSession, sf: str) -> DataFrame:
    return exports.raw_csv(S.table(spark, sf, "geosim_voxel_line").where("raw_line is not null"))


def selectivity_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, P.selectivity(*c)) for n, c in _SENSOR.items()]
    return spark.createDataFrame(rows, "query string, estimate double")


QUERIES = {f.__name__: f for f in (
    z3d_encode, block_id_level, curve_code, fnv1a_hash, day_bucket, days_of_tasks, temp_bucket, vel_bucket, unified_key, unified_key_kinds, point_index_entries, z_ranges, curve_ranges, lines_numbered,
    point_bounds, point_query_stats, point_cell_stats, keys_intersect, keys_union, keys_probe, bucket_cell_tasks, boxes_all, voxel_cells, voxel_grid, voxel_grid_mixed, brick_versions, brick_lookup,
    volume_types, brick_meta, brick_export, volume_mask_report, volume_load_reasons,
    parse_sensor, export_sensor_csv, export_sensor_json, export_raw_csv, export_raw_json, export_envelope, rows_refused, keys_missing, selectivity_report)}
for _f in (_volume_tile, _volume_cells, _volume_coverage, _volume_mask, _volume_mask_cells, _volume_export):
    QUERIES |= {_f.__name__[1:] + ("_many" if many else ""): partial(_f, many=many) for many in (False, True)}
QUERIES |= {f"{n}_{e}" if e != "unified" else n: partial(_sensor, name=n, engine=e) for n in _SENSOR for e in ("unified", "incremental") if e == "unified" or n in ("sensor_spatial", "sensor_bbox")}
QUERIES |= {f"{n}_{e}": partial(_point, name=n, engine=e) for n in _POINT for e in E.ENGINES}
QUERIES |= {f"{n}_{e}": partial(_voxel, name=n, engine=e) for n in _VOXEL for e in E.ENGINES}
QUERIES |= {f"sim_voxel_indexed_l{n}": partial(_voxel, name="sim_voxel", engine="unified", level=n, mode="indexed") for n in (4, 6, 8)}
QUERIES |= {f"load_{f}s": partial(_load_report, family=f) for f in ("sensor", "point", "voxel")}
QUERIES |= {f"volume_bricks_{e}": partial(_volume_bricks, engine=e) for e in ("unified", "incremental")}
QUERIES |= {f"stored_{n}": partial(_stored_point, name=n) for n in _POINT} | {f"stored_{n}": partial(_stored_voxel, name=n) for n in _VOXEL}
QUERIES |= {"stored_sensor_spatial": _stored_sensor, "stored_volume_bricks": _stored_volume}

# --- SQL twins


def _d(x: float) -> str:
    return f"({x!r})::double"


_SENSOR_V = """sensor_v as (select cast(event_id as varchar) row_key, epoch_us(ts)//1000 time_ms, 'SENS_'||lpad(cast(user_id%50 as varchar),3,'0') sensor_id,
 110+(event_id%1000)*0.01::double longitude, 21+((event_id*7)%400)*0.01::double latitude, least(value*2,1000::double) altitude, event_type sensor_type, event_id, ts from events)"""
_POINT_V = """point_v as (select concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey) dk, cast(l_suppkey%4+1 as varchar) sim_id, epoch_us(l_shipdate)//1000+(l_orderkey%24)*3600000 time_ms,
 (4144000+l_orderkey%1000)::double x, (647000+l_partkey%1000)::double y, -2700+l_quantity*8 z, 273.15::double+l_extendedprice/500 t,
 (l_discount-0.05::double)*0.01::double vx, (l_tax-0.04::double)*0.01::double vy, (l_discount-l_tax)*0.1::double vz from lineitem)"""
_VOXEL_V = """voxel_v as (select *, i*10::double x_min, (i+1)*10::double x_max, j*10::double y_min, (j+1)*10::double y_max, k*5::double z_min, (k+1)*5::double z_max,
  concat_ws('|',sim_id,time_ms,i+8,j+8,k+4) brick_key from (select *, row_number() over (partition by sim_id,time_ms,i,j,k order by tie desc, tie2 desc) rn from (
  select cast(l_suppkey%3+1 as varchar)||'/3' sim_id, epoch_us(l_shipdate)//1000 time_ms, l_orderkey%64-8 i, l_partkey%64-8 j, trunc(l_quantity)::bigint%16-4 k, 273.15::double+l_extendedprice/500 t,
  (l_discount-0.05::double)*1e-4::double vx, (l_tax-0.04::double)*1e-4::double vy, (l_discount-l_tax)*1e-3::double vz, l_extendedprice tie, concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey) tie2 from lineitem)) where rn=1)"""
_VOLUME_V = """volume_v as (select 'M'||vec_id model_id, 1762300800000+vec_id*3600000 time_ms, case when label%2=0 then 'channelized' else 'layered' end model_type,
 113.25::double+(vec_id%16)*0.0625::double lon_min, 22.25::double+((vec_id//16)%16)*0.0625::double lat_min, (vec_id%4)*62.5::double z_min, embedding vals from embeddings)"""
_ICE = "least(2097151,greatest(0,trunc(({v}-{lo})/({w})*2097151::double)))::bigint"


def _index(v: str, a: str) -> str:
    lo, hi = C.WORLD[a]
    return _ICE.format(v=v, lo=_d(lo), w=_d(hi - lo))


_SENSOR_I = f"{_SENSOR_V}, sensor_i as (select *, {_index('longitude', 'x')} ix, {_index('latitude', 'y')} iy, {_index('altitude', 'z')} iz from sensor_v)"


def _morton(x: str, y: str, z: str) -> str:
    bit = lambda v, o: f"((({v} >> q) & 1) << (3*q+{o}))"
    return f"list_sum(list_transform(range(21), lambda q: {bit(x, 0)} + {bit(y, 1)} + {bit(z, 2)}))::bigint"


def _block(v: str, level: int) -> str:
    s = C.BITS - level
    return f"(({v} >> {s}) << {s})"


def _fnv(s: str) -> str:
    return f"list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({s},''), lambda c: unicode(c)::bigint)), lambda a, c: (xor(a,c)*16777619) & 4294967295)"


def _between(r: P.Range | tuple, col: str) -> str:
    lo, hi = (r.lo, r.hi) if isinstance(r, P.Range) else r
    return f"{col} between {_d(lo)} and {_d(hi)}"


def _box_sql(b: P.Box, cols: tuple[str, ...]) -> str:
    return " and ".join(_between(b.axis(i), c) for i, c in enumerate(cols))


def _cond_sql(c) -> str:
    if isinstance(c, P.IdEquals):
        return f"sensor_id='{c.value}'"
    if isinstance(c, P.TypeEquals):
        return f"sensor_type='{c.value}'"
    if isinstance(c, P.TimeRange):
        return f"time_ms between {c.start} and {c.end}"
    return _box_sql(c, ("longitude", "latitude", "altitude"))


_TIME = f"time_ms between {TIME.start} and {TIME.end}"
_POINT_BOX = _box_sql(BOX, ("x", "y", "z"))
_PVEL = " and ".join(_between(r, a) for a, r in zip(("vx", "vy", "vz"), POINT_VEL))
_VVEL = " and ".join(_between(r, a) for a, r in zip(("vx", "vy", "vz"), VOXEL_VEL))
_OVER = " and ".join(f"{a}_min<={_d(VOXEL_BOX.axis(i)[1])} and {a}_max>={_d(VOXEL_BOX.axis(i)[0])}" for i, a in enumerate("xyz"))
_VOL_HIT = f"""{_VOLUME_V}, brick_v as (select *, model_id||'|'||time_ms||'|0|0|0' brick_key, floor(lon_min/{_d(0.0625)})::bigint gi, floor(lat_min/{_d(0.0625)})::bigint gj, floor(z_min/{_d(62.5)})::bigint gk,
  len(list_filter(vals, lambda v: v <> -9999))>0 indexed from volume_v),
 hit as (select * from brick_v where indexed and model_type='channelized' and time_ms between {VOLUME_TIME.start} and {VOLUME_TIME.end}
  and {' and '.join(f"{g} between {C.volume_brick_py(VOLUME_BOX.axis(i)[0], i)} and {C.volume_brick_py(VOLUME_BOX.axis(i)[1], i)}" for i, g in enumerate(('gi', 'gj', 'gk')))})"""
_CENTRES = " and ".join(
    f"{a}_min + (c{a}+0.5::double)*{_d(s)} >= {_d(VOLUME_BOX.axis(i)[0])} and {a}_min + (c{a}+0.5::double)*{_d(s)} < {_d(VOLUME_BOX.axis(i)[1])}" for i, (a, s) in enumerate(zip(("lon", "lat", "z"), C.VOLUME_STEP)))
_MASK = f"""with {_VOL_HIT}, cell as (select model_id, time_ms, vals, p, p%4 clon, (p//4)%4 clat, p//16 cz, lon_min, lat_min, z_min from hit, (select unnest(range(64)) p)),
 kept as (select model_id, time_ms, sum(case when {_CENTRES} then 1 else 0 end)::bigint kept, sum(case when {_CENTRES} and vals[p+1]<>-9999 then 1 else 0 end)::int filled from cell group by 1,2)"""


def _index_of_point(a: str) -> str:
    lo, hi = C.WORLD[a]
    v = f"(case when isnan({a}) then {a} else least(greatest({a}, b.{a}_min), b.{a}_max) end - b.{a}_min)/(b.{a}_max-b.{a}_min)*{_d(hi - lo)}+{_d(lo)}"
    return "case when isnan(" + a + ") then 0 else " + _index(f"({v})", a) + " end"


_CELLED = f"""{_POINT_V}, b as (select min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max, min(z) z_min, max(z) z_max from point_v),
 q as (select * from (values {", ".join("(" + ", ".join(_d(BOX.axis(i)[e]) for i in range(3)) + ")" for e in (0, 1))}) v(x,y,z)),
 c as (select {", ".join(f"min(({_index_of_point(a)}) >> 12) l{a}, max(({_index_of_point(a)}) >> 12) h{a}" for a in "xyz")} from q, b),
 p as (select point_v.*, {", ".join(f"({_index_of_point(a)}) >> 12 g{a}" for a in "xyz")} from point_v, b)"""
_IN_CELLS = "gx between lx and hx and gy between ly and hy and gz between lz and hz"
_DAYS = "strftime(make_timestamp(time_ms*1000),'%Y%m%d')::int between {} and {}".format(*TIME.days())
_KEY_BOUNDS = "(select 4144000::double x_min, 4145000::double x_max, 647000::double y_min, 648000::double y_max, -2700::double z_min, -2300::double z_max)"

# models of eight bricks: the cells, the bricks, and those of the box
_GRID_V = """grid_v as (select 'G'||vec_id model_id, 1762300800000+vec_id*3600000 time_ms, case when label%2=0 then 'channelized' else 'layered' end model_type,
 113.25::double+(vec_id%16)*0.0625::double lon_min, 22.25::double+((vec_id//16)%16)*0.0625::double lat_min, (vec_id%4)*62.5::double z_min, vec_id, embedding from embeddings),
 cell_v as (select *, case when (p+vec_id)%97=0 then -9999::float else embedding[(p*7+vec_id)%64+1]::float end v, p%20 cx, (p//20)%18 cy, p//360 cz from grid_v, (select unnest(range(3600)) p)),
 brick_v as (select *, model_id||'|'||time_ms||'|'||i||'|'||j||'|'||k brick_key, floor((lon_min+i*0.0625::double)/0.0625::double)::bigint gi, floor((lat_min+j*0.0625::double)/0.0625::double)::bigint gj, floor((z_min+k*62.5::double)/62.5::double)::bigint gk
  from grid_v, (select unnest([0,1]) i), (select unnest([0,1]) j), (select unnest([0,1]) k))"""
_GRID_HIT = f"""{_GRID_V}, hit as (select * from brick_v where model_type='channelized' and time_ms between {VOLUME_TIME.start} and {VOLUME_TIME.end}
 and {' and '.join(f"{g} between {C.volume_brick_py(MANY_BOX.axis(i)[0], i)} and {C.volume_brick_py(MANY_BOX.axis(i)[1], i)}" for i, g in enumerate(('gi', 'gj', 'gk')))}),
 hits as (select model_id, time_ms, count(*) hit from hit group by 1,2)"""
_GRID_CENTRES = " and ".join(
    f"c.{a}_min + (c.{n}+0.5::double)*{_d(s)} >= {_d(MANY_BOX.axis(i)[0])} and c.{a}_min + (c.{n}+0.5::double)*{_d(s)} < {_d(MANY_BOX.axis(i)[1])}" for i, (a, n, s) in enumerate(zip(("lon", "lat", "z"), ("cx", "cy", "cz"), C.VOLUME_STEP)))
_GRID_KEPT = f"""{_GRID_HIT}, kept as (select h.model_id, h.time_ms, count(*) filter ({_GRID_CENTRES}) kept, count(*) filter ({_GRID_CENTRES} and v<>-9999) filled
 from hit h join cell_v c on h.model_id=c.model_id and c.cx//16=h.i and c.cy//16=h.j and c.cz//8=h.k group by 1,2)"""
_GRID_TILE = "select model_id||'|'||time_ms||'|'||(cx//16)||'|'||(cy//16)||'|'||(cz//8) brick_key, count(*) filter (v<>-9999)::int filled, round(sum(v::double) filter (v<>-9999), 4) total from cell_v group by 1"


def _selectivity_sql(c) -> str:
    if isinstance(c, P.IdEquals):
        return "1::double/50"
    if isinstance(c, P.TypeEquals):
        return "1::double/4"
    if isinstance(c, P.TimeRange):
        return f"least(1, greatest(0, ({c.end}-{c.start})/(30*86400000::double)))"
    return "*".join(f"greatest(0, least(1, ({c.axis(i)[1]!r}::double-{c.axis(i)[0]!r}::double)/({C.WORLD[a][1]!r}::double-{C.WORLD[a][0]!r}::double)))" for i, a in enumerate("xyz"))


_IDX_B = "(select 4140000::double x_min, 4160000::double x_max, 640000::double y_min, 660000::double y_max, -3200::double z_min, 0::double z_max)"
_SIMN = "regexp_replace(regexp_replace(sim_id,'^[\\x00-\\x20]+|[\\x00-\\x20]+$','','g'),'^([0-9]+)\\.0+$','\\1')"
_KEYN = "nullif(replace(lower(regexp_replace({c},'^[\\x00-\\x20]+|[\\x00-\\x20]+$','','g')),'tile_',''),'')"


def _indexed_sql(level: int) -> str:
    size, parts = C.BLOCK_SIZE[level], []
    for i, (n, b) in enumerate(zip("ijk", GRID.bias)):
        lo, hi = (C.block_of_py(GRID.index_py(VOXEL_BOX.axis(i)[e], i), size[i]) for e in (0, 1))
        parts.append(f"({n}+{b})//{size[i]} between {lo} and {hi}")
    return " and ".join(parts)


_ORDER = ", ".join(map(str, C.CURVE_ORDER))
ORACLES = {
    "z3d_encode": f"with {_SENSOR_I} select row_key, {_morton('ix', 'iy', 'iz')} z, {_morton('ix', 'iy', 'iz')} z_again from sensor_i",
    "block_id_level": f"with {_SENSOR_I} select row_key, " + ", ".join(f"{_morton(_block('ix', n), _block('iy', n), _block('iz', n))} block_{n}" for n in (4, 9, 19)) + " from sensor_i",
    "curve_code": f"with {_SENSOR_I} select row_key, list_sum(list_transform(range(21), lambda i: ([{_ORDER}][1+((ix>>i)&1)*4+((iy>>i)&1)*2+((iz>>i)&1)])::bigint << (3*i)))::bigint code from sensor_i",
    "fnv1a_hash": f"select doc_id, (h & 2147483647)::int h31, (case when h>=2147483648 then h-4294967296 else h end)::int h32 from (select doc_id, {_fnv('subject')} h from documents where subject is not null and subject<>'') union all select doc_id, (2166136261 & 2147483647)::int, (2166136261-4294967296)::int from documents where subject='' union all select doc_id, null, null from documents where subject is null",
    "day_bucket": f"with {_SENSOR_V} select row_key, strftime(ts,'%Y%m%d')::int day_bucket, (time_ms%86400000)::int time_of_day, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') iso, 0::bigint lost from sensor_v",
    "days_of_tasks": "select task_id, (case when a<=b then b-a+1 else 0 end)::int \"days\", (abs(b-a)+1)::int swapped from (select task_id, strptime(day_from::varchar,'%Y%m%d')::date a, strptime(day_to::varchar,'%Y%m%d')::date b from chunk_task)",
    "temp_bucket": f"with {_POINT_V} select dk, trunc(t/2)::int b, (case when t-400>=0 then trunc((t-400)/2) else trunc((t-400-2+1)/2) end)::int b400 from point_v",
    "vel_bucket": f"with {_POINT_V}, b as (select dk, floor(vx/1e-4::double)::int b_vx, floor(vy/1e-4::double)::int b_vy, floor(vz/1e-3::double)::int b_vz from point_v) select *, (case when b_vx>=0 then b_vx-2147483648 else b_vx+2147483648 end)::int flipped, b_vy back from b",
    "unified_key": "select entry_id, " + ", ".join(f"case when attr_hash is not null and z_cell is not null and day_bucket is not null and time_of_day is not null and dk is not null then {e} end {n}" for n, e in (("bytes", "(22+strlen(dk))::int"), ("attr", "attr_hash"), ("z_cell", "z_cell"), ("day_bucket", "day_bucket"), ("time_of_day", "time_of_day"), ("dk", "dk"))) + " from geosim_point_idx_unified",
    "point_index_entries": f"""with d as (select distinct row_key, {_SIMN} sim_id, time_millis, x, y, z from geosim_point_data),
 p as (select d.*, {", ".join(f"case when {a} is null then null else {_index_of_point(a)} end i{a}" for a in "xyz")} from d, {_IDX_B} b)
select row_key, time_millis, (case when sim_id is null then null when sim_id='' then 18652613 else {_fnv('sim_id')} & 2147483647 end)::int attr_hash, case when ix is null or iy is null or iz is null then null else {_morton(_block('ix', 4), _block('iy', 4), _block('iz', 4))} end z_cell,
 strftime(make_timestamp(time_millis*1000),'%Y%m%d')::int day_bucket, (time_millis%86400000)::int time_of_day from p""",
    "z_ranges": f"with {_SENSOR_I} select row_key from sensor_i where " + " and ".join(f"i{a} between {C.axis_index_py(SENSOR_BOX.axis(i)[0], *C.WORLD[a])} and {C.axis_index_py(SENSOR_BOX.axis(i)[1], *C.WORLD[a])}" for i, a in enumerate("xyz")),
    "point_bounds": f"with {_POINT_V} select min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max, min(z) z_min, max(z) z_max, count(*) n from point_v",
    "point_query_stats": f"with {_POINT_V}, c as (select count(*) scanned, count(*) filter(sim_id='2') by_id, count(*) filter(sim_id='2' and {_POINT_BOX}) in_box, count(*) filter(sim_id='2' and {_POINT_BOX} and {_TIME}) in_time from point_v) select *, case when by_id>0 then round(in_time/by_id,6) else 0 end \"precision\" from c",
    "keys_intersect": f"with {_POINT_V} select distinct dk from point_v where {_PVEL} and {_POINT_BOX} and {_TIME}",
    "keys_union": f"with {_POINT_V} select distinct sim_id, time_ms from point_v where {_between(TEMP, 't')} or ({_POINT_BOX})",
    "bucket_cell_tasks": f"select bucket::int bucket, z_cell from (select unnest(range(150,176)) bucket), (select {_morton('gx', 'gy', 'gz')} z_cell from " + ", ".join(
        f"(select unnest(range({lo >> 12},{(hi >> 12) + 1})) << 12 g{a})" for a, lo, hi in zip("xyz", *R.world_box((114.0, 23.2, 200), (114.2, 23.3, 220)))) + ")",
    "boxes_all": f"with {_POINT_V} select p_partkey box_id, count(*) points from part, point_v where x between 4144000+p_partkey*9%980 and 4144020+p_partkey*9%980 and y between 647000+p_partkey*8%970 and 647030+p_partkey*8%970 and z between -2700 and -2500 group by 1",
    "voxel_cells": f"with {_VOXEL_V} select brick_key, {_morton('((i+8)//16)', '((j+8)//16)', '((k+4)//8)')} cell_4, {_morton('(i+8)', '(j+8)', '(k+4)')} cell_8 from voxel_v",
    "voxel_grid": f"with {_VOXEL_V} select 10::double dx, 10::double dy, 5::double dz, greatest(-min(i),0) bi, greatest(-min(j),0) bj, greatest(-min(k),0) bk, count(*) n, 0::bigint mismatched from voxel_v",
    "voxel_grid_mixed": f"""with {_VOXEL_V}, v as (select brick_key, x_max - x_min + case when x_min % 70 = 0 then 5 else 0 end w, y_max-y_min h, z_max-z_min d from voxel_v),
 f as (select arg_min(w, brick_key) dx, arg_min(h, brick_key) dy, arg_min(d, brick_key) dz from v)
select any_value(dx) dx, any_value(dy) dy, any_value(dz) dz, max(w) ex, max(h) ey, max(d) ez, count(*) n, count(*) filter (abs(w-dx)>greatest(1,dx)*1e-6 or abs(h-dy)>greatest(1,dy)*1e-6 or abs(d-dz)>greatest(1,dz)*1e-6) mismatched from v, f""",
    "brick_versions": f"with d as (select {_KEYN.format(c='row_key')} \"key\", * from volume_brick_data), r as (select *, row_number() over (partition by \"key\" order by written_at desc, coalesce(t,-1e9) desc, vx desc, vy desc, vz desc) rn from d) select \"key\", written_at, t, vx from r where rn=1",
    "brick_lookup": f"select entry_id from volume_idx_unified where {_KEYN.format(c='dk')} in (select {_KEYN.format(c='row_key')} from volume_brick_data)",
    "volume_tile": f"with {_VOLUME_V} select model_id||'|'||time_ms||'|0|0|0' brick_key, 2048::int cells, len(list_filter(vals, lambda v: v<>-9999))::int filled, round(list_sum(list_transform(vals, lambda v: v::double)),4) total from volume_v",
    "volume_cells": f"with {_VOL_HIT} select brick_key, gi, gj, gk, {_morton('gi', 'gj', 'gk')} z_cell, indexed from brick_v",
    "volume_coverage": f"with {_VOL_HIT} select model_id, time_ms, 1::bigint hit, 1::bigint bricks, 1::double ratio from hit",
    "volume_mask": _MASK + " select model_id, time_ms, kept::int kept, filled, 0::int missing from kept",
    "volume_mask_cells": _MASK + " select model_id, time_ms, kept from kept",
    "volume_export": f"with {_VOLUME_V} select model_id, time_ms, 64::int cells, round(list_sum(list_transform(vals, lambda v: v::double)),4) total from volume_v",
    "volume_types": f"with {_VOLUME_V} select model_type, count(*) models from volume_v group by 1",
    "brick_meta": f"with {_VOLUME_V} select model_id||'|'||time_ms||'|0|0|0' brick_key, case when model_type='layered' then 4::int end meta_nx, model_type<>'layered' skipped from volume_v",
    "parse_sensor": "select user_id::varchar sensor_id, event_type sensor_type, count(*) n, min(epoch_ms(date_trunc('second',ts))) first_ms, max(event_id%1000)::double max_lon from events where event_id%10<>3 group by 1,2",
    "export_sensor_csv": f"with {_SENSOR_V} select strftime(ts,'%Y-%m-%d %H:%M:%S') \"Time\", sensor_id \"ID\", longitude \"Longitude\", latitude \"Latitude\", altitude \"Altitude\", sensor_type \"Type\", row_key \"RowKey\" from sensor_v",
    "export_sensor_json": f"with {_SENSOR_V} select row_key, sensor_type \"type\", time_ms \"time\" from sensor_v",
    "export_raw_csv": "select replace(raw_line,chr(9),',') \"value\" from geosim_voxel_line where raw_line is not null",
    "selectivity_report": "select * from (values " + ", ".join(f"('{n}', {'*'.join(map(_selectivity_sql, c))})" for n, c in _SENSOR.items()) + ") v(query, estimate)",
    "unified_key_kinds": f"""with {_POINT_V}, p as (select point_v.*, {", ".join(f"(({_index_of_point(a)}) >> 12) << 12 g{a}" for a in "xyz")} from point_v, {_KEY_BOUNDS} b),
 k as (select dk, time_ms, {_morton('gx', 'gy', 'gz')} cell, unnest(['id','temp','vx','vy','vz']) kind, unnest([1,2,3,4,5]) num,
  unnest([{_fnv('sim_id')} & 2147483647, trunc(t/2)::bigint, floor(vx/1e-4::double)::bigint+2147483648, floor(vy/1e-4::double)::bigint+2147483648, floor(vz/1e-3::double)::bigint+2147483648]) attr from p)
select dk, kind, upper('0'||num||lpad(to_hex(attr & 4294967295),8,'0')||lpad(to_hex(cell),16,'0')||lpad(to_hex(strftime(make_timestamp(time_ms*1000),'%Y%m%d')::int),8,'0')||lpad(to_hex(time_ms%86400000),8,'0')||'5F'||hex(dk)) key_hex from k""",
    "point_cell_stats": f"""with {_CELLED}, s as (select sim_id='2' a, {_IN_CELLS} b, {_DAYS} c, {_POINT_BOX} d, {_TIME} e from p, c),
 n as (select count(*) scanned, count(*) filter (a) by_id, count(*) filter (a and b) in_cells, count(*) filter (a and b and c) in_days, count(*) filter (a and b and c and d) in_box, count(*) filter (a and b and c and d and e) in_time from s)
select *, case when by_id>0 then round(in_time/by_id,6) else 0 end "precision" from n""",
    "rows_refused": f"with {_CELLED} select dk from p, c where {_IN_CELLS} and not ({_POINT_BOX})",
    "keys_missing": f"select entry_id from volume_idx_unified where {_KEYN.format(c='dk')} is null or {_KEYN.format(c='dk')} not in (select {_KEYN.format(c='row_key')} from volume_brick_data where {_KEYN.format(c='row_key')} is not null)",
    "keys_probe": f"with {_POINT_V} select dk, sim_id from point_v where {_between(TEMP, 't')} and {_POINT_BOX} and vx between 0 and 1e-6::double and vy between 0 and 1e-6::double",
    "volume_tile_many": f"with {_GRID_V} select brick_key, 2048::int cells, filled, total from ({_GRID_TILE})",
    "volume_cells_many": f"with {_GRID_V} select brick_key, gi, gj, gk, {_morton('gi', 'gj', 'gk')} z_cell, true indexed from brick_v",
    "volume_coverage_many": f"with {_GRID_HIT} select model_id, time_ms, hit, 8::bigint bricks, round(hit/8, 6) ratio from hits",
    "volume_mask_many": f"with {_GRID_KEPT} select model_id, time_ms, kept::int kept, filled::int filled, (8-hit)::int missing from kept join hits using (model_id, time_ms)",
    "volume_mask_cells_many": f"with {_GRID_KEPT} select model_id, time_ms, kept from kept",
    "volume_mask_report": f"with {_GRID_KEPT} select model_id||', '||strftime(make_timestamp(time_ms*1000),'%Y-%m-%dT%H:%M:%SZ')||', 3600, '||kept||', '||printf('%.4f', kept/3600)||', '||(8-hit) \"value\" from kept join hits using (model_id, time_ms)",
    "volume_export_many": f"with {_GRID_V} select model_id, time_ms, 3600::int cells, round(sum(v::double), 4) total from cell_v group by 1, 2",
    "brick_export": f"with {_GRID_HIT}, t as ({_GRID_TILE}) select model_id, strftime(make_timestamp(time_ms*1000),'%Y-%m-%dT%H:%M:%SZ') time_iso, time_ms time_millis, model_type, i tile_i, j tile_j, k tile_k, 20::int nx, filled from hit join t using (brick_key)",
    "volume_load_reasons": "select case vec_id%10 when 1 then 'nx' when 3 then 'model_id' when 5 then 'columns' when 2 then 'payload' when 4 then 'payload' when 6 then 'payload' when 7 then 'payload' end error, count(*) \"lines\" from embeddings group by 1",
    "export_envelope": "select count(*) total_count from events",
    "export_raw_json": "with v as (select case when contains(raw_line, chr(9)) then string_split(raw_line, chr(9)) else string_split(raw_line, ',') end f from geosim_point_line where raw_line is not null and not contains(raw_line,'\"') and not contains(raw_line, chr(92))) select trim(f[1]) sim_id, trim(f[10]) vz, count(*) n from v group by 1, 2",
}
for _n, _c in _SENSOR.items():
    for _e in ("", "_incremental"):
        if _n + _e in QUERIES:
            ORACLES[_n + _e] = f"with {_SENSOR_V} select row_key, time_ms, sensor_id, longitude, latitude, altitude, sensor_type from sensor_v where {' and '.join(map(_cond_sql, _c))}"
for _n, _w in (("sim_point", "sim_id='2'"), ("sim_point_temp", _between(TEMP, "t")), ("sim_point_vel", _PVEL)):
    for _e in (f"{_n}_{e}" for e in E.ENGINES):
        ORACLES[_e] = ORACLES[f"stored_{_n}"] = f"with {_POINT_V} select dk, sim_id, time_ms, x, y, z, t from point_v where {_w} and {_POINT_BOX} and {_TIME}"
for _n, _w in (("sim_voxel", "sim_id='2/3'"), ("sim_voxel_temp", _between(TEMP, "t")), ("sim_voxel_vel", _VVEL)):
    for _e in (f"{_n}_{e}" for e in E.ENGINES):
        ORACLES[_e] = ORACLES[f"stored_{_n}"] = f"with {_VOXEL_V} select brick_key, sim_id, t, vx from voxel_v where {_w} and {_OVER} and {_TIME}"
for _l in (4, 6, 8):
    ORACLES[f"sim_voxel_indexed_l{_l}"] = f"with {_VOXEL_V} select brick_key, sim_id, t, vx from voxel_v where sim_id='2/3' and {_OVER} and {_TIME} and {_indexed_sql(_l)}"
for _e in ("unified", "incremental"):
    ORACLES[f"volume_bricks_{_e}"] = f"with {_VOL_HIT} select brick_key, model_id, time_ms from hit"
ORACLES["stored_sensor_spatial"], ORACLES["stored_volume_bricks"] = ORACLES["sensor_spatial"], ORACLES["volume_bricks_unified"]
ORACLES["curve_ranges"] = ORACLES["z_ranges"]
ORACLES["lines_numbered"] = "select row_number() over (order by event_id) line_no, event_id||','||event_type raw_line from events"
ORACLES["load_sensors"] = """with e as (select event_id%10=3 bad from events), n as (select count(*) filter (not bad) ok, count(*) filter (bad) no from e)
select unnest(['loaded','failed','altitude','stored']) what, unnest([ok, no, no, ok]) n from n"""
for _f, _spec in (("point", lines.POINT_LINES), ("voxel", lines.VOXEL_LINES)):
    _name = f"geosim_{_f}_line"
    ORACLES[f"load_{_f}s"] = f"""with {line_twins.checked(_name, _spec)}, r as (select split_part(errors[1],':',1) reason from {_name}_e)
select coalesce(nullif(reason,''),'loaded') what, count(*) n from r group by 1 union all select 'failed', count(*) from r where reason<>''""" + (" union all select 'stored', count(*) from r where coalesce(reason,'')=''" if _f == "point" else "")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Points of one identifier in a time and a box."""
    return QUERIES["sim_point_unified"](spark, sf)
