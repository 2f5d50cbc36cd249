"""Registered queries of the data-preparation operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquery import line_twins
from terraquery.functions.keys import once, point_sim_id, row_key_text, trimmed
from terraquery.operators import balanced, nearby, references
from terraquery.sources import lines

NODATA = -9999.0
NEAR_M = 0.4005


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _points_by_sim(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    good = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < F.lit(float("inf"))) & (t != NODATA)
    return table(spark, sf, "geosim_point_data").select(point_sim_id(F.col("sim_id")).alias("sim_id"), "time_millis", F.when(good, t).alias("t"), "row_key")


# 1 - a few keys holding most records


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    sims = balanced.heavy_keys(table(spark, sf, "geosim_point_data").select(point_sim_id(F.col("sim_id")).alias("k"), "time_millis"), "k", ["time_millis"], 3)
    cells = balanced.heavy_keys(table(spark, sf, "chunk_task").select(F.col("z_cell").alias("k"), "task_id"), "k", ["task_id"], 3)
    return sims.select(F.lit("geosim_point_data.sim_id").alias("field_name"), F.col("k").alias("key_text")).unionByName(
        cells.select(F.lit("chunk_task.z_cell").alias("field_name"), F.col("k").cast("string").alias("key_text")))


def p1_sim_stats(spark: SparkSession, sf: str) -> DataFrame:
    df = balanced.ordered_runs(_points_by_sim(spark, sf).where("sim_id is not null"), "sim_id", "time_millis", "t")
    return df.select("sim_id", "n", F.col("first").alias("first_millis"), F.col("last").alias("last_millis"), "max_gap", F.round("mean", 4).alias("mean_t"))


def p1_cell_tasks(spark: SparkSession, sf: str) -> DataFrame:
    df = balanced.matched_counts(table(spark, sf, "chunk_task"), table(spark, sf, "geosim_point_idx_unified"), "z_cell", "task_id", "entry_id")
    return df.select("z_cell", F.col("n_left").alias("tasks"), F.col("n_right").alias("entries"), F.col("n_pairs").alias("pairs"))


# 3 - points near other points or regions


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.hits(table(spark, sf, "geosim_point_data"), table(spark, sf, "geo_region"), "row_key", ("x", "y", "z"), NEAR_M)


def p3_near_counts(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.near_counts(table(spark, sf, "geosim_point_data"), "row_key", ("x", "y", "z"), NEAR_M).select("row_key", "class_id", "n_near")


# 4 - references to records that do not exist

# Index table and the table its dk refers to; the parts of either table's keys.
INDEX_OF = {"geosim_point_idx_unified": "geosim_point_data", "volume_idx_unified": "volume_brick_data"}
PARTS_OF = {"geosim_point_data": ("key",), "volume_brick_data": ("sim", "millis", "i", "j", "k")}


def _parted(df: DataFrame, data: str) -> DataFrame:
    """``df`` with the parts of its ``key``; a part that is absent or empty is null, and so is every part of no key."""
    parts = PARTS_OF[data]
    if parts == ("key",):
        return df
    p = F.col("__parts")
    df = once(df, __parts=F.split("key", "\\|", len(parts)))
    return df.select("*", *[F.when(F.get(p, F.lit(i)) != "", F.get(p, F.lit(i))).alias(c) for i, c in enumerate(parts)], F.when(F.size(p) > 0, F.size(p)).alias("parts")).drop("__parts")


def _references(spark: SparkSession, sf: str, index: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Entries and live keys of one index table, and the columns of its key."""
    data = INDEX_OF[index]
    key = [*PARTS_OF[data], *(["parts"] if len(PARTS_OF[data]) > 1 else [])]
    refs = once(table(spark, sf, index).select(F.lit(index).alias("table_name"), "entry_id", "day_bucket", "dk"), key=row_key_text(F.col("dk"))).drop("dk")
    rows = once(table(spark, sf, data).select("row_key", "written_at"), key=row_key_text(F.col("row_key"))).where("key is not null")
    deletes = once(table(spark, sf, "row_deletes").where(trimmed(F.col("table_name")) == data), key=row_key_text(F.col("row_key"))).where("key is not null")
    return _parted(refs, data), references.live_keys(_parted(rows, data), _parted(deletes, data), key, "written_at", "deleted_at"), key


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Point keys have one part.  Voxel keys have five, and one that lacks some refers to a row that lacks the same."""
    found = [references.orphans(*_references(spark, sf, index), "same").select("table_name", "entry_id", "day_bucket") for index in INDEX_OF]
    return found[0].unionByName(found[1])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "entry_id")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, sf), "table_name", "day_bucket")


def p4_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Voxel entries under partial match: the parts a key has must match some live brick's."""
    refs, live, _ = _references(spark, sf, "volume_idx_unified")
    return references.orphans(refs, live, PARTS_OF["volume_brick_data"], "partial").select("entry_id", "null_mask")


# 5 - rows that fail to parse

LINE_TABLES = {"geosim_point_line": lines.POINT_LINES, "geosim_voxel_line": lines.VOXEL_LINES}


def _failed(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, spec in LINE_TABLES.items():
        bad = lines.failed_rows(lines.parse_lines(table(spark, sf, name), spec)).select(F.lit(name).alias("table_name"), "line_id", "reason", F.array_join("errors", ",").alias("errors"))
        out = bad if out is None else out.unionByName(bad)
    return out


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _failed(spark, sf).select("table_name", "line_id")


def p5_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _failed(spark, sf).select("table_name", "line_id", "reason", "errors")


def p5_points(spark: SparkSession, sf: str) -> DataFrame:
    return lines.valid_rows(lines.parse_lines(table(spark, sf, "geosim_point_line"), lines.POINT_LINES)).select("line_id", "sim_id", "time_iso", "time_millis", "x", "y", "z", "t", "vx", "vy", "vz")


def p5_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return lines.valid_rows(lines.parse_lines(table(spark, sf, "geosim_voxel_line"), lines.VOXEL_LINES)).select("line_id", "sim_id", "time_iso", "time_millis", "x_min", "x_max", "y_min", "y_max", "z_min", "z_max", "t", "vx", "vy", "vz")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_sim_stats, p1_cell_tasks, p3_found, p3_near_counts,
    p4_found, p4_report, p4_partial, p5_found, p5_reasons, p5_points, p5_voxels)}

_SIM = "regexp_replace(regexp_replace(sim_id,'^[\\x00-\\x20]+|[\\x00-\\x20]+$','','g'),'^([0-9]+)\\.0+$','\\1')"
_KEY = "nullif(replace(lower(regexp_replace({c},'^[\\x00-\\x20]+|[\\x00-\\x20]+$','','g')),'tile_',''),'')"
_P4 = f"""
with rows_ as (select 'geosim_point_data' tb, {_KEY.format(c='row_key')} k, written_at from geosim_point_data
  union all select 'volume_brick_data', {_KEY.format(c='row_key')}, written_at from volume_brick_data),
dels as (select trim(table_name) tb, {_KEY.format(c='row_key')} k, max(deleted_at) d from row_deletes where deleted_at is not null group by 1,2),
live as (select distinct r.tb, r.k from rows_ r left join dels on r.tb=dels.tb and r.k=dels.k where dels.d is null or r.written_at > dels.d),
refs as (select 'geosim_point_idx_unified' table_name, 'geosim_point_data' tb, entry_id, day_bucket, {_KEY.format(c='dk')} k from geosim_point_idx_unified
  union all select 'volume_idx_unified', 'volume_brick_data', entry_id, day_bucket, {_KEY.format(c='dk')} from volume_idx_unified),
orph as (select * from refs where k is not null and not exists (select 1 from live where live.tb=refs.tb and live.k=refs.k))
"""
_P3_POINTS = """with pts as (select distinct row_key k, x, y, z from geosim_point_data
  where x is not null and y is not null and z is not null and isfinite(x) and isfinite(y) and isfinite(z)),
cells as (select k,x,y,z, cast(floor(x/0.5) as bigint) cx, cast(floor(y/0.5) as bigint) cy, cast(floor(z/0.5) as bigint) cz from pts),
near_ as (select distinct a.k key_a, b.k key_b from cells a,
  (select *, cx+dx nx, cy+dy ny, cz+dz nz from cells, (select unnest([-1,0,1]) dx), (select unnest([-1,0,1]) dy), (select unnest([-1,0,1]) dz)) b
  where a.cx=b.nx and a.cy=b.ny and a.cz=b.nz and a.k<b.k
    and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.4005*0.4005)"""

ORACLES = {
    "p5_found": line_twins.failed(LINE_TABLES, "table_name, line_id"),
    "p5_reasons": line_twins.failed(LINE_TABLES, "table_name, line_id, split_part(errors[1],':',1) reason, array_to_string(errors,',') errors"),
    "p5_points": line_twins.typed("geosim_point_line", lines.POINT_LINES),
    "p5_voxels": line_twins.typed("geosim_voxel_line", lines.VOXEL_LINES),
    "p1_found": f"""with s as (select {_SIM} k, count(*) n, sum(count(*)) over () tot from geosim_point_data group by 1),
 c as (select z_cell k, count(*) n, sum(count(*)) over () tot from chunk_task group by 1)
select 'geosim_point_data.sim_id' field_name, k key_text from s where k is not null and n*100>=tot*3
union all select 'chunk_task.z_cell', cast(k as varchar) from c where k is not null and n*100>=tot*3""",
    "p1_sim_stats": f"""with p as (select {_SIM} sim_id, time_millis, case when t is not null and isfinite(t) and t<>-9999 then t end t from geosim_point_data where sim_id is not null),
 g as (select sim_id, time_millis, t, time_millis - lag(time_millis) over (partition by sim_id, time_millis is null order by time_millis) gap from p)
select sim_id, count(*) n, min(time_millis) first_millis, max(time_millis) last_millis, coalesce(max(gap),0) max_gap, round(avg(t),4) mean_t from g group by 1""",
    "p1_cell_tasks": """select coalesce(a.z_cell,b.z_cell) z_cell, coalesce(tasks,0) tasks, coalesce(entries,0) entries, coalesce(tasks,0)*coalesce(entries,0) pairs
from (select z_cell, count(*) tasks from chunk_task where z_cell is not null group by 1) a
full join (select z_cell, count(*) entries from geosim_point_idx_unified where z_cell is not null group by 1) b on a.z_cell=b.z_cell""",
    "p3_found": _P3_POINTS + """,
edges as (select region_id, z_min, z_max, unnest(ring_x) x1, unnest(ring_y) y1, unnest(list_concat(ring_x[2:],ring_x[:1])) x2, unnest(list_concat(ring_y[2:],ring_y[:1])) y2 from geo_region),
tested as (select k, region_id, z_min, z_max, z,
   sum(case when (y1<=y)<>(y2<=y) and (((x2-x1)*(y-y1)-(y2-y1)*(x-x1))>0)=(y2>y1) then 1 else 0 end) crossings,
   max(case when (x2-x1)*(y-y1)-(y2-y1)*(x-x1)=0 and x between least(x1,x2) and greatest(x1,x2) and y between least(y1,y2) and greatest(y1,y2) then 1 else 0 end) on_border
  from pts, edges where z between z_min and z_max group by all)
select 'near' hit_kind, key_a, key_b from near_
union all select distinct 'inside', k, region_id from tested where crossings%2=1 or on_border=1""",
    "p3_near_counts": _P3_POINTS + """,
cls as (select k, min(k) over (partition by x,y,z) class_id from pts),
deg as (select k, count(*) n from (select key_a k from near_ union all select key_b from near_) group by 1)
select cls.k row_key, class_id, coalesce(n,0) n_near from cls left join deg on cls.k=deg.k""",
    "p4_found": _P4 + "select table_name, entry_id from orph",
    "p4_report": _P4 + "select table_name, cast(day_bucket//100 as int) as \"month\", count(*) orphans from orph group by 1,2",
    "p4_partial": _P4 + """, v as (select entry_id, k, split_part(k,'|',1) a, split_part(k,'|',2) b, split_part(k,'|',3) c, split_part(k,'|',4) d, split_part(k,'|',5) e from refs where tb='volume_brick_data' and k is not null),
 w as (select split_part(k,'|',1) a, split_part(k,'|',2) b, split_part(k,'|',3) c, split_part(k,'|',4) d, split_part(k,'|',5) e from live where tb='volume_brick_data')
select entry_id, cast(case when e='' then 16 else 0 end as int) null_mask from v
where not exists (select 1 from w where w.a=v.a and w.b=v.b and w.c=v.c and w.d=v.d and (v.e='' or w.e=v.e))""",
}
