"""Stored facts: what a scan skips, that nothing is lost by it, loading of split files, and reasons of failure."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraquery import cli
from terraquery.functions import codec
from terraquery.functions import codes as C
from terraquery.operators import engines as E
from terraquery.operators import volume as V
from terraquery.plans import predicates as P
from terraquery.sources import catalog, jobs, records


def points(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(f"d{i}", str(i % 3), rng.randint(0, 400) * 86_400_000, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0, 9), rng.uniform(270, 400), rng.uniform(-1e-3, 1e-3), 0.0, 0.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "dk string, sim_id string, time_ms long, x double, y double, z double, t double, vx double, vy double, vz double")


TIME, BOX = P.TimeRange(40 * 86_400_000, 200 * 86_400_000), P.Box(20, 30, 1, 45, 60, 5)


def test_scan_skips_and_loses_nothing(spark, tmp_path):
    rows, df = points(spark)
    bounds = E.point_bounds(df)
    root = str(tmp_path)
    for layout in catalog.layouts("point", ["temp_unified", "vel_unified"]):
        catalog.write_facts(E.point_facts(df, bounds), root, "point", "d", layout, row_group=1 << 14)
    catalog.write_meta(spark, jobs.meta_path(root, "point", "d"), bounds=bounds)
    inside = {r[0] for r in rows if TIME.start <= r[2] <= TIME.end and all(a <= v <= b for v, (a, b) in zip(r[3:6], map(BOX.axis, range(3))))}
    cases = {"unified": ({"sim_id": "1"}, lambda r: r[1] == "1"), "temp_unified": ({"temp": P.Range(300, 320)}, lambda r: 300 <= r[6] <= 320), "vel_unified": ({"vel": (P.Range(0, 1e-4), P.Range(0, 0), P.Range(0, 0))}, lambda r: 0 <= r[7] <= 1e-4)}
    for layout, (attr, test) in cases.items():
        facts, kept = jobs.facts(spark, root, "point", "d", layout)
        for engine in E.ENGINES:
            for level in (5, 9, 19):
                got = [r[0] for r in E.point_query(facts, kept, TIME, BOX, engine=engine, level=level, **attr).select("dk").collect()]
                assert len(got) == len(set(got)) and set(got) == {r[0] for r in rows if r[0] in inside and test(r)}
        plan = E.point_query(facts, kept, TIME, BOX, **attr)._jdf.queryExecution().optimizedPlan().toString()
        assert all(f"({c}#" in plan for c in ("ix", "iy", "iz", "z_code", "month")) and "shiftright" not in plan
    missing, _ = jobs.facts(spark, root, "point", "d", "other")
    assert missing.count() == len(rows)


def test_only_facts_that_are_asked_for_are_written(spark, sf, tmp_path):
    from pathlib import Path

    from terraquery import engine_queries as Q
    from terraquery.session import shared_dir

    (tmp_path / "t").symlink_to(sf)  # another path: nothing is kept for it yet
    shared = Path(shared_dir(spark).removeprefix("file://"))
    there = set(shared.glob("stored-*"))
    assert Q.QUERIES["stored_sim_voxel_vel"](spark, str(tmp_path / "t")).count() >= 0
    (root,) = set(shared.glob("stored-*")) - there
    assert {str(p.relative_to(root)) for p in root.glob("*/*/*")} == {"voxel/test/facts_vel_unified", "voxel/test/meta"}


def test_slices_of_months_are_whole(spark, tmp_path):
    rows, df = points(spark)
    df = df.withColumn("time_ms", F.expr("if(dk in ('d1', 'd2'), null, time_ms)"))
    facts = E.point_facts(df, E.point_bounds(df)).cache()
    for most, rows_ in ((1, 10), (3, 10), (12, 1000), (40, 10)):
        cuts = catalog.month_cuts(facts, rows_, most)
        assert cuts == sorted(set(cuts)) and len(cuts) < most and (len(cuts) >= 1) == (most > 1)
        got = spark.read.parquet(catalog.write_facts(facts, str(tmp_path), "point", "d", cuts=cuts))
        assert sorted(r["dk"] for r in got.select("dk").collect()) == sorted(r[0] for r in rows)
    assert catalog.month_cuts(facts.where("false"), 10, 12) == []


def test_limit_of_cells_is_that_of_the_list(spark):
    _, df = points(spark, 400)
    bounds = E.point_bounds(df)
    facts = E.point_facts(df, bounds).cache()
    lo, hi = (tuple(bounds.index_py(BOX.axis(i)[e], a) for i, a in enumerate("xyz")) for e in (0, 1))
    from terraquery.plans import ranges as R

    for most in (1, 7, 100, 100_000):
        listed = R.cells(lo, hi, 4, most)
        want = {r["dk"] for r in facts.where(C.block_code(F.col("ix"), F.col("iy"), F.col("iz"), 4).isin(listed)).collect()}
        assert {r["dk"] for r in facts.where(P.world_cells(F.col("ix"), F.col("iy"), F.col("iz"), lo, hi, 4, most)).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.integers(-40, 40), st.integers(-40, 40), st.integers(1, 17))
def test_blocks_as_ranges(index, block, size):
    assert (C.block_of_py(index, size) >= block) == (index >= C.block_from(block, size))
    assert (C.block_of_py(index, size) <= block) == (index <= C.block_to(block, size))


def test_voxel_corners_that_can_reach_a_box(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        x, y, z = (rng.randint(-20, 20) * 10.0 + rng.choice([0, 0, 3.0]) for _ in range(3))
        rows.append((f"k{i}", "1/2", 0, x, x + rng.choice([10.0, 25.0]), y, y + 10.0, z, z + 10.0, 300.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "brick_key string, sim_id string, time_ms long, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, t double, vx double, vy double, vz double")
    grid = E.voxel_grid(df, "brick_key").grid
    assert grid.extent == (25.0, 10.0, 10.0)
    facts = E.voxel_facts(df, grid).cache()
    for box in (P.Box(0, 0, 0, 1, 1, 1), P.Box(-55, -30, -70, 14, 31, 2), P.Box(20, 20, 20, 20, 20, 20), P.Box(400, 0, 0, 500, 1, 1)):
        want = {r[0] for r in rows if r[3] <= box.x1 and r[4] >= box.x0 and r[5] <= box.y1 and r[6] >= box.y0 and r[7] <= box.z1 and r[8] >= box.z0}
        for engine in E.ENGINES:
            assert {r[0] for r in E.voxel_query(facts, grid, P.TimeRange(0, 1), box, sim_id="1/2", engine=engine).select("brick_key").collect()} == want


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_line_numbers_over_splits(spark, tmp_path, split):
    for n, rows in (("a.csv", 120), ("b.csv", 1), ("c.csv", 57)):
        (tmp_path / n).write_text("".join(f"{n},{i},é{'x' * (i % 40)}\n" for i in range(1, rows + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = records.read_numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 178 and all(r["raw_line"].startswith(f"{r['file_name'].rsplit('/', 1)[1]},{r['line_no']},") for r in got)


def test_reasons_of_failed_models(spark, tmp_path):
    good = codec.encode_one([1.0, 2.0])
    head = "m\t2025-11-05T17:00:53Z\tt\t0\t0\t0\t1\t1\t1\t1\t1\t2\t"
    lines = ["model_id\ttime", head + good, head + good[:-6], head + codec.encode_one([1.0]), head + "", "short", head.replace("2025", "x") + good]
    (tmp_path / "m.tsv").write_text("\n".join(lines))
    out = jobs.load_volumes(spark, str(tmp_path / "m.tsv"), str(tmp_path / "root"), "d")
    assert (out["lines"], out["loaded"], out["failed"], out["bricks"]) == (6, 1, 5, 1)
    assert out["reasons"] == {"payload": 3, "columns": 1, "time": 1} and out["types"] == {"t": 1}


def test_sensor_reasons(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,id,lon,lat,alt,type\n2024-01-01T00:00:00,a,112,22,5,t\n2024-01-01T00:00:00,a,x,22,5,t\n\nx\n")
    out = jobs.load_sensors(spark, str(tmp_path / "s.csv"), str(tmp_path / "root"), "d")
    assert out == {"lines": 4, "loaded": 1, "failed": 3, "reasons": {"columns": 1, "longitude": 1, "time": 1}}


def test_metadata_of_some_models(spark):
    bricks = spark.createDataFrame([("a", 1, "b1"), ("a", 2, "b2"), ("c", 1, "b3"), (None, None, "b4")], "model_id string, time_ms long, brick_key string")
    meta = spark.createDataFrame([("a", 1, 4), (None, None, 9)], "model_id string, time_ms long, nx int")
    assert {(r["brick_key"], r["nx"], r["skipped"]) for r in V.with_meta(bricks, meta).collect()} == {("b1", 4, False), ("b2", None, True), ("b3", None, True), ("b4", None, True)}


def test_headers_and_forms_of_exports(spark, tmp_path, capsys):
    root = str(tmp_path / "root")
    (tmp_path / "p.tsv").write_text("sim_id\ttime\tx\ty\tz\tT\tP\tvx\tvy\tvz\n" + "".join(f"1\t2024-01-01T00:00:00\t{i}\t{i}\t{i}\t300\t-\t0\t0\t0\n" for i in range(9)))

    def run(*args):
        cli.main([args[0], "--root", root, "--dataset", "d", *map(str, args[1:])], spark)
        return capsys.readouterr().out

    assert "'loaded': 9" in run("load", "point", tmp_path / "p.tsv", "--indexes", "unified,temp_unified")
    assert catalog.exists(spark, f"{root}/point/d/facts_temp_unified") and run("tables").strip() == f"{root}/point/d"
    where = ("--bbox", 0, 0, 0, 4, 4, 4, "--time-range", "2024-01-01", "2024-01-02")
    run("sim-point", "--sim-id", 1, *where, "--format", "both", "--with-header", "--output-dir", tmp_path / "o")
    csv, made = (sorted(r[0] for r in spark.read.text(str(tmp_path / "o" / k)).collect()) for k in ("csv", "json"))
    assert "sim_id,time,x,y,z,T,P,vx,vy,vz" in csv and "1,2024-01-01T00:00:00,4,4,4,300,-,0,0,0" in csv
    assert len(made) == 5 and made[0].startswith('{"sim_id":"1","time":"2024-01-01T00:00:00","x":"0"')
    run("sim-point-temp", "--temp", 299, 301, *where, "--format", "txt", "--output-dir", tmp_path / "t")
    assert spark.read.text(str(tmp_path / "t")).count() == 5
    step = C.VOLUME_STEP
    line = "\t".join(["m", "2024-01-01T00:00:00Z", "t", "0", "0", "0", str(2 * step[0]), str(2 * step[1]), str(2 * step[2]), "2", "2", "2", codec.encode_one([1.0] * 8)])
    (tmp_path / "m.tsv").write_text(line + "\n")
    run("load", "volume", tmp_path / "m.tsv")
    run("volume", "--model-type", "t", *where, "--output-dir", tmp_path / "bricks")
    row = spark.read.csv(str(tmp_path / "bricks"), header=True).first()
    assert len(row) == 17 and (codec.decode_one(row["payload_b64"], V.CELLS) == 1).sum() == 8
    run("volume", "--model-type", "t", *where, "--nodata", -9999, "--output-dir", tmp_path / "mask")
    assert spark.read.text(str(tmp_path / "mask_summary")).first()[0] == "m, 2024-01-01T00:00:00Z, 8, 4, 0.5000, 0"  # the upper centres are above the box
    (tmp_path / "s.csv").write_text("2024-01-01T00:00:00,a,112,22,5,t\n")
    run("load", "sensor", tmp_path / "s.csv")
    run("spatial", "--format", "both", "--output-dir", tmp_path / "s")
    assert spark.read.json(str(tmp_path / "s" / "json")).first()["time"] == "2024-01-01T00:00:00" and spark.read.json(str(tmp_path / "s_summary")).first()["total_count"] == 1
