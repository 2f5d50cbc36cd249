"""Golden vectors, properties and equivalence of the engines; volumes; catalogue; streaming."""

import base64
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraquery.functions import codec
from terraquery.functions import codes as C
from terraquery.operators import engines as E
from terraquery.operators import volume as V
from terraquery.plans import predicates as P
from terraquery.plans import ranges as R
from terraquery.sources import catalog, exports, lines, records
from terraquery.streaming import ingest


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_golden_codes(spark):
    for p, idx, z, b19, b9 in (
        ((114.088821, 23.266778, 210.495), (857487, 1188443, 441439), 2553966883333762943, 2553966883333762880, 2553966843316404224),
        ((114.353816, 23.977158, 102.9519), (913060, 1560887, 215905), 2519619587972243670, 2519619587972243648, 2519619543173693440),
    ):
        i = C.world_index(*map(F.lit, p))
        r = one(spark, x=i[0], y=i[1], z=i[2], m=C.morton(*i), b19=C.block_code(*i, 19), b9=C.block_code(*i, 9))
        assert tuple(r) == (*idx, z, b19, b9)
        assert tuple(C.axis_index_py(v, *C.WORLD[a]) for v, a in zip(p, "xyz")) == idx and C.morton_py(*idx) == z
    box = R.world_box((114.0, 23.2, 200), (114.2, 23.3, 220))
    assert [R.cell_count(*box, n) for n in (9, 12, 19)] == [1848, 716456, 1441443267656]
    assert len(R.cells(*box, 9)) == 1848 and len(R.cells(*box, 12, 1000)) == 1000


def test_golden_hashes_and_buckets(spark):
    for s, a, b in (("SENS_026", 842471709, -1305011939), ("channelized", 563795190, 563795190), ("1/2", 1933914273, 1933914273), ("2", 923577301, 923577301)):
        assert tuple(one(spark, a=C.attr_hash(F.lit(s)), b=C.fnv1a32(F.lit(s)))) == (a, b)
    for s in ("ü", "汉字", "a😀b", ""):
        h = 2166136261
        units = s.encode("utf-16-be")
        for u in struct.unpack(f">{len(units) // 2}H", units):
            h = (h ^ u) * 16777619 & 0xFFFFFFFF
        assert one(spark, a=C.attr_hash(F.lit(s)))[0] == h & 0x7FFFFFFF
    for t, want in ((0.0, 0), (1.9, 0), (2.0, 1), (300.15, 150), (-0.5, 0), (-1.0, -1), (-1.5, -1), (-2.0, -1), (-2.9, -1), (-3.0, -2), (-4.0, -2)):
        assert one(spark, b=C.temp_bucket(F.lit(t)))[0] == C.temp_bucket_py(t) == want
    for v, b in ((-1e-4, -1), (-1e-5, -1), (0.0, 0), (1e-5, 0), (2.5e-4, 2)):
        r = one(spark, b=C.vel_bucket(F.lit(v), 1e-4), f=C.flip_sign(C.vel_bucket(F.lit(v), 1e-4)))
        assert r["b"] == b and r["f"] == {-1: 2147483647, 0: -2147483648, 2: -2147483646}[b]
    ms = 1762362053000
    assert tuple(one(spark, d=C.day_bucket(F.lit(ms)), t=C.time_of_day(F.lit(ms)), i=C.format_instant(F.lit(ms)))) == (20251105, 61253000, "2025-11-05T17:00:53Z")
    assert tuple(one(spark, q=C.grid_index(F.lit(-2.5), 0.0, 1.0), b=C.block_of(F.lit(-7), 2))) == (-2, -3)
    assert [C.volume_brick_py(v, i) for i, v in enumerate((113.25, 22.25, 0.0))] == [1812, 356, 0] and C.morton_py(1812, 356, 0) == 0x4B0910C0


def test_nulls_and_nan_of_codes(spark):
    n = F.lit(None).cast("double")
    nan = F.lit(float("nan"))
    b = C.Bounds(0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    assert tuple(one(spark, a=C.axis_index(n, 0.0, 1.0), b=C.axis_index(nan, 0.0, 1.0), c=b.index(n, "x"), d=b.index(nan, "x"), e=b.index(F.lit(3.0), "y"), f=b.index(F.lit(9.0), "x"))) == (None, 0, None, 0, 0, C.axis_index_py(120.0, 110.0, 120.0))


@settings(max_examples=60, deadline=None)
@given(st.tuples(*[st.integers(0, C.MAX_INDEX)] * 3), st.tuples(*[st.integers(0, C.MAX_INDEX)] * 3), st.tuples(*[st.integers(0, C.MAX_INDEX)] * 3), st.booleans())
def test_ranges_cover(a, b, p, curve):
    lo, hi = tuple(map(min, a, b)), tuple(map(max, a, b))
    inside = tuple(min(max(v, x), y) for v, x, y in zip(p, lo, hi))
    got = R.code_ranges(lo, hi, 64, curve)
    code = 0
    for i in range(C.BITS - 1, -1, -1):
        x, y, z = (v >> i & 1 for v in inside)
        code = code * 8 + (C.CURVE_ORDER[x * 4 + y * 2 + z] if curve else x + 2 * y + 4 * z)
    assert any(x <= code <= y for x, y in got) and all(x[1] + 1 < y[0] for x, y in zip(got, got[1:]))


def test_key_codec(spark):
    k = C.unified_key(3, F.lit(-5), F.lit(2553966883333762943), F.lit(20240101), F.lit(86399999), F.lit("a_b|ü"))
    p = one(spark, p=C.unified_key_parts(k))["p"]
    assert tuple(p) == (3, -5, 2553966883333762943, 20240101, 86399999, "a_b|ü")


def test_reversed_range_is_empty_and_unknown_engine(spark):
    df = spark.createDataFrame([("a", "1", 0, 1.0, 1.0, 1.0, 300.0, 0.0, 0.0, 0.0)], "dk string, sim_id string, time_ms long, x double, y double, z double, t double, vx double, vy double, vz double")
    bounds = E.point_bounds(df)
    f = E.point_facts(df, bounds)
    time, box = P.TimeRange(0, 1), P.Box(0, 0, 0, 2, 2, 2)
    for e in E.ENGINES:
        assert E.point_query(f, bounds, time, box, temp=P.Range(299, 301), engine=e).count() == 1
        assert E.point_query(f, bounds, time, box, temp=P.Range(301, 299), engine=e).count() == 0
    with pytest.raises(ValueError):
        E.point_query(f, bounds, time, box, engine="other")
    assert E.point_bounds(df.where("false")) is None


def test_nan_voxel_overlaps_nothing(spark):
    df = spark.createDataFrame([("n", float("nan"), 1.0), ("a", 0.0, 1.0), ("u", None, 1.0)], "k string, lo double, hi double")
    box = P.Box(0, 0, 0, 5, 5, 5)
    assert [r["k"] for r in df.where(box.intersects("lo", "hi", "lo", "hi", "lo", "hi")).collect()] == ["a"]


def test_codec_and_tiles(spark):
    assert list(codec.decode_one("eAFjYGiwZ2BgcAAiBwYbmWMAEPUCng==")) == [1.0, 2.0, 3.0, -9999.0]
    good = codec.encode_one([1.0, 2.0])
    for bad in (None, "", "%%", good[:-6], base64.b64encode(zlib.compress(b"abc")).decode()):
        assert codec.decode_one(bad, 2) is None
    assert codec.decode_one(good, 3) is None
    nx, ny, nz = 20, 18, 10
    vals = [float(i % 97) for i in range(nx * ny * nz)]
    step = C.VOLUME_STEP
    row = ("m", 1762300800000, "t", 113.25, 22.25, 0.0, 113.25 + nx * step[0], 22.25 + ny * step[1], nz * step[2], nx, ny, nz, vals)
    df = spark.createDataFrame([row, ("e", *row[1:12], None)], "model_id string, time_ms long, model_type string, lon_min double, lat_min double, z_min double, lon_max double, lat_max double, z_max double, nx int, ny int, nz int, vals array<float>")
    bricks = V.tile(df)
    assert bricks.count() == 8
    back = V.reassemble(bricks.unionByName(bricks)).first()
    assert list(back["vals"]) == vals and back["missing"] == 0
    assert V.reassemble(bricks.where("tile_i = 0")).first()["missing"] == 4
    facts = V.brick_facts(bricks)
    assert facts.where("indexed").count() == 8
    box = P.Box(113.25, 22.25, 0, 113.25 + 5 * step[0], 22.25 + 3 * step[1], 2 * step[2])
    hits = V.volume_query(facts, "t", P.TimeRange(0, 2 * 10**12), box)
    assert V.reassemble(hits, box).first()["kept"] == 30 == V.masked_cells(hits, box).first()["kept"]
    assert V.coverage(facts, hits).first()["ratio"] == hits.count() / 8
    assert V.reassemble(hits.where("false"), box).count() == 0


def test_records(spark):
    rows = ["model_id\ttime", "m\t2025-11-05T17:00:53Z\tt\t1\t2\t3\t4\t5\t6\t1\t1\t2\t" + codec.encode_one([1.0, 2.0]), "m\tx\tt\t1\t2\t3\t4\t5\t6\t1\t1\t2\tp", "m\t2025-11-05T17:00:53Z\tt\t1\t2\t3\t4\t5\t6\t0\t1\t2\tp", "short", "", None]
    p = records.parse_volumes(spark.createDataFrame([(r,) for r in rows], "raw_line string"))
    assert sorted(str(r["error"]) for r in p.collect()) == ["None", "columns", "nx", "time"]
    assert tuple(records.load_stats(p).first()) == (4, 1, 3) and records.first_failures(p, 2).count() == 2 and records.models_by_type(p).count() == 1
    assert list(V.decode(p.where("error is null")).first()["vals"]) == [1.0, 2.0]
    s = records.parse_sensors(spark.createDataFrame([("2024-01-01T00:00:00,a,1,2,3,t",), ("time,id,lon,lat,alt,type",), ("2024-01-01T00:00:00,a,1,2,3",)], "raw_line string"))
    assert s.count() == 1


def test_exports_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([('1\t"q"\t3',)], "raw_line string")
    assert exports.raw_csv(df).first()[0] == '1,"q",3' and exports.raw_line_json(df).first()[0] == '{"raw_line":"1\\t\\"q\\"\\t3"}'
    assert exports.raw_json(df, ["a", "b", "c", "d"]).first()[0] == '{"a":"1","b":"\\"q\\"","c":"3"}'
    assert exports.file_name("a b/c") == "a_b_c"
    exports.write(df, str(tmp_path / "o"), "both")
    assert spark.read.json(str(tmp_path / "o/json")).count() == 1 and spark.read.csv(str(tmp_path / "o/csv"), header=True).count() == 1
    root = str(tmp_path / "root")
    facts = spark.range(10).selectExpr("id", "20240101 + id * 100 as day_bucket", "id as ix", "id as iy", "id as iz", "'a' as sim_id")
    for d in ("1", "a_1"):
        catalog.write_facts(facts, root, "point", d)
        catalog.write_meta(spark, f"{root}/point/{d}/meta", bounds=C.Bounds(0, 1, 0, 1, 0, 1), grid=C.Grid((0.0,) * 3, (1.0,) * 3, (0, 0, 0)))
    plan = spark.read.parquet(catalog.path_of(root, "point", "1")).where("month = 202403")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(month" in plan._jdf.queryExecution().toString()
    meta = catalog.read_meta(spark, f"{root}/point/1/meta")
    assert meta["bounds"].x_max == 1 and meta["grid"].step == (1.0, 1.0, 1.0)
    assert catalog.drop_dataset(spark, root, "1") == [f"{root}/point/1"] and catalog.tables(spark, root, "1")
    catalog.drop_dataset(spark, root, "1", force=True)
    assert not catalog.tables(spark, root, "1") and catalog.tables(spark, root, "a_1")
    with pytest.raises(ValueError):
        catalog.path_of(root, "point", "../x")
    assert catalog.index_sets("point", ["nonsense"]) == ["incremental", "unified"] and catalog.split_points("hex", 4) == ["4000", "8000", "c000"]
    with pytest.raises(ValueError):
        catalog.index_sets("voxel", ["nonsense"])
    assert catalog.diagnose(spark, catalog.path_of(root, "point", "a_1"), "id", 3).count() == 3


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    good = "7,2024-01-01T00:00:00,1,2,3,4,x,5,6,7"
    spark.createDataFrame([(1, "f", 1, good), (2, "f", 2, "bad"), (3, "f", 3, None)], ingest.LINES).write.parquet(src)
    ingest.load(ingest.line_stream(spark, src), lines.POINT_LINES, str(tmp_path / "facts"), str(tmp_path / "fail"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 1 and spark.read.parquet(str(tmp_path / "fail")).first()["reason"] == "columns"
    stream = spark.readStream.schema("sim_id string, time_millis long, t double").parquet(src)
    assert stream.isStreaming and ingest.windowed_counts(stream).isStreaming


def test_boxes_of_all_parts(spark, sf):
    from terraquery.engine_queries import boxes_all
    from terraquery.sources import views

    pts = views.points(spark, sf).select("x", "y", "z").toPandas()
    want = {}
    for (p,) in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect():
        x, y = 4144000 + p * 9 % 980, 647000 + p * 8 % 970
        if n := int((pts["x"].between(x, x + 20) & pts["y"].between(y, y + 30) & pts["z"].between(-2700, -2500)).sum()):
            want[p] = n
    assert max(want) > 111 and {r["box_id"]: r["points"] for r in boxes_all(spark, sf).collect()} == want
