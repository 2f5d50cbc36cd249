"""Counts of points in many boxes: against brute force, in both ways of counting, in tiles and parts."""

import numpy as np
import pytest

from terraquery import engine_queries
from terraquery.operators import boxes as B
from terraquery.operators import engines as E


def brute(xyz, box):
    return [int(((xyz >= b[:3]) & (xyz <= b[3:])).all(axis=1).sum()) for b in box]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_both_ways_count_alike(n):
    rng = np.random.default_rng(n)
    for xyz in (rng.random((n, 3)), rng.integers(0, 7, (n, 3)).astype("float64"), np.zeros((n, 3)), np.where(rng.random((n, 3)) < 0.1, np.inf, rng.random((n, 3)))):
        ends = np.sort(np.stack([rng.choice(np.append(xyz.ravel(), [-1, 0.5, 9]), (200, 3)) for _ in range(2)]), axis=0)
        box = np.concatenate([ends[0], ends[1]], axis=1)
        want = brute(xyz, box)
        assert B._by_ranks(xyz)(box).tolist() == want and B._by_sums(xyz, 1 << 40)(box).tolist() == want and B.counter(xyz)(box).tolist() == want
    assert B._by_sums(rng.random((n, 3)), n**3 - 1) is None


@pytest.mark.parametrize("tile_rows", [20, 100_000])
def test_boxes_over_tiles_and_parts(spark, tile_rows, monkeypatch):
    monkeypatch.setattr(B, "PACK_ROWS", 7)
    monkeypatch.setattr(B, "BOXES", 50)
    rng = np.random.default_rng(1)
    xyz = np.round(rng.random((3000, 3)) * 100, 1)
    xyz[:1000] = (50, 50, 50)  # more than the parts of a tile hold
    lo = np.round(rng.random((300, 3)) * 100 - 5)
    box = np.concatenate([lo, lo + rng.integers(-1, 40, (300, 3))], axis=1)
    box[0] = (-1e9, -1e9, -1e9, 1e9, 1e9, 1e9)
    points = spark.createDataFrame([*map(tuple, xyz.tolist()), (None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "x double, y double, z double").repartition(3)
    ids = [None if i == 7 else i // 2 for i in range(300)]  # two boxes of an identifier add up
    boxes = spark.createDataFrame([(i, *b) for i, b in zip(ids, box.tolist())] + [(999, None, 0.0, 0.0, 1.0, 1.0, 1.0)], "box_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    want = {}
    for i, n in zip(ids, brute(xyz, box)):
        want[i] = want.get(i, 0) + n
    got = B.count_in_boxes(points, boxes, tile_rows).collect()
    assert len(got) == len({r["box_id"] for r in got}) and {r["box_id"]: r["points"] for r in got} == {i: n for i, n in want.items() if n}
    assert B.count_in_boxes(points.where("false"), boxes).count() == 0 == B.count_in_boxes(points, boxes.where("false")).count()


def test_pairs_are_counted_not_listed(spark, sf):
    """Every part has a box and the points are spread alike, so pairs grow as parts times points."""
    df = engine_queries.boxes_all(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    from pyspark.sql import functions as F
    from terraquery.sources import views as S

    p = S.table(spark, sf, "part").selectExpr("p_partkey box_id", "4144000d + p_partkey * 9 % 980 x0", "647000d + p_partkey * 8 % 970 y0", "-2700d z0", "4144020d + p_partkey * 9 % 980 x1", "647030d + p_partkey * 8 % 970 y1", "-2500d z1")
    listed = E.in_boxes(S.points(spark, sf), p, 25.0).groupBy("box_id").agg(F.count("*").alias("points"))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in listed.collect()}
