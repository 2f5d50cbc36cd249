"""Proximity and containment against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraquery.operators import nearby as N

XYZ = ("x", "y", "z")


def points(n=600, seed=8):
    rng = random.Random(seed)
    base = [(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-1, 1)) for _ in range(60)]
    out = []
    for i in range(n):
        b = rng.choice(base)
        out.append((f"p{i}", b[0] + rng.choice([0, 0.1, 0.4, rng.uniform(-1, 1)]), b[1], b[2] + rng.choice([0, 0.2])))
    out += [out[0], out[1], ("n1", None, 1.0, 1.0), ("n2", float("nan"), 1.0, 1.0), ("n3", float("inf"), 1.0, 1.0), (None, 0.0, 0.0, 0.0), ("far", 1e15, -1e15, 0.0), ("far2", 1e15, -1e15, 0.0)]
    return out


def brute(rows, r):
    good = sorted({p for p in rows if p[0] and None not in p and all(np.isfinite(p[1:]))})
    return {(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1:] if a[0] != b[0] and sum((u - v) ** 2 for u, v in zip(a[1:], b[1:])) < r * r}


@pytest.mark.parametrize("r,tile_rows", [(0.05, 20_000), (0.35, 40), (0.9, 40), (0.9, 7)])
def test_near(spark, r, tile_rows):
    rows = points()
    df = spark.createDataFrame([(*p, "clash") for p in rows], "id string, x double, y double, z double, block string")
    want = brute(rows, r)
    got = [(a, b) for a, b in N.near_pairs(df, "id", XYZ, r, tile_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {x["id"]: (x["class_id"], x["n_near"]) for x in N.near_counts(df, "id", XYZ, r, tile_rows).collect()}
    deg, least = {}, {}
    for a, b in want:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    good = [p for p in rows if p[0] and p[0] not in ("n1", "n2", "n3")]
    for p in good:
        least[p[1:]] = min(least.get(p[1:], p[0]), p[0])
    assert counts == {p[0]: (least[p[1:]], deg.get(p[0], 0)) for p in good}


def test_hot_position_and_hot_spot(spark, monkeypatch):
    """A third of all rows at one position and a third in one small place: their tiles are spread over parts."""
    monkeypatch.setattr(N, "PART_TILES", 2)
    rng = random.Random(5)
    rows = [(f"a{i}", 7.0, 7.0, 1.0) for i in range(300)] + [(f"b{i}", 7.0 + rng.random() / 9, 7.2, 1.0 + rng.random()) for i in range(300)]
    rows += [(f"c{i}", rng.uniform(0, 90), rng.uniform(0, 90), 0.0) for i in range(300)] + [("same", 50.0, 50.0, 0.0)] * 500
    tiles = N.Tiles.cut(np.array([p[1] for p in rows]), np.array([p[2] for p in rows]), len(rows), 30)
    assert tiles.parts.max() > 2 and [tiles.block(i)[0] for i in (0, int(tiles.blocks[-1]) - 1)] == [0, len(tiles.parts) - 1]
    df = spark.createDataFrame(rows, "id string, x double, y double, z double")
    want = brute(rows, 0.3)
    got = [tuple(r) for r in N.near_pairs(df, "id", XYZ, 0.3, 30).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    deg = {}
    for a, b in want:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    out = N.near_counts(df, "id", XYZ, 0.3, 30).collect()
    assert {r["id"]: r["n_near"] for r in out} == {p[0]: deg.get(p[0], 0) for p in rows} and len(out) == 901
    assert {r["class_id"] for r in out if r["id"].startswith("a")} == {"a0"}


def ring_brute(ring, x, y):
    n, inside = len(ring), False
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 <= y) != (y2 <= y) and (cross > 0) == (y2 > y1):
            inside = not inside
    return inside


def star(rng, n):
    a = sorted(rng.uniform(0, 6.28) for _ in range(n))
    c = rng.randint(-6, 6), rng.randint(-6, 6)
    return [(round(c[0] + rng.uniform(1, 6) * np.cos(t)), round(c[1] + rng.uniform(1, 6) * np.sin(t))) for t in a]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_slabs(seed):
    rng = random.Random(seed)
    regions = [(f"r{i}", *map(list, zip(*star(rng, rng.randint(3, 9)))), -1.0, 1.0) for i in range(4)]
    regions = [r for r in regions if len(r[1]) - ((r[1][0], r[2][0]) == (r[1][-1], r[2][-1])) > 2]  # fewer vertices are no region
    g = np.array([(x / 2, y / 2) for x in range(-26, 27) for y in range(-26, 27)])
    want = {(i, name) for name, xs, ys, *_ in regions for i, (x, y) in enumerate(g) if ring_brute(list(zip(xs, ys)), x, y)}
    for lo, hi in ((-13, 13), (-3, 4)):  # the whole range, and one that only some edges cross
        mine = np.flatnonzero((g[:, 0] >= lo) & (g[:, 0] <= hi))
        edges = [(r[0], N.ring_edges(r[1], r[2]), r[3], r[4]) for r in regions]
        s = N.Slabs([(n, e[(np.maximum(e[:, 0], e[:, 2]) >= lo) & (np.minimum(e[:, 0], e[:, 2]) <= hi)], a, b) for n, e, a, b in edges], 1e-14, lo, hi)
        at, names = s.locate(g[mine, 0], g[mine, 1], np.zeros(len(mine)))
        assert set(zip(mine[at].tolist(), names)) == {(i, n) for i, n in want if lo <= g[i, 0] <= hi}


def test_slabs_halve_a_range_of_many_trapezoids(monkeypatch):
    monkeypatch.setattr(N, "TRAPEZOIDS", 60)
    monkeypatch.setattr(N, "EDGES", 25)
    test_slabs.hypothesis.inner_test(11)
    test_slabs.hypothesis.inner_test(12)


def test_containing(spark):
    rng = random.Random(3)
    regions = [(f"r{i}", *map(lambda v: list(map(float, v)), zip(*star(rng, 7))), -1.0, 1.0, "clash") for i in range(12)]
    regions += [("closed", [0.0, 4.0, 4.0, 0.0, 0.0], [0.0, 0.0, 4.0, 4.0, 0.0], 0.0, 0.0, "c"), ("bad", [1.0, 2.0], [1.0, 2.0], 0.0, 1.0, "c"), ("null", None, None, 0.0, 1.0, "c")]
    rdf = spark.createDataFrame(regions, "region_id string, ring_x array<double>, ring_y array<double>, z_min double, z_max double, k string")
    pts = [(f"p{i}", float(rng.randint(-12, 12)), float(rng.randint(-12, 12)), float(rng.choice([-2, -1, 0, 0.5, 1]))) for i in range(900)] + [("hot", 1.0, 1.0, 0.0)] * 50 + [("q", None, 0.0, 0.0)]
    pdf = spark.createDataFrame(pts, "id string, x double, y double, z double")
    want = {(i, r[0]) for i, x, y, z in pts if x is not None for r in regions if r[1] and len(r[1]) > 2 and r[3] <= z <= r[4] and ring_brute(list(zip(r[1], r[2]))[: 4 if r[0] == "closed" else None], x, y)}
    for tile_rows in (20_000, 100, 9):
        a = [tuple(r) for r in N.containing_regions(pdf, rdf, "id", XYZ, tile_rows).collect()]
        assert len(a) == len(set(a)) and set(a) == want
    both = N.hits(pdf, rdf, "id", XYZ, 0.5, 100)
    assert {(r[1], r[2]) for r in both.collect() if r[0] == "inside"} == want


def test_empty(spark):
    df = spark.createDataFrame([], "id string, x double, y double, z double")
    rdf = spark.createDataFrame([], "region_id string, ring_x array<double>, ring_y array<double>, z_min double, z_max double")
    one = spark.createDataFrame([("a", 0.0, 0.0, 0.0)], df.schema)
    assert N.near_pairs(df, "id", XYZ, 1.0).count() == 0 and N.near_counts(df, "id", XYZ, 1.0).count() == 0
    assert N.containing_regions(df, rdf, "id", XYZ).count() == 0 and N.containing_regions(one, rdf, "id", XYZ).where(F.lit(True)).count() == 0
