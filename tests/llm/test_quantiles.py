"""Sketches against exact ranks: in codes, in counters, merged, with deletions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquery.llm import quantiles as Q

PROBS = [0.01, 0.5, 0.9, 0.99]


def data(n=20_000, seed=3):
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.3, 300.0, rng.normal(380, 40, n))
    return [(["a", "b", None][i % 3], int(i % 5), float(x)) for i, x in enumerate(v)]


def worst(rows, values):
    """Largest distance of a found quantile's ranks from the wanted one, as a share."""
    v, out = np.sort(values), 0.0
    for p in PROBS:
        q, e = rows[f"q{p:g}"], rows["value_error"]
        lo, hi = np.searchsorted(v, q - e, "left"), np.searchsorted(v, q + e, "right")
        want = p * len(v)
        out = max(out, (lo - want) / len(v), (want - hi) / len(v))
    return out


def test_codes_keep_order_and_bound_the_error():
    rng = np.random.default_rng(1)
    v = np.sort(np.concatenate([rng.normal(0, 10.0 ** rng.integers(-300, 300, 500), 500), [0.0, -0.0, 1.0, 2.0, -2.0, 1.7976931348623157e308, -1.7976931348623157e308, 5e-324]]))
    for spec in (Q.SketchSpec(), Q.SketchSpec(bits=20)):
        code = spec.encode(v)
        assert (np.diff(code.astype("int64")) >= 0).all() and spec.encode(np.array([-0.0])) == spec.encode(np.array([0.0]))
        middle, off = spec.decode(code)
        assert (np.abs(middle - v) <= off).all() and (off <= np.abs(v) * 2.0 ** (11 - spec.bits) + 1e-300).all()


@pytest.mark.parametrize("spec", [Q.SketchSpec(sparse_limit=4096), Q.SketchSpec(sparse_limit=100, width=512)])
def test_error_bound_and_merge(spark, spec):
    rows = data()
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(5)
    daily = Q.sketch(df, ["g", "day"], "v", spec)
    found = {r["g"]: r for r in Q.quantiles(Q.merge(daily, ["g"], spec), ["g"], PROBS, spec).collect()}
    assert set(found) == {"a", "b", None}
    for g, r in found.items():
        values = [v for k, _, v in rows if k == g]
        assert r["n"] == len(values)
        assert worst(r, values) <= r["rank_error"] + 1e-9
        assert 0 < r["rank_error"] < 0.05  # 4,600 different values are more than any limit here
    direct = {r["g"]: r for r in Q.quantiles(Q.sketch(df, ["g"], "v", spec), ["g"], PROBS, spec).collect()}
    assert direct == found  # adding up days gives the sketch of all rows
    scopes = Q.quantiles(Q.sketch(df, ["g", "day"], "v", spec, scopes={"g": ["g"], "one": [], "both": ["g", "day"]}), ["scope", "g", "day"], PROBS, spec)
    assert {r["g"]: r[3:] for r in scopes.where("scope = 'g'").collect()} == {g: r[1:] for g, r in found.items()}
    (total,) = Q.quantiles(Q.merge(daily, [], spec), [], PROBS, spec).collect()
    assert total["n"] == len(rows) and worst(total, [v for *_, v in rows]) <= total["rank_error"] + 1e-9
    assert tuple(scopes.where("scope = 'one'").first()[3:]) == tuple(total)


def test_both_forms_hold_the_same_counters(spark):
    rows = [(v,) for _, _, v in data(3000)]
    df = spark.createDataFrame(rows, "v double").repartition(4)
    direct = Q.counters(Q.SketchSpec(), Q.SketchSpec().encode(np.array([v for v, in rows])).astype("int64"), np.ones(len(rows), "int64"))
    for limit in (0, 500, 1200):  # counters from the first row on, from some partitions on, from the merge on
        spec = Q.SketchSpec(sparse_limit=limit)
        (table,) = Q._added(iter(Q.sketch(df, [], "v", spec).repartition(1).toArrow().to_batches()), [], spec)
        assert set(table.dense) == {0} and all((table.dense[0][p] == c).all() for p, c in direct.items())


def test_few_groups_at_a_time(monkeypatch):
    """However little is added up at a time, every group comes out once and whole."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    spec = Q.SketchSpec(sparse_limit=300)
    group, code = np.sort(rng.integers(0, 40, 9000)), rng.integers(0, 1 << 32, 9000)
    code[group < 5] %= 7
    made = Q._Groups(spec, pa.table({"g": np.arange(40)}), group, code, np.ones(9000, "int64"), {})
    rows = made.rows().sort_by("g")
    batches = pa.concat_tables([rows, rows]).sort_by("g").combine_chunks().to_batches(max_chunksize=37)
    want = {g: 2 * n for g, n in zip(*np.unique(group, return_counts=True))}
    for dense_rows, code_bytes, open_bytes in ((1000, 12 << 20, 32 << 20), (1, 1, 1), (40, 3000, 100_000)):
        monkeypatch.setattr(Q, "DENSE_ROWS", dense_rows)
        monkeypatch.setattr(Q, "CODE_BYTES", code_bytes)
        monkeypatch.setattr(Q, "OPEN_BYTES", open_bytes)
        got = {}
        for part in Q._added(iter(batches), ["g"], spec):
            keys = part.keys.column("g").to_pylist()
            total = np.bincount(part.group, weights=part.n, minlength=len(keys))
            for i, k in enumerate(keys):
                assert k not in got
                got[k] = int(part.dense[i][0].sum() if i in part.dense else total[i])
        assert got == want


def test_one_value_holds_most_rows(spark):
    df = spark.range(60_000).selectExpr("cast(if(id % 3 = 0, 300, id) as double) v").repartition(6)
    (r,) = Q.quantiles(Q.sketch(df, [], "v"), [], PROBS).collect()
    v = [300.0 if i % 3 == 0 else float(i) for i in range(60_000)]
    assert r["n"] == 60_000 and worst(r, v) <= r["rank_error"] < 0.02


def test_deletions(spark):
    spec = Q.SketchSpec(sparse_limit=100)
    rows = [(v, 1) for _, _, v in data(6000)] + [(v, 1) for _, _, v in data(3000, 9)] + [(v, -1) for _, _, v in data(3000, 9)]
    df = spark.createDataFrame(rows, "v double, w int")
    for s in (spec, Q.SketchSpec(sparse_limit=10**6)):
        (a,) = Q.quantiles(Q.sketch(df, [], "v", s, "w"), [], PROBS, s).collect()
        (b,) = Q.quantiles(Q.sketch(df.limit(6000), [], "v", s), [], PROBS, s).collect()
        assert a == b
    gone = spark.createDataFrame([("x", 1.0, 1), ("x", 1.0, -1), ("y", 2.0, 1)], "g string, v double, w int")
    assert [r["g"] for r in Q.quantiles(Q.sketch(gone, ["g"], "v", weight="w"), ["g"], PROBS).collect()] == ["y"]


def test_edges(spark):
    df = spark.createDataFrame([("x", None, None), ("x", float("nan"), 1), ("x", float("inf"), 1), ("y", 1.0, 1), ("y", 1e300, 1), ("y", -1e300, 1), ("y", 1.0, 1), (None, 50_000.0, 1), (None, 60_000.0, 1)], "g string, v double, part int")
    got = {r["g"]: r for r in Q.quantiles(Q.sketch(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert set(got) == {"y", None} and got["y"]["n"] == 4 and abs(got["y"]["q0.5"] - 1.0) <= got["y"]["value_error"]
    assert abs(got[None]["q0.5"] - 50_000) <= got[None]["value_error"] < 0.1
    empty = Q.sketch(df.where("false"), ["g"], "v")
    assert Q.quantiles(empty, ["g"], [0.5]).count() == 0
    assert Q.quantiles(Q.merge(empty, []), [], [0.5]).count() == 0


def exact_codes(values):
    """The middles of the cells that hold the wanted ranks, and the widest half of a cell."""
    v = np.sort(values)
    at = [v[max(int(np.ceil(p * len(v) - 1e-9)), 1) - 1] for p in PROBS]
    middle, off = Q.SketchSpec().decode(Q.SketchSpec().encode(np.array(at)))
    return [*map(float, middle), float(off.max())]


def test_days_of_many_values_are_whole(spark, tmp_path):
    """Days of more values than a group keeps as codes are in the result, too, with exact ranks."""
    rng = np.random.default_rng(5)
    day = 86_400_000
    values = {("1", 0): rng.normal(380, 40, 20_000), (None, 0): -rng.random(9_500) * 1e5, ("1", 1): rng.normal(380, 40, 50), (None, 1): np.repeat([3.0, 4.0], 5_000)}
    rows = [(s, d * day + 5, float(v)) for (s, d), of in values.items() for v in of]
    spark.createDataFrame(rows, "sim_id string, time_millis long, t double").repartition(5).write.parquet(str(tmp_path / "geosim_point_data.parquet"))
    from terraquery.llm import queries as L

    got = {(r["sim_id"], r["day"].toordinal() - 719163): r for r in L.p2_days(spark, str(tmp_path)).collect()}
    assert set(got) == set(values)
    for g, of in values.items():
        assert list(got[g][2:]) == [len(of), *exact_codes(of)]


def test_exact_ranks_of_groups_without_keys(spark):
    rows = [(v,) for _, _, v in data(5000)] + [(None,), (float("nan"),)]
    (r,) = Q.exact(spark.createDataFrame(rows, "v double").repartition(3), [], "v", PROBS).collect()
    assert list(r) == [5000, *exact_codes([v for _, _, v in data(5000)])]
    assert Q.exact(spark.createDataFrame([], "v double"), [], "v", PROBS).count() == 0


def test_queries_against_exact(spark, sf):
    from terraquery.llm import queries as L

    exact = L._days(spark, sf).groupBy("sim_id", "day").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by t)").alias("m"))
    got = L.p2_percentiles(spark, sf).where("scope = 'sim_day'")
    both = exact.alias("e").join(got.alias("g"), F.expr("e.sim_id <=> g.sim_id and e.day <=> g.day"), "full")
    assert both.where("e.n is null or g.n is null or e.n <> g.n or abs(m - p50) > value_error").count() == 0
    assert L.p2_span(spark, sf).count() > 0
