"""Orphans under each match rule, and liveness."""

import datetime
import itertools

import pytest

from terraquery.functions.keys import point_sim_id, row_key_text, voxel_sim_id
from terraquery.operators import references as R
from pyspark.sql import functions as F

T = [datetime.datetime(2024, 1, d) for d in range(1, 10)]


@pytest.mark.parametrize("match", R.MATCH)
def test_masks(spark, match):
    vals = [None, "a", "b"]
    refs = [(i, *k) for i, k in enumerate(itertools.product(vals, vals, vals))] * 2
    parents = [("a", "a", "a"), ("a", "b", None), ("b", None, "b"), ("a", "a", "a"), (None, None, None)]

    def orphan(k):
        some, none = any(x is None for x in k), all(x is None for x in k)
        if none or match == "simple" and some:
            return False
        if match == "full" and some:
            return True
        if match == "same":
            return k not in [list(p) for p in parents]
        return not any(all(x is None or x == y for x, y in zip(k, p)) for p in parents)

    want = sorted(i for i, *k in refs if orphan(k))
    r = spark.createDataFrame([(*x, "clash") for x in refs], "id int, p string, q string, s string, extra string")
    d = spark.createDataFrame([(*x, 1) for x in parents], "p string, q string, s string, extra int")
    got = R.orphans(r, d, ["p", "q", "s"], match)
    assert sorted(x["id"] for x in got.collect()) == want
    assert R.orphans(r.where("false"), d, ["p", "q", "s"], match).count() == 0
    assert R.orphans(r.where("id = 13"), d.where("false"), ["p", "q", "s"], match).count() == 2


def test_voxel_keys_by_their_parts(spark, tmp_path):
    """Entries against a comparison of whole keys, with keys of any number of parts."""
    from terraquery import data_queries as D

    keys = ["a/b|1|2|3|4", "a/b|1|2|3", "a/b|1|2|3|", "a/b|1||3|4", "a/b|1", "A/B|1|tile_2|3|4 ", "a/b|1|2|3|4|5", "x", "|", "", None, " "]
    rows, entries = keys[1:6:2] + [keys[6], "", None], [(i, k) for i, k in enumerate(keys * 2)]
    day = datetime.datetime(2024, 1, 5)
    frames = {
        "volume_idx_unified": spark.createDataFrame([(i, k, 20240105) for i, k in entries], "entry_id long, dk string, day_bucket int"),
        "geosim_point_idx_unified": spark.createDataFrame([(i, k, 20240105) for i, k in entries], "entry_id long, dk string, day_bucket int"),
        "volume_brick_data": spark.createDataFrame([(k, day) for k in rows], "row_key string, written_at timestamp_ntz"),
        "geosim_point_data": spark.createDataFrame([(k, day) for k in rows], "row_key string, written_at timestamp_ntz"),
        "row_deletes": spark.createDataFrame([("volume_brick_data", "a/b|1|2|3", T[8]), ("geosim_point_data", "none", T[8])], "table_name string, row_key string, deleted_at timestamp_ntz"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    plain = lambda k: k.strip().lower().replace("tile_", "") if k else ""
    live = {plain(k) for k in rows} - {""}
    want = {("geosim_point_idx_unified", i) for i, k in entries if plain(k) and plain(k) not in live}
    want |= {("volume_idx_unified", i) for i, k in entries if plain(k).strip("|") and plain(k) not in live - {"a/b|1|2|3"}}
    # a key of bars alone has no part that is not null but its number of parts
    want |= {("volume_idx_unified", i) for i, k in entries if k == "|"}
    got = [tuple(r) for r in D.p4_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert D.p4_report(spark, str(tmp_path)).agg(F.sum("orphans")).first()[0] == len(want)


def test_live(spark):
    rows = spark.createDataFrame([("a", T[0]), ("b", T[0]), ("b", T[5]), ("c", T[0]), ("d", None), ("e", None), ("f", T[3])], "k string, w timestamp_ntz")
    dels = spark.createDataFrame([("b", T[2]), ("b", T[2]), ("c", T[2]), ("e", T[1]), ("f", T[3]), ("g", T[1]), ("a", None)], "k string, d timestamp_ntz")
    assert {r["k"] for r in R.live_keys(rows, dels, ["k"], "w", "d").collect()} == {"a", "b", "d"}


def test_report_and_names(spark):
    df = spark.createDataFrame([("t", 20240131), ("t", 20240101), ("t", None), ("u", 20241231)], "tb string, day int")
    got = {(r["table_name"], r["month"]): r["orphans"] for r in R.orphan_report(df, "tb", "day").collect()}
    assert got == {("t", 202401): 2, ("t", None): 1, ("u", 202412): 1}
    cases = [" 2.0 ", "2.00", "2.5", "x", "10.0.0", None, " \t7\r", "02.0", "2.0e1"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert [r[0] for r in df.select(point_sim_id(F.col("s"))).collect()] == ["2", "2", "2.5", "x", "10.0.0", None, "7", "02", "2.0e1"]
    vox = ["1.0/2.50", " 3 / 12.0 ", "a/b", "1/2/3", "5", None, "1e2/-0.5", "7.0/"]
    df = spark.createDataFrame([(c,) for c in vox], "s string")
    assert [r[0] for r in df.select(voxel_sim_id(F.col("s"))).collect()] == ["1/2.50", "3/12", "a/b", "1/2/3", "5", None, "100/-0.5", "7.0/"]
    keys = [" AB|1|tile_2|3|4 ", "ab|1|2|3|4", "  ", "", None]
    df = spark.createDataFrame([(c,) for c in keys], "s string")
    assert [r[0] for r in df.select(row_key_text(F.col("s"))).collect()] == ["ab|1|2|3|4", "ab|1|2|3|4", None, None, None]
