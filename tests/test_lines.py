"""Line parsing against a character-by-character parser."""

import datetime
import re

from terraquery.sources import lines as L

NUM = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
CTRL = "".join(map(chr, range(33)))


def fields_of(line, delim):
    """Fields, or None for broken quoting."""
    out, i, n = [], 0, len(line)
    blanks = " " if delim == "\t" else " \t"
    while True:
        j = i
        while j < n and line[j] in blanks:
            j += 1
        if j < n and line[j] == '"':
            j += 1
            text = ""
            while True:
                if j >= n:
                    return None
                if line[j] == '"':
                    if line[j + 1: j + 2] == '"':
                        text += '"'
                        j += 2
                        continue
                    j += 1
                    break
                text += line[j]
                j += 1
            while j < n and line[j] in blanks:
                j += 1
            if j < n and line[j] != delim:
                return None
            out.append(text.strip(CTRL))
        else:
            j = line.find(delim, i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j].strip(CTRL))
        if j >= n:
            return out
        i = j + 1


def verdict(line, no, delim, width):
    """None where the line neither loads nor fails, else its reason or 'ok'."""
    if line is None:
        return None
    if no == 1:
        line = line.removeprefix("﻿")
    line = line.rstrip("\r\n")
    if not line.strip(CTRL):
        return None
    f = fields_of(line, delim)
    if f is None:
        m = re.match(r'\s*"?sim_id"?\s*(%s|$)' % delim, line)
        return None if m else "quoting"
    if f[0] == "sim_id":
        return None
    while f and not f[-1]:
        f.pop()
    if len(f) != width:
        return "columns"
    if not f[0]:
        return "value"
    try:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", f[1]):
            return "value"
        datetime.datetime.strptime(f[1], "%Y-%m-%dT%H:%M:%S")
        if f[1][17:] > "59":
            return "value"
    except ValueError:
        return "value"
    skip = 6 if width == 10 else 9
    return "ok" if all(NUM.fullmatch(x) for i, x in enumerate(f) if i > 1 and i != skip) else "value"


def brute(rows, width):
    tab = {r["file_name"]: True for r in rows if r["line_no"] == 1 and r["raw_line"] and "\t" in r["raw_line"]}
    return {r["line_id"]: v for r in rows if (v := verdict(r["raw_line"], r["line_no"], "\t" if tab.get(r["file_name"]) else ",", width))}


def ours(df, spec):
    return {r["line_id"]: r["reason"] or "ok" for r in L.parse_lines(df, spec).select("line_id", "reason").collect()}


def test_whole_tables(spark):
    for sf in ("sf0.001", "sf0.1"):
        for name, spec in (("geosim_point_line", L.POINT_LINES), ("geosim_voxel_line", L.VOXEL_LINES)):
            df = spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
            want = brute([r.asDict() for r in df.collect()], len(spec.fields))
            assert ours(df, spec) == want


GOOD = "7,2024-01-01T00:00:00,1,2,3,4,x,5,6,7"


def test_edges(spark):
    cases = [
        GOOD, "﻿" + GOOD, GOOD + ",,", GOOD + ",x", "", "   ", None, ",,,", "sim_id,a", '"sim_id",x"y', GOOD.replace("x", '"a ""b"" c"'),
        GOOD.replace("x", '"a" b'), GOOD.replace("x", 'a"'), GOOD.replace("x", '"a'), GOOD.replace("x", ' "a" '), GOOD.replace("x", '"a,b"'),
        GOOD.replace("2024-01-01", "2024-02-30"), GOOD.replace("00:00:00", "24:00:00"), GOOD.replace("00:00:00", "23:59:60"), GOOD.replace("T", " "),
        GOOD.replace("1,2,3", "1.,.2,+3e-4"), GOOD.replace("1,2,3", "NaN,2,3"), GOOD.replace("1,2,3", "1d,2,3"), GOOD.replace("1,2,3", ".,2,3"),
        GOOD.replace("1,2,3", ",2,3"), GOOD.replace("7,2024", ",2024"), GOOD.replace("x", ""), GOOD.replace("x", '""'), GOOD + "\r", GOOD.replace("x", "y" * 200_000),
        GOOD.replace("x", '"' + 'q""' * 50_000 + '"'), GOOD.replace("x", '"' * 99_999),
    ]
    rows = [("f", i + 1, c) for i, c in enumerate(cases)] + [(None, 1, GOOD), (None, 2, None)]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "line_id long, file_name string, line_no int, raw_line string, sim_id string")
    want = brute([r.asDict() for r in df.collect()], 10)
    assert ours(df, L.POINT_LINES) == want
    got = {r["line_id"]: r for r in L.valid_rows(L.parse_lines(df, L.POINT_LINES)).collect()}
    assert got[0]["sim_id"] == "7" and got[0]["vz"] == 7.0 and got[0]["time_millis"] == 1704067200000


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id long, file_name string, line_no int, raw_line string")
    assert L.parse_lines(df, L.VOXEL_LINES).count() == 0
