"""Delimited text lines to typed rows, with the reason where a line fails.

Every field is first a nullable text; vectorised rules collect what is wrong with
it in an array of errors, and an empty array makes a valid row.  Everything is a
column expression: nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquery.functions.keys import once, point_sim_id, trimmed, voxel_sim_id

# Field orders and formats of the line families.
POINT_FIELDS = ("sim_id", "time_iso", "x", "y", "z", "t", "ignored", "vx", "vy", "vz")
VOXEL_FIELDS = ("sim_id", "time_iso", "x_min", "x_max", "y_min", "y_max", "z_min", "z_max", "t", "ignored", "vx", "vy", "vz")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
TIME_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"
NUMBER_SHAPE = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEADER_WORD = "sim_id"

#: Files whose delimiter table is broadcast; more are joined by a shuffle.
BROADCAST_FILES = 200_000


@dataclass(frozen=True)
class LineSpec:
    fields: tuple[str, ...]
    voxel: bool

    @property
    def numbers(self) -> tuple[str, ...]:
        return tuple(f for f in self.fields if f not in ("sim_id", "time_iso", "ignored"))


POINT_LINES, VOXEL_LINES = LineSpec(POINT_FIELDS, False), LineSpec(VOXEL_FIELDS, True)


def _units(delimiter: str, blank: str) -> tuple[str, str]:
    """Patterns of a whole well-quoted line and of one delimiter-led field."""
    quoted = f'{blank}*+"[^"]*+(?:""[^"]*+)*+"{blank}*+'
    field = f'(?:{quoted}(?={delimiter}|$)|[^"{delimiter}]*+(?={delimiter}|$))'
    return f"^(?:{delimiter}{field})++$", f"{delimiter}({field})"


def _split(line: Column, delimiter: str, blank: str) -> tuple[Column, Column]:
    """Whether the quoting is sound, and the raw fields; ``line`` starts with the delimiter."""
    whole, field = _units(delimiter, blank)
    has = F.contains(line, F.lit('"'))
    sound = ~has | line.rlike(whole)
    plain = F.split(F.substring(line, 2, 2147483647), delimiter, -1)
    return sound, F.when(has, F.regexp_extract_all(line, F.lit(field), F.lit(1))).otherwise(plain)


def _value(raw: Column) -> Column:
    t = trimmed(raw)
    inner = F.substring(t, 2, 2147483647)
    body = F.replace(F.regexp_replace(inner, '"$', ""), F.lit('""'), F.lit('"'))
    return F.when(t.startswith('"'), trimmed(body)).otherwise(t)


def delimiters(lines: DataFrame, file: str, number: str, raw: str) -> DataFrame:
    """Per file whether its first line holds a tab (then the tab delimits, else the comma)."""
    return lines.where(F.col(number) == 1).groupBy(F.col(file).alias("__file")).agg(F.max(F.contains(F.col(raw), F.lit("\t"))).alias("__tab"))


def split_fields(lines: DataFrame, file: str = "file_name", number: str = "line_no", raw: str = "raw_line") -> DataFrame:
    """``lines`` with ``__kind`` (skip, quoting or fields) and the array ``__fields``.

    Null, blank and header lines are ``skip``.  A byte order mark in line 1 is no
    content.  Files without a line 1 are comma-delimited; lines of a null file are
    comma-delimited.
    """
    files = delimiters(lines, file, number, raw)
    few = lines.where(F.col(number) == 1).count() <= BROADCAST_FILES
    joined = lines.join(F.broadcast(files) if few else files, F.col(file) == F.col("__file"), "left")
    text = F.when(F.col(number) == 1, F.regexp_replace(F.col(raw), "^\ufeff", "")).otherwise(F.col(raw))
    tab = F.coalesce("__tab", F.lit(False))
    led = F.concat(F.when(tab, F.lit("\t")).otherwise(F.lit(",")), F.regexp_replace(text, "[\\r\\n]+$", ""))
    df = once(joined, __tab=tab, __led=led)
    df = df.drop("__file").where(F.col("__led").isNotNull())
    tab_first, com_first = (F.regexp_extract(F.col("__led"), "^" + _units(d, blank)[1], 1) for d, blank in (("\t", "[ ]"), (",", "[ \t]")))
    (tab_ok, tab_fields), (com_ok, com_fields) = _split(F.col("__led"), "\t", "[ ]"), _split(F.col("__led"), ",", "[ \t]")
    pick = F.when(F.col("__tab"), tab_first).otherwise(com_first)
    blank = trimmed(F.substring("__led", 2, 2147483647)) == ""
    df = once(df, __head=blank | (_value(pick) == HEADER_WORD), __sound=F.when(F.col("__tab"), tab_ok).otherwise(com_ok))
    kind = F.when(F.col("__head"), "skip").when(~F.col("__sound"), "quoting").otherwise("fields")
    fields = F.transform(F.when(F.col("__tab"), tab_fields).otherwise(com_fields), _value)
    df = once(df, __kind=kind, __fields=F.when(~F.col("__head") & F.col("__sound"), fields))
    last = F.array_max(F.transform("__fields", lambda v, i: F.when(v != "", i + 1).otherwise(0)))
    df = once(df, __fields=F.slice("__fields", 1, F.coalesce(last, F.lit(0))))
    return df.drop("__tab", "__led", "__head", "__sound")


def parse_lines(lines: DataFrame, spec: LineSpec, **names: str) -> DataFrame:
    """All lines that load or fail, as typed nullable columns with ``errors`` and ``reason``.

    ``errors`` names each broken rule (``quoting``, ``columns`` or ``value:<field>``);
    it is empty for a valid row.  ``reason`` is the kind of the first error, null for a
    valid row.  Columns of the input are kept unless a field has their name.
    """
    df = split_fields(lines, **names).where(F.col("__kind") != "skip")
    full = (F.col("__kind") == "fields") & (F.size("__fields") == len(spec.fields))
    df = once(df, __full=full, __f=F.when(full, F.col("__fields")))
    text = {f: F.get("__f", F.lit(i)) for i, f in enumerate(spec.fields)}
    time = F.try_to_timestamp(F.when(text["time_iso"].rlike(TIME_SHAPE), text["time_iso"]), F.lit(TIME_FORMAT))
    number = {f: F.when(text[f].rlike(NUMBER_SHAPE), text[f]).try_cast("double") for f in spec.numbers}
    df = once(df, __time=time, **{f"__n_{f}": c for f, c in number.items()})
    full = F.col("__full")
    bad = [
        F.when(F.col("__kind") == "quoting", F.lit("quoting")).when(~full, F.lit("columns")),
        F.when(full & (text["sim_id"] == ""), F.lit("value:sim_id")),
        F.when(full & F.col("__time").isNull(), F.lit("value:time_iso")),
        *[F.when(full & F.col(f"__n_{f}").isNull(), F.lit(f"value:{f}")) for f in spec.numbers],
    ]
    df = once(df, __errors=F.filter(F.array(*bad), lambda e: e.isNotNull()))
    kept = [c for c in lines.columns if c not in spec.fields and c not in ("errors", "reason", "time_millis")]
    sim = voxel_sim_id(text["sim_id"]) if spec.voxel else point_sim_id(text["sim_id"])
    return df.select(
        *kept, F.col("__errors").alias("errors"), F.split(F.get("__errors", F.lit(0)), ":")[0].alias("reason"),
        sim.alias("sim_id"), text["time_iso"].alias("time_iso"), F.unix_millis("__time").alias("time_millis"),
        *[F.col(f"__n_{f}").alias(f) for f in spec.numbers],
    )


def valid_rows(parsed: DataFrame) -> DataFrame:
    """Rows without errors."""
    return parsed.where(F.size("errors") == 0).drop("errors", "reason")


def failed_rows(parsed: DataFrame) -> DataFrame:
    """Rows with errors, to be kept beside the load."""
    return parsed.where(F.size("errors") > 0)
