"""SENSOR and VOLUME records from delimited text, and what a load did."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraquery.functions.codes import parse_instant
from terraquery.functions.keys import trimmed
from terraquery.session import written
from terraquery.sources.lines import NUMBER_SHAPE, TIME_FORMAT, delimiters

# Field orders.
SENSOR_FIELDS = ("time", "sensor_id", "longitude", "latitude", "altitude", "sensor_type")
VOLUME_FIELDS = ("model_id", "time_iso", "model_type", "lon_min", "lat_min", "z_min", "lon_max", "lat_max", "z_max", "nx", "ny", "nz", "payload_b64")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, line_no, raw_line`` of text files, plain or compressed; lines count from 1 in each file.

    Files are split as the reader splits them: a line's number is its place in its split
    and the number of lines in the splits before.  The lines are written once, so that
    both come from the same splits.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("raw_line"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task reads its splits one after the other."""
        split, seen = None, 0
        for b in batches:
            name, at = b.column(0).to_pylist(), b.column(1).to_pylist()
            place = []
            for here in zip(name, at):
                if here != split:
                    split, seen = here, 0
                seen += 1
                place.append(seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=["file_name", "at", "raw_line", "place"])

    kept = written(read.mapInArrow(place, "file_name string, at long, raw_line string, place long"))
    before = Window.partitionBy("file_name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each split
    splits = kept.groupBy("file_name", "at").agg(F.count(F.lit(1)).alias("n")).select("file_name", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return kept.join(splits, ["file_name", "at"]).select("file_name", (F.col("before") + F.col("place")).alias("line_no"), "raw_line")


def header_of(lines: DataFrame, word: str) -> str | None:
    """The first line of the first file, if it begins with a header's word."""
    first = lines.where("line_no = 1").orderBy("file_name").select("raw_line").first()
    text = (first[0] or "").lstrip("\ufeff").rstrip("\r") if first else ""
    return text if text.strip().strip('"').startswith(word) else None


def _fields(raw: Column, delimiter: Column | str, n: int) -> list[Column]:
    d = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    parts = F.when(d == "\t", F.split(raw, "\t", -1)).otherwise(F.split(raw, ",", -1))
    return [trimmed(F.get(parts, F.lit(i))) for i in range(n)]


def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_SHAPE), c).try_cast("double")


def check_sensors(lines: DataFrame, delimiter: Column | str | None = None, raw: str = "raw_line") -> DataFrame:
    """SENSOR rows (UTC) with ``error``: null, or the first rule that a line breaks.

    Without a ``delimiter`` a file's first line (``file_name``, ``line_no``) decides it.
    Null and blank lines give no row.  A header breaks the rule of the time.
    """
    if delimiter is None:
        files = delimiters(lines, "file_name", "line_no", raw)
        lines = lines.join(files, F.col("file_name") == F.col("__file"), "left")
        delimiter = F.when(F.coalesce("__tab", F.lit(False)), "\t").otherwise(",")
    t, sid, lon, lat, alt, kind = _fields(F.col(raw), delimiter, 6)
    ms = F.unix_millis(F.try_to_timestamp(t, F.lit(TIME_FORMAT)))
    nums = {"longitude": _number(lon), "latitude": _number(lat), "altitude": _number(alt)}
    error = F.coalesce(F.when(kind.isNull(), "columns"), F.when(ms.isNull(), "time"), *[F.when(c.isNull(), k) for k, c in nums.items()])
    lines = lines.where(trimmed(F.col(raw)) != "")
    return lines.select(ms.alias("time_ms"), sid.alias("sensor_id"), *[c.alias(k) for k, c in nums.items()], kind.alias("sensor_type"), error.alias("error"))


def parse_sensors(lines: DataFrame, delimiter: Column | str = ",", raw: str = "raw_line") -> DataFrame:
    """SENSOR rows (UTC); lines with fewer fields, a bad number or time are left out."""
    return check_sensors(lines, delimiter, raw).where("error is null").drop("error")


def parse_volumes(lines: DataFrame, delimiter: Column | str = "\t", raw: str = "raw_line") -> DataFrame:
    """VOLUME models with ``error``: null, or the first rule that a line breaks.

    Header and blank lines give no row.
    """
    f = dict(zip(VOLUME_FIELDS, _fields(F.col(raw), delimiter, 13)))
    lines = lines.where((trimmed(F.col(raw)) != "") & ~F.startswith(F.col(raw), F.lit("model_id")))
    nums = {k: _number(f[k]) for k in VOLUME_FIELDS[3:9]}
    ints = {k: F.when(f[k].rlike("^[+-]?[0-9]{1,9}$"), f[k]).try_cast("int") for k in VOLUME_FIELDS[9:12]}
    ms = parse_instant(f["time_iso"])
    error = F.coalesce(
        F.when(f["payload_b64"].isNull(), "columns"), F.when(f["model_id"] == "", "model_id"), F.when(ms.isNull(), "time"),
        *[F.when(c.isNull(), k) for k, c in nums.items()], *[F.when(c.isNull() | (c <= 0), k) for k, c in ints.items()], F.when(f["payload_b64"] == "", "payload"))
    return lines.select(
        f["model_id"].alias("model_id"), f["time_iso"].alias("time_iso"), ms.alias("time_ms"), f["model_type"].alias("model_type"),
        *[c.alias(k) for k, c in nums.items()], *[c.alias(k) for k, c in ints.items()], f["payload_b64"].alias("payload_b64"), error.alias("error"))


def load_stats(parsed: DataFrame) -> DataFrame:
    """One row: lines, loaded and failed ones of a parsed table with ``error``."""
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("error").isNull()).alias("loaded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def first_failures(parsed: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent reasons of failure with their counts."""
    return parsed.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("lines"), "error").limit(n)


def models_by_type(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").groupBy("model_type").agg(F.count(F.lit(1)).alias("models"))
