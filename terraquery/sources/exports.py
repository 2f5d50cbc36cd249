"""Exports: CSV, JSON and text forms of results, as columns and as writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquery.functions.codec import encode_payload
from terraquery.functions.codes import format_instant, format_seconds

# The columns of the sensor and the brick export.
SENSOR_HEADER = ("Time", "ID", "Longitude", "Latitude", "Altitude", "Type", "RowKey")
BRICK_HEADER = ("model_id", "time_iso", "time_millis", "model_type", "tile_i", "tile_j", "tile_k", "lon_min", "lat_min", "z_min", "lon_max", "lat_max", "z_max", "nx", "ny", "nz", "payload_b64")
FORMATS = ("csv", "json", "txt", "both")


def sensor_csv(df: DataFrame) -> DataFrame:
    """Rows under the sensor header; the time as text."""
    cols = (format_seconds(F.col("time_ms")), F.col("sensor_id"), F.col("longitude"), F.col("latitude"), F.col("altitude"), F.col("sensor_type"), F.col("row_key"))
    return df.select(*[c.alias(n) for c, n in zip(cols, SENSOR_HEADER)])


def sensor_json(df: DataFrame) -> DataFrame:
    """One JSON object per record (JSON lines, so that the result stays distributed)."""
    time = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss")
    return df.select(F.to_json(F.struct("row_key", time.alias("time"), F.col("time_ms").alias("timestamp"), "sensor_id", "longitude", "latitude", "altitude", F.col("sensor_type").alias("type"))).alias("value"))


def envelope(df: DataFrame) -> DataFrame:
    """What goes beside exported records: the time of the export and their number."""
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("query_time"), "total_count")


def brick_rows(hits: DataFrame) -> DataFrame:
    """Bricks as they are exported, with their cells as payload."""
    made = hits.withColumns({"time_iso": format_instant(F.col("time_ms")), "time_millis": F.col("time_ms"), "payload_b64": encode_payload("brick")})
    return made.select(*BRICK_HEADER)


def mask_report(models: DataFrame) -> DataFrame:
    """A line of text for each reassembled model: its cells, those kept by the mask, and its bricks without data."""
    cells = F.col("nx") * F.col("ny") * F.col("nz")
    return models.select(F.concat_ws(", ", "model_id", format_instant(F.col("time_ms")), cells.cast("string"), F.col("kept").cast("string"), F.format_string("%.4f", F.col("kept") / cells), F.col("missing").cast("string")).alias("value"))


def with_header(df: DataFrame, header: str | None) -> DataFrame:
    """Text lines with a header before those of each partition, and so in each file."""
    if header is None:
        return df

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            if len(pdf) and first:
                yield pd.DataFrame({"value": [header]})
                first = False
            yield pdf

    return df.mapInPandas(head, "value string")


def raw_csv(df: DataFrame, raw: str = "raw_line", tabs: bool = True) -> DataFrame:
    """Raw lines as comma-separated text; ``tabs`` turns tabs to commas."""
    c = F.col(raw)
    return df.select((F.replace(c, F.lit("\t"), F.lit(",")) if tabs else c).alias("value"))


def raw_json(df: DataFrame, header: list[str], raw: str = "raw_line") -> DataFrame:
    """Raw lines as JSON objects of texts under the names of ``header``; missing fields are left out."""
    c = F.col(raw)
    parts = F.when(F.contains(c, F.lit("\t")), F.split(c, "\t", -1)).otherwise(F.split(c, ",", -1))
    fields = F.struct(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(header)])
    return df.select(F.to_json(fields).alias("value"))


def raw_line_json(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Raw lines as JSON objects with the one field ``raw_line``, escaped."""
    return df.select(F.to_json(F.struct(F.col(raw).alias("raw_line"))).alias("value"))


def file_name(text: str) -> str:
    """A name for a file: everything but letters, digits, ``-`` and ``_`` becomes ``_``."""
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in text)


def write_raw(df: DataFrame, path: str, how: str, header: str | None, with_names: bool, raw: str = "raw_line") -> None:
    """Write raw lines as CSV, as JSON under the header's names if there is one, as they are, or both of the former."""
    how = how if how in FORMATS else "csv"
    names = None if header is None else [n.strip() for n in header.split("\t" if "\t" in header else ",")]
    if how in ("csv", "both"):
        top = header.replace("\t", ",") if header and with_names else None
        with_header(raw_csv(df, raw), top).write.mode("overwrite").text(f"{path}/csv" if how == "both" else path)
    if how in ("json", "both"):
        (raw_json(df, names, raw) if names else raw_line_json(df, raw)).write.mode("overwrite").text(f"{path}/json" if how == "both" else path)
    if how == "txt":
        with_header(df.select(F.col(raw).alias("value")), header if with_names else None).write.mode("overwrite").text(path)


def write(df: DataFrame, path: str, how: str = "csv", header: bool = True) -> None:
    """Write a table as CSV or JSON, its single text column as lines, or both of the former.

    An unknown format is CSV.  Every partition writes its own file.
    """
    how = how if how in FORMATS else "csv"
    if how == "txt" or df.columns == ["value"]:
        df.write.mode("overwrite").text(path)
        return
    if how in ("csv", "both"):
        df.write.mode("overwrite").csv(f"{path}/csv" if how == "both" else path, header=header)
    if how in ("json", "both"):
        df.write.mode("overwrite").json(f"{path}/json" if how == "both" else path)


def rejected(facts: DataFrame, coarse: Column, exact: Column) -> DataFrame:
    """Rows that the index conditions select and the exact ones refuse."""
    return facts.where(coarse & ~F.coalesce(exact, F.lit(False)))


def missing(keys: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Keys without a row."""
    return keys.join(facts.select(key), key, "left_anti")
