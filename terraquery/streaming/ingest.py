"""Continuous loading of line files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraquery.functions.codes import day_bucket
from terraquery.sources.lines import LineSpec, failed_rows, parse_lines, valid_rows

LINES = "line_id bigint, file_name string, line_no int, raw_line string"


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of lines in ``folder``."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def load(lines: DataFrame, spec: LineSpec, facts: str, failures: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append valid rows by day to ``facts`` and failed ones with their reason to ``failures``.

    A batch must hold the first line of each of its files, as the delimiter depends on it.
    Each batch writes to its own folder, so that a repeated batch replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        parsed = parse_lines(df, spec)
        good = valid_rows(parsed).withColumn("day_bucket", day_bucket(F.col("time_millis")))
        good.write.mode("overwrite").parquet(f"{facts}/batch={number}")
        failed_rows(parsed).select("line_id", "file_name", "line_no", "raw_line", "reason", F.array_join("errors", ",").alias("errors")).write.mode("overwrite").parquet(f"{failures}/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(points: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows and mean temperature per identifier and window of event time, with a watermark."""
    t = F.timestamp_millis("time_millis")
    w = points.withColumn("at", t).withWatermark("at", late).groupBy(F.window("at", width), "sim_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_t"))
