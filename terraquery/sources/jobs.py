"""Load jobs: text files to fact tables with their metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquery.functions import codes as C
from terraquery.operators import engines as E
from terraquery.operators import volume as V
from terraquery.session import written
from terraquery.sources import catalog, lines, records

#: Reasons of failure that a load reports.
REASONS = 10


def meta_path(root: str, family: str, dataset: str) -> str:
    return catalog.path_of(root, family, dataset, "meta")


def _extent(df: DataFrame) -> dict:
    """Ranges of temperature and velocities, for reports beside the facts."""
    cols = ("t", "vx", "vy", "vz")
    r = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    return {c: [r[2 * i], r[2 * i + 1]] for i, c in enumerate(cols)}


def _write(df: DataFrame, root: str, family: str, dataset: str, sets: Sequence[str] | None) -> None:
    for layout in catalog.layouts(family, sets):
        catalog.write_facts(df, root, family, dataset, layout)


def load_points(spark: SparkSession, path: str, root: str, dataset: str, sets: Sequence[str] | None = None) -> dict:
    """POINT lines to facts; returns the number of loaded and failed lines."""
    read = records.read_numbered(spark, path)
    parsed = lines.parse_lines(read, lines.POINT_LINES)
    good = written(lines.valid_rows(parsed).withColumn("time_ms", F.col("time_millis")).withColumn("dk", F.concat_ws("-", F.xxhash64("file_name").cast("string"), F.col("line_no").cast("string"))))
    bounds = E.point_bounds(good)
    if bounds is not None:
        _write(E.point_facts(good, bounds), root, "point", dataset, sets)
        catalog.write_meta(spark, meta_path(root, "point", dataset), bounds=bounds, extent=_extent(good), header=records.header_of(read, lines.HEADER_WORD))
    return _counts(parsed)


def load_voxels(spark: SparkSession, path: str, root: str, dataset: str, sets: Sequence[str] | None = None) -> dict:
    """VOXEL lines to facts, the last line of a key winning; the grid is that of the first line."""
    read = records.read_numbered(spark, path)
    parsed = lines.parse_lines(read, lines.VOXEL_LINES)
    good = written(lines.valid_rows(parsed).withColumn("time_ms", F.col("time_millis")).withColumn("line", F.concat_ws("-", "file_name", F.lpad(F.col("line_no").cast("string"), 19, "0"))))
    report = E.voxel_grid(good, "line")
    if report is not None:
        facts = E.voxel_facts(good, report.grid).withColumn("brick_key", F.concat_ws("|", "sim_id", *[F.col(c).cast("string") for c in ("time_ms", "ib", "jb", "kb")]))
        _write(E.latest(facts, ["brick_key"], [F.col("line")]), root, "voxel", dataset, sets)
        catalog.write_meta(spark, meta_path(root, "voxel", dataset), grid=report.grid, extent=_extent(good), header=records.header_of(read, lines.HEADER_WORD))
    return _counts(parsed) | {"mismatched": report.mismatched if report else 0}


def load_sensors(spark: SparkSession, path: str, root: str, dataset: str, sets: Sequence[str] | None = None) -> dict:
    """SENSOR lines to facts; failed lines are counted by their reason."""
    parsed = written(records.check_sensors(records.read_numbered(spark, path)))
    good = parsed.where("error is null").drop("error")
    keyed = good.withColumn("row_key", F.sha1(F.concat_ws("|", *good.columns)))
    _write(E.sensor_facts(keyed), root, "sensor", dataset, sets)
    return _stats(parsed)


def load_volumes(spark: SparkSession, path: str, root: str, dataset: str, sets: Sequence[str] | None = None) -> dict:
    """VOLUME lines to bricks; a line whose payload does not hold its grid fails, too."""
    models = written(V.checked(records.parse_volumes(records.read_numbered(spark, path))))
    _write(V.brick_facts(V.tile(models.where("error is null"))), root, "volume", dataset, sets)
    made = spark.read.parquet(catalog.path_of(root, "volume", dataset)).agg(F.count(F.lit(1)).alias("bricks"), F.count_if("indexed").alias("indexed")).first().asDict()
    types = {r["model_type"]: r["models"] for r in records.models_by_type(models).orderBy("model_type").limit(REASONS).collect()}
    return _stats(models) | made | {"types": types}


def _stats(parsed: DataFrame) -> dict:
    stats = records.load_stats(parsed).first().asDict()
    return stats | {"reasons": {r["error"]: r["lines"] for r in records.first_failures(parsed, REASONS).collect()}}


def _counts(parsed: DataFrame) -> dict:
    """Lines, loaded and failed ones, and the failed ones by reason; one aggregation."""
    by = {r["reason"]: r["n"] for r in parsed.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    loaded = by.pop(None, 0)
    return {"lines": loaded + sum(by.values()), "loaded": loaded, "failed": sum(by.values()), "reasons": by}


LOADERS = {"sensor": load_sensors, "point": load_points, "voxel": load_voxels, "volume": load_volumes}


def facts(spark: SparkSession, root: str, family: str, dataset: str, layout: str = "unified") -> tuple[DataFrame, C.Bounds | C.Grid | None]:
    """The facts of a dataset, in the layout asked for if it is kept, and its bounds or grid."""
    path = catalog.path_of(root, family, dataset, catalog.table_of(layout))
    if layout != "unified" and not catalog.exists(spark, path):
        path = catalog.path_of(root, family, dataset)
    df = spark.read.parquet(path)
    if family in ("point", "voxel"):
        meta = catalog.read_meta(spark, meta_path(root, family, dataset))
        return df, meta["bounds" if family == "point" else "grid"]
    return df, None


def header(spark: SparkSession, root: str, family: str, dataset: str) -> str | None:
    """The header line that the lines of a dataset came with, if any."""
    return catalog.read_meta(spark, meta_path(root, family, dataset)).get("header")
