"""SENSOR, POINT, VOXEL and VOLUME rows derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def sensors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("row_key"), _ms("ts").alias("time_ms"),
        F.expr("concat('SENS_', lpad(cast(user_id % 50 as string), 3, '0'))").alias("sensor_id"),
        F.expr("110 + (event_id % 1000) * cast(0.01 as double)").alias("longitude"), F.expr("21 + ((event_id * 7) % 400) * cast(0.01 as double)").alias("latitude"),
        F.expr("least(value * 2, cast(1000 as double))").alias("altitude"), F.col("event_type").alias("sensor_type"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("dk"), F.expr("cast(l_suppkey % 4 + 1 as string)").alias("sim_id"),
        (_ms("l_shipdate") + F.expr("(l_orderkey % 24) * 3600000")).alias("time_ms"),
        F.expr("cast(4144000 + l_orderkey % 1000 as double)").alias("x"), F.expr("cast(647000 + l_partkey % 1000 as double)").alias("y"), F.expr("-2700 + l_quantity * 8").alias("z"),
        F.expr("cast(273.15 as double) + l_extendedprice / 500").alias("t"), F.expr("(l_discount - cast(0.05 as double)) * cast(0.01 as double)").alias("vx"),
        F.expr("(l_tax - cast(0.04 as double)) * cast(0.01 as double)").alias("vy"), F.expr("(l_discount - l_tax) * cast(0.1 as double)").alias("vz"))


_VOXEL_KEY = ["sim_id", "time_ms", "i", "j", "k"]


def _voxel_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the voxels, of which those of one key are versions."""
    return table(spark, sf, "lineitem").select(
        F.expr("concat(cast(l_suppkey % 3 + 1 as string), '/3')").alias("sim_id"), _ms("l_shipdate").alias("time_ms"),
        F.expr("l_orderkey % 64 - 8").alias("i"), F.expr("l_partkey % 64 - 8").alias("j"), F.expr("cast(l_quantity as bigint) % 16 - 4").alias("k"),
        "l_extendedprice", F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("tie"), "l_discount", "l_tax")


def _placed(rows: DataFrame, *more: str) -> DataFrame:
    """Voxels of a key with their edges and the key as text."""
    edges = {f"{a}_{e}": ((F.col(n) + d) * s).cast("double") for a, n, s in (("x", "i", 10), ("y", "j", 10), ("z", "k", 5)) for e, d in (("min", 0), ("max", 1))}
    return rows.select("sim_id", "time_ms", *[c.alias(n) for n, c in edges.items()], *more, F.expr("concat_ws('|', sim_id, time_ms, i + 8, j + 8, k + 4)").alias("brick_key"))


def voxel_places(spark: SparkSession, sf: str) -> DataFrame:
    """Place and time of every row of the voxels, versions included; nothing is shuffled."""
    return _placed(_voxel_rows(spark, sf))


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    # the version is what is compared: one struct, of raw columns, is all that is shuffled
    one = _voxel_rows(spark, sf).groupBy(*_VOXEL_KEY).agg(F.max(F.struct("l_extendedprice", "tie", "l_discount", "l_tax")).alias("r")).select(*_VOXEL_KEY, "r.*")
    values = {
        "t": "cast(273.15 as double) + l_extendedprice / 500", "vx": "(l_discount - cast(0.05 as double)) * cast(1e-4 as double)",
        "vy": "(l_tax - cast(0.04 as double)) * cast(1e-4 as double)", "vz": "(l_discount - l_tax) * cast(1e-3 as double)"}
    return _placed(one.select(*_VOXEL_KEY, *[F.expr(e).alias(n) for n, e in values.items()]), *values)


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    low = {"lon": F.expr("cast(113.25 as double) + (vec_id % 16) * cast(0.0625 as double)"), "lat": F.expr("cast(22.25 as double) + ((vec_id div 16) % 16) * cast(0.0625 as double)"), "z": F.expr("(vec_id % 4) * cast(62.5 as double)")}
    span = {"lon": 4 * 0.00390625, "lat": 4 * 0.00390625, "z": 4 * 7.8125}
    return table(spark, sf, "embeddings").select(
        F.expr("concat('M', cast(vec_id as string))").alias("model_id"), F.expr("1762300800000 + vec_id * 3600000").alias("time_ms"),
        F.expr("case when label % 2 = 0 then 'channelized' else 'layered' end").alias("model_type"),
        *[c.alias(f"{a}_min") for a, c in low.items()], *[(c + F.lit(span[a])).alias(f"{a}_max") for a, c in low.items()],
        *[F.lit(4).alias(n) for n in ("nx", "ny", "nz")], F.col("embedding").cast("array<float>").alias("vals"))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """Models of 20 x 18 x 10 cells, eight bricks each, filled from the embeddings; one cell in 97 has no data."""
    low = {"lon": F.expr("cast(113.25 as double) + (vec_id % 16) * cast(0.0625 as double)"), "lat": F.expr("cast(22.25 as double) + ((vec_id div 16) % 16) * cast(0.0625 as double)"), "z": F.expr("(vec_id % 4) * cast(62.5 as double)")}
    size = {"lon": 20 * 0.00390625, "lat": 18 * 0.00390625, "z": 10 * 7.8125}
    cell = F.expr("transform(sequence(0, 3599), p -> if((p + vec_id) % 97 = 0, cast(-9999 as float), cast(embedding[(p * 7 + vec_id) % 64] as float)))")
    return table(spark, sf, "embeddings").select(
        F.expr("concat('G', cast(vec_id as string))").alias("model_id"), F.expr("1762300800000 + vec_id * 3600000").alias("time_ms"),
        F.expr("case when label % 2 = 0 then 'channelized' else 'layered' end").alias("model_type"),
        *[c.alias(f"{a}_min") for a, c in low.items()], *[(c + F.lit(size[a])).alias(f"{a}_max") for a, c in low.items()],
        F.lit(20).alias("nx"), F.lit(18).alias("ny"), F.lit(10).alias("nz"), cell.alias("vals"))
