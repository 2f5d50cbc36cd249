"""Where the tables of a dataset lie, how they are laid out, and how one is dropped.

Everything goes through Spark's own file systems, so a dataset may lie on any of them.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquery.functions import codes as C
from terraquery.functions.codes import Bounds, Grid

# What a dataset may be called, the families, and the index sets of each.
NAME = re.compile(r"^[A-Za-z0-9_]+$")
FAMILIES = ("sensor", "point", "voxel", "volume")
INDEX_SETS = {"sensor": ("incremental", "unified"), "point": ("incremental", "unified", "temp_unified", "vel_unified"), "voxel": ("incremental", "unified", "temp_unified", "vel_unified", "vel_incremental"), "volume": ("unified",)}

#: By what column, before the code, the facts of an index set are sorted.
LEADING = {"sensor": {"unified": "sensor_id"}, "point": {"unified": "sim_id", "temp_unified": "temp_bucket", "vel_unified": None}, "voxel": {"unified": "sim_id", "temp_unified": "temp_bucket", "vel_unified": None}, "volume": {"unified": "model_type"}}
#: The three index columns of each family, whose Morton code sorts the facts.
AXES = {"sensor": ("ix", "iy", "iz"), "point": ("ix", "iy", "iz"), "voxel": ("ib", "jb", "kb"), "volume": ("gi", "gj", "gk")}


def checked(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"a dataset is named with letters, digits and underscores: {name!r}")
    return name


def path_of(root: str, family: str, dataset: str, table: str = "facts") -> str:
    """Folder of a table: ``root/family/dataset/table``."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    return f"{root}/{family}/{checked(dataset)}/{table}"


def index_sets(family: str, wanted: Sequence[str] | None) -> list[str]:
    """The known index sets of a list; all default ones where none is known, except for voxels."""
    known = [w for w in wanted or [] if w in INDEX_SETS[family]]
    if known:
        return known
    if wanted and family == "voxel":
        raise ValueError(f"index sets of voxels: {INDEX_SETS['voxel']}")
    return [w for w in ("incremental", "unified") if w in INDEX_SETS[family]]


def layouts(family: str, wanted: Sequence[str] | None) -> list[str]:
    """The sorted copies of the facts that index sets ask for; facts are always kept by ``unified``."""
    return ["unified", *[s for s in index_sets(family, wanted) if s in LEADING[family] and s != "unified"]]


def table_of(layout: str) -> str:
    return "facts" if layout == "unified" else f"facts_{layout}"


def month_of(day_bucket: str) -> Column:
    return F.floor(F.col(day_bucket) / 100).cast("int")


def month_cuts(days: DataFrame, rows: int, most: int) -> list[int]:
    """Last months of all but the last of the slices of about ``rows`` rows, ``most`` at most, by the column ``day_bucket``."""
    count = sorted((r[0], r[1]) for r in days.groupBy(month_of("day_bucket")).count().collect() if r[0] is not None)
    slices = min(most, -(-sum(n for _, n in count) // rows))
    cuts, seen, total = [], 0, sum(n for _, n in count)
    for month, n in count[:-1]:
        seen += n
        if seen * slices >= total * (len(cuts) + 1):
            cuts.append(month)
    return cuts[: max(slices - 1, 0)]


def write_facts(df: DataFrame, root: str, family: str, dataset: str, layout: str = "unified", partitions: int | None = None, row_group: int | None = None, cuts: Sequence[int] = ()) -> str:
    """Write facts by month, range-partitioned and sorted by attribute and Morton code.

    Rows that are near in space lie in the same row groups, whose bounds of index
    columns, code and day let a scan skip them; the range partition takes the place of
    region pre-splitting.  Codes of negative indices are those of their low bits, so they
    only affect the order.  ``row_group`` is the size of a row group in bytes, by default
    the writer's.  ``cuts`` are months that end a slice: slices are written one after the
    other, so that the shuffle files of one take room at a time, but the source of ``df`` is
    read for each.
    """
    path = path_of(root, family, dataset, table_of(layout))
    lead = LEADING[family][layout]
    index = [F.col(c).bitwiseAND(F.lit(C.MAX_INDEX)) for c in AXES[family]]
    df = df.withColumn("month", month_of("day_bucket")).withColumn("z_code", C.morton(*index))
    by = ["month", *([lead] if lead else []), "z_code"]
    for i in range(len(cuts) + 1):
        mine = F.lit(True)
        if i < len(cuts):
            mine = mine & (F.col("month") <= cuts[i])
        if i:
            mine = mine & (F.col("month") > cuts[i - 1])
        elif cuts:
            mine = mine | F.col("month").isNull()
        part = df.where(mine)
        part = part.repartitionByRange(partitions, *by) if partitions else part.repartitionByRange(*by)
        out = part.sortWithinPartitions(*by).write.mode("append" if i else "overwrite").partitionBy("month")
        (out.option("parquet.block.size", row_group) if row_group else out).parquet(path)
        if cuts:
            del part, out
            gc.collect()  # the shuffle files of what no one refers to are deleted
            df.sparkSession.sparkContext._jvm.System.gc()
    return path


def write_meta(spark: SparkSession, path: str, **parts: Bounds | Grid | dict | str | list | None) -> None:
    """Small metadata beside the facts, as one line of JSON."""
    text = json.dumps({k: asdict(v) if isinstance(v, (Bounds, Grid)) else v for k, v in parts.items()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    made = json.loads(spark.read.text(path).first()[0])
    if "bounds" in made:
        made["bounds"] = Bounds(**made["bounds"])
    if "grid" in made:
        made["grid"] = Grid(**{k: None if v is None else tuple(v) for k, v in made["grid"].items()})
    return made


def split_points(kind: str, n: int) -> list[int] | list[str]:
    """n-1 boundaries that cut a key space evenly.

    ``hex`` row keys, ``sensor`` ids of three digits, ``time`` by hours of the day, ``z``
    Morton codes, ``hash`` 31-bit hashes.
    """
    if n < 1:
        raise ValueError("at least one part")
    if kind == "hex":
        return [format(i * 65536 // n, "04x") for i in range(1, n)]
    if kind == "sensor":
        return [f"SENS_{i * 1000 // n:03d}" for i in range(1, n)]
    top = {"z": 1 << 3 * C.BITS, "hash": 1 << 31, "time": 86_400_000}[kind]
    return [i * top // n for i in range(1, n)]


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)


def tables(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """Folders of exactly this dataset, in every family."""
    return [p for f in sorted(FAMILIES) if exists(spark, p := f"{root}/{f}/{checked(dataset)}")]


def drop_dataset(spark: SparkSession, root: str, dataset: str, force: bool = False) -> list[str]:
    """Folders of a dataset; they are deleted only with ``force``."""
    found = tables(spark, root, dataset)
    if force:
        for p in found:
            fs, at = _files(spark, p)
            fs.delete(at, True)
    return found


def diagnose(spark: SparkSession, path: str, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` keys as hexadecimal and text."""
    return spark.read.parquet(path).select(F.hex(F.col(key).cast("string")).alias("hex"), F.col(key).cast("string").alias("text")).limit(n)
