"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings every query expects (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terraquery")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = "file://" + tempfile.mkdtemp(prefix="terraquery-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    Cuts the lineage, so that a narrow intermediate table which several later
    steps read is computed once and survives the loss of an executor.  What was
    written is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def plain(pdf):
    """A pandas frame whose text columns are plain objects.

    Arrow-backed text without a chunk, as an empty selection has, can't be sent back.
    """
    for c in pdf.columns:
        if str(pdf[c].dtype) in ("str", "string"):
            pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
    return pdf
