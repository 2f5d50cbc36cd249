"""Command line: ``python -m terraquery.cli COMMAND --root FOLDER --dataset NAME ...``."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from terraquery.functions.codec import encode_payload
from terraquery.operators import engines as E
from terraquery.operators import volume as V
from terraquery.plans import predicates as P
from terraquery.sources import catalog, exports, jobs

# Command names, and the attribute that each asks for.
POINT_COMMANDS = {"sim-point": "sim", "sim-point-temp": "temp", "sim-point-vel": "vel"}
VOXEL_COMMANDS = {"sim-voxel": "sim", "sim-voxel-temp": "temp", "sim-voxel-vel": "vel"}


def millis(text: str) -> int:
    """Epoch milliseconds of an ISO time; without a zone it is UTC."""
    t = datetime.fromisoformat(text)
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terraquery")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, query: bool = True, attr: str | None = None) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--root", required=True)
        p.add_argument("--dataset", required=True)
        if query:
            p.add_argument("--time-range", nargs=2, type=millis, metavar=("FROM", "TO"))
            p.add_argument("--bbox", nargs=6, type=float)
            p.add_argument("--engine", choices=E.ENGINES, default="unified")
            p.add_argument("--unified-level", type=int)
            p.add_argument("--format", choices=exports.FORMATS, default="csv")
            p.add_argument("--output-dir", required=True)
            p.add_argument("--with-header", action="store_true")
        if attr == "sim":
            p.add_argument("--sim-id", required=True)
        elif attr == "temp":
            p.add_argument("--temp", nargs=2, type=float, required=True)
        elif attr == "vel":
            for a in ("vx", "vy", "vz"):
                p.add_argument(f"--{a}", nargs=2, type=float, required=True)
        return p

    p = command("load", query=False)
    p.add_argument("family", choices=catalog.FAMILIES)
    p.add_argument("path")
    p.add_argument("--indexes", type=lambda t: t.split(","), help="index sets, each a sorted copy of the facts")
    command("tables", query=False)
    command("drop-dataset", query=False).add_argument("--force", action="store_true")
    p = command("diagnose", query=False)
    p.add_argument("family", choices=catalog.FAMILIES)
    p.add_argument("--rows", type=int, default=10)
    p = command("spatial")
    p.add_argument("--sensor-id")
    p.add_argument("--type")
    for name, attr in (POINT_COMMANDS | VOXEL_COMMANDS).items():
        p = command(name, attr=attr)
        if name in VOXEL_COMMANDS:
            p.add_argument("--cells", choices=("exact", "indexed"), default="exact")
    p = command("volume")
    p.add_argument("--model-type", required=True)
    p.add_argument("--nodata", type=float)
    command("export-model", query=False).add_argument("--output-dir", required=True)
    return top


def _attribute(a: argparse.Namespace, kind: str) -> dict:
    if kind == "sim":
        return {"sim_id": a.sim_id}
    if kind == "temp":
        return {"temp": P.Range(*a.temp)}
    return {"vel": tuple(P.Range(*getattr(a, v)) for v in ("vx", "vy", "vz"))}


#: The layout of stored facts that serves an attribute.
LAYOUT = {"sim": "unified", "temp": "temp_unified", "vel": "vel_unified"}


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The rows that a query command asks for."""
    time = P.TimeRange(*a.time_range) if getattr(a, "time_range", None) else None
    box = P.Box(*a.bbox) if getattr(a, "bbox", None) else None
    if a.command == "spatial":
        facts, _ = jobs.facts(spark, a.root, "sensor", a.dataset)
        conditions = [c for c in (a.sensor_id and P.IdEquals(a.sensor_id), a.type and P.TypeEquals(a.type), time, box) if c]
        return E.sensor_query(facts, conditions, a.engine, a.unified_level)
    if a.command == "export-model":
        facts, _ = jobs.facts(spark, a.root, "volume", a.dataset)
        return V.reassemble(facts)
    if time is None or box is None:
        raise SystemExit("--time-range and --bbox are needed")
    if a.command in POINT_COMMANDS:
        facts, bounds = jobs.facts(spark, a.root, "point", a.dataset, LAYOUT[POINT_COMMANDS[a.command]])
        return E.point_query(facts, bounds, time, box, engine=a.engine, level=a.unified_level or 9, **_attribute(a, POINT_COMMANDS[a.command])).select("raw_line")
    if a.command in VOXEL_COMMANDS:
        facts, grid = jobs.facts(spark, a.root, "voxel", a.dataset, LAYOUT[VOXEL_COMMANDS[a.command]])
        return E.voxel_query(facts, grid, time, box, engine=a.engine, level=a.unified_level or 4, mode=a.cells, **_attribute(a, VOXEL_COMMANDS[a.command])).select("raw_line")
    facts, _ = jobs.facts(spark, a.root, "volume", a.dataset)
    hits = V.volume_query(facts, a.model_type, time, box, a.engine)
    return V.reassemble(hits, box, a.nodata) if a.nodata is not None else exports.brick_rows(hits)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run a query command and write what it asks for."""
    df, how = result(spark, a), getattr(a, "format", "csv")
    if a.command == "spatial":
        # both forms and their number come from one run of the query
        df = df.persist(StorageLevel.DISK_ONLY)
        if how in ("json", "both"):
            exports.sensor_json(df).write.mode("overwrite").text(f"{a.output_dir}/json" if how == "both" else a.output_dir)
            exports.envelope(df).write.mode("overwrite").json(f"{a.output_dir.rstrip('/')}_summary")
        if how != "json":
            exports.write(exports.sensor_csv(df), f"{a.output_dir}/csv" if how == "both" else a.output_dir, "csv")
        df.unpersist()
    elif a.command in POINT_COMMANDS | VOXEL_COMMANDS:
        family = "point" if a.command in POINT_COMMANDS else "voxel"
        exports.write_raw(df, a.output_dir, how, jobs.header(spark, a.root, family, a.dataset), a.with_header)
    elif "vals" in df.columns:
        exports.write(df.withColumn("payload_b64", encode_payload("vals")).drop("vals"), a.output_dir, how if how != "txt" else "csv")
        if getattr(a, "nodata", None) is not None:
            exports.mask_report(df).write.mode("overwrite").text(f"{a.output_dir.rstrip('/')}_summary")
    else:
        exports.write(df, a.output_dir, how if how != "txt" else "csv")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "drop-dataset":
        for p in catalog.drop_dataset(spark, a.root, a.dataset, a.force):
            print(("dropped " if a.force else "would drop ") + p)
    elif a.command == "tables":
        for p in catalog.tables(spark, a.root, a.dataset):
            print(p)
    elif a.command == "load":
        print(jobs.LOADERS[a.family](spark, a.path, a.root, a.dataset, a.indexes))
    elif a.command == "diagnose":
        key = {"sensor": "row_key", "point": "dk", "voxel": "brick_key", "volume": "brick_key"}[a.family]
        catalog.diagnose(spark, catalog.path_of(a.root, a.family, a.dataset), key, a.rows).show(a.rows, False)
    else:
        export(spark, a)


if __name__ == "__main__":
    main()
