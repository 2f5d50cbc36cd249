"""Text files to facts, queries and exports, through the command line."""

from terraquery import cli
from terraquery.functions import codec
from terraquery.sources import catalog


def test_points_voxels_volumes_sensors(spark, tmp_path, capsys):
    root = str(tmp_path / "root")

    def run(*args):
        cli.main([args[0], "--root", root, "--dataset", "d", *map(str, args[1:])], spark)
        return capsys.readouterr().out

    pts = tmp_path / "p.csv"
    pts.write_text("sim_id,time,x,y,z,T,P,vx,vy,vz\n" + "\n".join(f"{i % 3}.0,2024-01-0{1 + i % 5}T00:00:00,{i},{i},{i},{300 + i},-,0.0001,0,0" for i in range(30)) + "\nbad\n")
    assert "'loaded': 30, 'failed': 1" in run("load", "point", pts)
    box, time = ("--bbox", -1, -1, -1, 20, 20, 20), ("--time-range", "2024-01-01T00:00:00", "2024-01-03T00:00:00")
    for engine in ("exact", "unified", "incremental"):
        for how in ("csv", "json", "txt"):
            run("sim-point", "--sim-id", "1", *box, *time, "--engine", engine, "--format", how, "--output-dir", tmp_path / f"o{engine}{how}")
            assert spark.read.text(str(tmp_path / f"o{engine}{how}")).count() == len([i for i in range(21) if i % 3 == 1 and i % 5 < 3])
    run("sim-point-temp", "--temp", 305, 310, *box, *time, "--output-dir", tmp_path / "temp")
    assert spark.read.text(str(tmp_path / "temp")).count() == 4
    run("sim-point-vel", "--vx", 0, 1, "--vy", 0, 0, "--vz", 1, 2, *box, *time, "--output-dir", tmp_path / "vel")
    assert spark.read.text(str(tmp_path / "vel")).count() == 0
    assert "hex" in run("diagnose", "point")

    vox = tmp_path / "v.tsv"
    vox.write_text("\n".join(f"1.0/2\t2024-01-01T00:00:00\t{i * 10}\t{i * 10 + 10}\t0\t10\t0\t5\t300\t-\t0\t0\t0" for i in [*range(-3, 9), 2]))
    assert "'loaded': 13" in run("load", "voxel", vox)
    for cells in ("exact", "indexed"):
        run("sim-voxel", "--sim-id", "1/2", *box, *time, "--cells", cells, "--output-dir", tmp_path / cells)
        assert spark.read.text(str(tmp_path / cells)).count() == 4

    vol = tmp_path / "m.tsv"
    vol.write_text("model_id\ttime\n" + "\t".join(["m", "2024-01-02T00:00:00Z", "t", "0", "0", "0", str(4 / 256), str(2 / 256), "7.8125", "4", "2", "1", codec.encode_one(range(8))]) + "\nm\tx\n")
    assert "'indexed': 1" in run("load", "volume", vol)
    run("volume", "--model-type", "t", *box, *time, "--nodata", "-9999", "--output-dir", tmp_path / "mask")
    row = spark.read.csv(str(tmp_path / "mask"), header=True).first()
    assert list(codec.decode_one(row["payload_b64"], 8)) == list(range(8)) and row["kept"] == "8"
    run("export-model", "--output-dir", tmp_path / "whole")
    assert spark.read.csv(str(tmp_path / "whole"), header=True).count() == 1

    sen = tmp_path / "s.csv"
    sen.write_text("2024-01-01T00:00:00,a,112,22,5,t\n2024-01-01T00:00:00,b,112,22,5,u\nx\n")
    assert "'loaded': 2" in run("load", "sensor", sen)
    run("spatial", "--sensor-id", "a", "--bbox", 111, 21, 0, 113, 23, 9, "--output-dir", tmp_path / "sensors")
    assert spark.read.csv(str(tmp_path / "sensors"), header=True).first()["ID"] == "a"
    assert "would drop" in run("drop-dataset") and catalog.tables(spark, root, "d")
    assert "dropped" in run("drop-dataset", "--force") and not catalog.tables(spark, root, "d")
