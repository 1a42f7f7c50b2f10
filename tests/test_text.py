import pytest
from pyspark.sql import functions as F

from poseweave.sources import carmen, textfiles
from poseweave.sources.config import jittered, load_config, parse_config

HEADER = "# .PCD v0.7\nVERSION 0.7\nFIELDS i y x\nDATA ascii\n"


def lines(spark, text, name="f"):
    return spark.createDataFrame([(name, n, line) for n, line in enumerate(text.split("\n"))], "file string, line_no bigint, line string")


def test_pcd_fields_are_found_by_name(spark):
    rows = textfiles.parse_pcd(lines(spark, HEADER + "7 1.5 2.5 9\n\n 8  -1e-3\t4 0\n")).orderBy("idx").collect()
    assert [(r.idx, r.sx, r.sy) for r in rows] == [(0, 2.5, 1.5), (1, 4.0, -0.001)]


@pytest.mark.parametrize("text, message", [
    (HEADER.replace("ascii", "binary") + "1 2 3", "not text"), ("FIELDS x z\nDATA ascii\n1 2", "no columns"),
    ("FIELDS x y\n1 2", "no columns"), (HEADER + "1 2", "too short")])
def test_bad_pcd_raises(spark, text, message):
    with pytest.raises(Exception, match=message):
        textfiles.parse_pcd(lines(spark, text)).collect()


def test_pose_and_relation_lists(spark):
    poses = textfiles.parse_poses(lines(spark, "x,y,theta\n1,2,3\n\n4 5 6 7\n1 2\n")).orderBy("frame").collect()
    assert [(r.frame, r.x, r.theta) for r in poses] == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
    text = "i,j,dx,dy,dtheta,residual,inliers,weight\n0,1,1,0,0,0.1,50,4.0\n1,2,1,0,0,0.1,50\n0,2,2,0,0"
    assert [r.sqrt_weight for r in textfiles.parse_relations(lines(spark, text)).orderBy("line_no").collect()] == [2.0, 1.0, 1.0]
    with pytest.raises(Exception, match="zero or below"):
        textfiles.parse_relations(lines(spark, "0,1,1,0,0,0.1,50,0")).collect()


def test_dataset_folder_round_trip(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    for name, rows in (("scan2.pcd", "0 1 2\n0 3 4\n"), ("scan10.pcd", "0 5 6\n")):
        (folder / name).write_text(HEADER + rows)
    (folder / "scanner_info.txt").write_text("0 0 0\n1 0 0\n")
    points, poses = textfiles.load_dataset(spark, str(folder))
    # Name order, not number order.
    assert sorted((r.frame, r.idx, r.sx) for r in points.collect()) == [(0, 0, 6.0), (1, 0, 2.0), (1, 1, 4.0)]
    assert poses.count() == 2
    (folder / "scan3.pcd").write_text("")
    with pytest.raises(ValueError, match="are empty files"):
        textfiles.load_dataset(spark, str(folder))
    (folder / "scan3.pcd").write_text(HEADER)
    with pytest.raises(ValueError, match="scans and"):
        textfiles.load_dataset(spark, str(folder))


def test_written_lines_stay_in_order(spark, tmp_path):
    rows = spark.range(50).select(F.lit("a").alias("run"), "id", (F.col("id") / 3).alias("x"))
    textfiles.write_lines(textfiles.render_csv(rows, "run", "id", ["id", "x"]), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "file=a").glob("*.txt"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text[0] == "id,x" and [int(t.split(",")[0]) for t in text[1:]] == list(range(50))


def test_carmen_messages(spark):
    tail = "3 4.5 60.0 0.8 -7.5 0.25 -1.5 -7.0 0.5 -1.25 12.125 robot 3.5"
    text = f"FLASER {tail}\nODOM 1 2 3\nROBOTLASER1 0 -1.5 3.14 0.01 80 0.01 0 {tail}"
    rows = carmen.parse_lasers(lines(spark, text)).orderBy("line_no").collect()
    assert len(rows) == 2
    for row in rows:
        assert row.readings == [4.5, 60.0, 0.8] and row.stamp == "12.125"
        assert (row.x, row.y, row.theta, row.ox, row.oy, row.otheta) == (-7.5, 0.25, -1.5, -7.0, 0.5, -1.25)
    points, poses = carmen.convert(carmen.parse_lasers(lines(spark, text)), max_range=49.0)
    assert poses.count() == 1 and points.count() == 2
    first = points.where("idx = 0").first()
    assert (first.sx, first.sy) == pytest.approx((0.0, -4.5), abs=1e-12)


def test_logs_with_equal_stamps_stay_apart(spark):
    row = "FLASER 1 2.0 {x} 0 0 {x} 0 0 {t} host 0"
    logs = [(str(run), k, row.format(x=10 * run + k, t=k)) for run in (1, 2) for k in range(3)]
    messages = carmen.parse_lasers(spark.createDataFrame(logs, "file string, line_no bigint, line string")).withColumn("run", F.col("file").cast("bigint"))
    relations = spark.createDataFrame([(1, "r", 0, "0 2 1.5 0 0 0 0 0.25"), (2, "r", 1, "1 2 0.5 0 0 0 0 0.125")],
                                      "run bigint, file string, line_no bigint, line string")
    _, poses = carmen.convert(messages, min_travel=100.0, min_turn=9.0, wanted=carmen.relation_stamps(relations))
    found = carmen.index_relations(relations, poses.select("run", "frame", "at")).collect()
    assert sorted((r.run, r.line_no, r.i, r.j, r.dx) for r in found) == [(1, 0, 0, 1, 1.5), (2, 1, 1, 2, 0.5)]


def test_config_is_strict(tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text("dataset_dir: d\nmode: incremental\nhuber_delta: 0.5\nmap:\n  nx: 7\n  min: [-1, -2]\nsolver:\n  lambda_init: 5.0\n"
                    "normals:\n  method: pca\n")
    config = load_config(str(path))
    assert (config.mode, config.map.nx, config.map.min, config.problem.huber_delta) == ("incremental", 7, (-1.0, -2.0), 0.5)
    assert config.problem.normals.method == "pca" and config.problem.normals.k_neighbors == 10
    assert jittered(config, "o", 1e-9).solver.lambda_init == 5.0 * (1 + 1e-9)
    for bad in ({}, {"dataset_dir": "d", "nope": 1}, {"dataset_dir": "d", "map": {"nz": 1}}, {"dataset_dir": "d", "mode": "x"},
                {"dataset_dir": "d", "solver": {"backend": "y"}}, {"dataset_dir": "d", "solver": {"no_such_option": 1}}):
        with pytest.raises(ValueError):
            parse_config(bad)


def test_snapshots_keep_every_nth_and_the_last(spark):
    files = spark.createDataFrame([(f"map_{n:06d}.txt",) for n in range(2, 13)] + [("poses_000002.csv",)], "file string")
    assert sorted(r.frames for r in textfiles.snapshot_choice(files, 4).collect()) == [2, 6, 10, 12]
