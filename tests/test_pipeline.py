import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseweave.operators.residuals import Hallucination, Normals, ProblemOptions
from poseweave.operators.trajectory import odometry
from poseweave.operators.relations import revisit_score
from poseweave.plans.pipeline import ensemble_scores, make_grids, place, run_batch, run_config, run_incremental, run_summary
from poseweave.plans.solve import SolverOptions
from poseweave.sources.config import MapOptions, RunConfig, jittered
from poseweave.sources.textfiles import metrics_json
from poseweave.streaming.incremental import stream_incremental
from poseweave.streaming.odometry import stream_odometry
from tests.test_relations import SCAN, l_scan

POSES = "run bigint, frame bigint, x double, y double, theta double"
TRUTH = [(0.0, 0.0, 0.0), (0.4, -0.3, 0.15), (0.7, -0.2, 0.3)]


def scene(spark):
    points = [(0, f, i, float(x), float(y)) for f, at in enumerate(TRUTH) for i, (x, y) in enumerate(l_scan(at)[::4])]
    guess = [(0, f, x + .02 * f, y, t) for f, (x, y, t) in enumerate(TRUTH)]
    return spark.createDataFrame(points, SCAN), spark.createDataFrame(guess, POSES)


def settings(**changes):
    return RunConfig(dataset_dir="", increment_size=1, iterations_per_increment=1,
                     map=MapOptions(nx=9, ny=9, min=(-2.0, -2.0), max=(10.0, 10.0), init_from_scans=True),
                     problem=ProblemOptions(hallucination=Hallucination(2, .2, True), normals=Normals("pca", 6)),
                     solver=SolverOptions(max_iterations=1, lambda_init=.5), **changes)


def test_streamed_increments_equal_the_loop(spark, tmp_path):
    points, poses = scene(spark)
    config, snapshots = settings(snapshot_every=2), []
    loop = run_incremental(points, poses, config, on_snapshot=lambda frames, nodes, estimate: snapshots.append(frames))
    assert snapshots == [3]
    total = loop.control.first()
    history = total.cost_history
    # Every increment starts its history with its own initial cost.
    assert total.iterations == 2 and len(history) == 4
    assert history[0] == total.initial_cost and history[3] == total.final_cost
    assert history[1] < history[0] and history[3] < history[2] != history[1]
    folder, places = str(tmp_path / "scans"), {part: str(tmp_path / part) for part in ("state", "progress")}
    asked = (poses.where("frame = 0"), odometry(poses, ["run"]), make_grids(points, poses, config.map), config)
    points.where("frame < 2").coalesce(1).write.parquet(folder)
    first = stream_incremental(spark, folder, *asked, **places)
    assert first.poses.count() == 2
    # Stopped and called again: the stream goes on from its state and reads the new file only.
    written = set(os.listdir(tmp_path / "state" / "points"))
    points.where("frame = 2").coalesce(1).write.mode("append").parquet(folder)
    streamed = stream_incremental(spark, folder, *asked, **places)
    assert set(os.listdir(tmp_path / "state" / "points")) - written == {"1"}
    a = loop.poses.orderBy("frame").select("x", "y", "theta").toPandas().to_numpy()
    b = streamed.poses.orderBy("frame").select("x", "y", "theta").toPandas().to_numpy()
    assert a.shape == (3, 3) and np.abs(a - b).max() < 1e-9
    assert streamed.control.first().iterations == 2
    # Batches that are committed change nothing when they come again, under a checkpoint that has forgotten them.
    again = stream_incremental(spark, folder, *asked, state=places["state"], progress=str(tmp_path / "other"))
    assert np.array_equal(b, again.poses.orderBy("frame").select("x", "y", "theta").toPandas().to_numpy())
    assert again.control.first().iterations == 2


def test_configured_batch_run_writes_outputs(spark, tmp_path):
    points, poses = scene(spark)
    folder = tmp_path / "data"
    folder.mkdir()
    for f in range(3):
        rows = points.where(F.col("frame") == f).orderBy("idx").collect()
        (folder / f"scan{f}.pcd").write_text("FIELDS x y\nDATA ascii\n" + "".join(f"{r.sx!r} {r.sy!r}\n" for r in rows))
    (folder / "scanner_info.txt").write_text("".join(f"{r.x!r} {r.y!r} {r.theta!r}\n" for r in poses.orderBy("frame").collect()))
    (tmp_path / "truth.csv").write_text("x,y,theta\n" + "".join(f"{x},{y},{t}\n" for x, y, t in TRUTH))
    (tmp_path / "rel.csv").write_text("0,2,0.7,-0.2,0.3\n0,9,1,1,1\n")
    base = settings(ground_truth_poses=str(tmp_path / "truth.csv"), relations_file=str(tmp_path / "rel.csv"),
                    output_dir=str(tmp_path / "out"))
    result = run_config(spark, RunConfig(**{**base.__dict__, "dataset_dir": str(folder)}))
    report = result.control.first()
    assert report.final_cost < report.initial_cost
    document = json.loads(next((tmp_path / "out/text/metrics/run=0").glob("*.txt")).read_text())
    found = result.poses.orderBy("frame").select("x", "y").toPandas().to_numpy()
    apart = np.hypot(*(found - np.array(TRUTH)[:, :2]).T)
    assert document["mean_translation_error"] == pytest.approx(apart.mean()) and document["iterations"] == 1
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/text/map/file=0").glob("*.txt"))).splitlines()
    assert text[0].split()[:2] == ["9", "9"] and len(text) == 10
    assert spark.read.parquet(str(tmp_path / "out/poses_estimated")).count() == 3
    assert [r.y for r in spark.read.parquet(str(tmp_path / "out/poses_ground_truth")).orderBy("frame").collect()] == [t[1] for t in TRUTH]
    assert document["duration_seconds"] == report.duration_seconds > 0
    summary = run_summary(result, "here").collect()
    assert [(r.iterations, r.final_cost, r.duration_seconds, r.outputs) for r in summary] == [(1, report.final_cost, report.duration_seconds, "here")]
    # A run without ground truth keeps its report.
    other = result.control.withColumn("run", F.lit(7).cast("bigint"))
    errors = spark.createDataFrame([(0, 0.5, 3)], "run bigint, mean_translation_error double, frames bigint")
    told = {r.run: json.loads(r.json) for r in metrics_json(result.control.unionByName(other), errors, ["run"]).collect()}
    assert told[0]["mean_translation_error"] == 0.5 and "mean_translation_error" not in told[7] and told[7]["iterations"] == 1


def test_ensemble_members_side_by_side(spark):
    """Two members at once equal two configurations run one by one."""
    points, poses = scene(spark)
    config = RunConfig(**{**settings().__dict__, "mode": "batch"})
    got = {r.member: r.median for r in ensemble_scores(points, poses, config, 2, 3.0, 1, 5.0).collect()}
    for member in (0, 1):
        alone = run_batch(points, poses, jittered(config, "", 3.0 * member))
        assert got[member] == pytest.approx(revisit_score(place(points, alone.poses), alone.poses, 1, 5.0).first().median, abs=1e-12)
    assert got[0] != got[1]


EVENTS = "run bigint, ts bigint, scan bigint, dx double, dy double, dtheta double"


def test_streamed_odometry_spans_batches_and_rejects_late_frames(spark, tmp_path):
    rows = [(r, 10 * n, n, 1.0, 0.0, 0.1 * (r + 1)) for n in range(9) for r in range(2)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_micros("ts"))
    folder = str(tmp_path / "events")
    for low in (0, 3, 6):
        df.where(F.col("scan").between(low, low + 2)).coalesce(1).write.mode("append").parquet(folder)
    out = stream_odometry(spark, folder, lambda batch: batch, pattern="*.parquet").collect()
    assert len(out) == 18
    got = {(r.run, r.frame): (r.x, r.theta) for r in out}
    assert got[0, 8][0] == pytest.approx(sum(math.cos(0.1 * n) for n in range(9)))
    assert got[1, 8][1] == pytest.approx(1.8)
    df.where("scan = 1").coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="out of order"):
        stream_odometry(spark, folder, lambda batch: batch, pattern="*.parquet")
