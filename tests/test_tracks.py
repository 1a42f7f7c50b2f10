"""Keyed state of the odometry stream: equal to the batch result, over stops, and never reordered."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseweave.operators.ordered import number_rows
from poseweave.operators.thinning import decimate
from poseweave.operators.trajectory import integrate
from poseweave.streaming.thinning import PROVIDER_KEY, stream_tracks

EVENTS = "run bigint, at bigint, scan bigint, dx double, dy double, dtheta double"


def steps(batch):
    return batch.withColumn("ts", F.timestamp_micros("at")).drop("at")


def events(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    runs = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 6, n))  # one run has half of all events
    rows = [(int(run), int(k // 2), k, float(rng.uniform(0, .4)), float(rng.normal(scale=.05)), float(rng.normal(scale=.1))) for k, run in enumerate(runs)]
    return rows


def write(spark, rows, folder):
    order = np.random.default_rng(0).permutation(len(rows))
    spark.createDataFrame([rows[k] for k in order], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are read by their time of writing


def test_stream_equals_the_batch_over_a_stop(spark, tmp_path):
    rows = events(spark, 1)
    folder, out, progress = (str(tmp_path / name) for name in ("events", "out", "progress"))
    for k in range(3):
        write(spark, rows[k * 100: (k + 1) * 100], folder)
    first = stream_tracks(spark, folder, steps, out, progress, 1.0, 0.3)
    assert first.count() == 300
    write(spark, rows[300:], folder)
    got = stream_tracks(spark, folder, steps, out, progress, 1.0, 0.3).toPandas().sort_values(["run", "frame"]).reset_index(drop=True)
    assert spark.conf.get(PROVIDER_KEY, None) is None or "RocksDB" not in spark.conf.get(PROVIDER_KEY)
    # Called again without new files, nothing is added.
    assert stream_tracks(spark, folder, steps, out, progress, 1.0, 0.3).count() == 400

    numbered = number_rows(spark.createDataFrame(rows, EVENTS), ["run"], ["at", "scan"], "frame")
    poses = integrate(numbered, ["run"], keep=["scan"])
    want = poses.toPandas().sort_values(["run", "frame"]).reset_index(drop=True)
    assert len(got) == 400 and (got[["run", "frame", "scan"]] == want[["run", "frame", "scan"]]).all().all()
    assert np.abs(got[["x", "y", "theta"]].to_numpy() - want[["x", "y", "theta"]].to_numpy()).max() < 1e-9
    kept = {tuple(r) for r in decimate(poses, 1.0, 0.3).collect()}
    assert {(r.run, r.frame) for r in got[got.kept].itertuples()} == kept and 10 < len(kept) < 390


def test_late_events_are_an_error(spark, tmp_path):
    rows = events(spark, 2, 60)
    folder = str(tmp_path / "events")
    write(spark, rows[30:], folder)
    write(spark, rows[:30], folder)
    with pytest.raises(Exception, match="frame out of order"):
        stream_tracks(spark, folder, steps, str(tmp_path / "out"), str(tmp_path / "progress"), 1.0, 0.3)
