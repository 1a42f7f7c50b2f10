"""Revisit intervals and distances: equal to the list of pairs, and few for a robot that stands still."""

import math

import numpy as np
import pytest

from poseweave.operators import relations as L

POSES = "run bigint, frame bigint, x double, y double, theta double"
POINTS = "run bigint, frame bigint, idx bigint, gx double, gy double"


def table(spark, paths):
    rows = [(run, f, float(x), float(y), 0.0) for run, path in paths.items() for f, (x, y) in path.items()]
    return spark.createDataFrame(rows, POSES)


def paths(seed):
    rng = np.random.default_rng(seed)
    walk = np.cumsum(rng.normal(scale=.7, size=(150, 2)), axis=0)
    loops = np.column_stack([4 * np.cos(np.arange(150) / 6), 4 * np.sin(np.arange(150) / 6)])
    parked = np.repeat(walk[:10], 15, axis=0)
    rim = np.array([(2.0 * (k % 2), 0.0) for k in range(40)])  # exactly at the radius, which is outside
    whole = {1: walk, 2: loops, 3: parked, 4: rim}
    out = {run: dict(enumerate(path)) for run, path in whole.items()}
    out[5] = {f: p for f, p in enumerate(walk) if f % 7 and not 60 <= f < 90}  # frames are missing
    out[6] = {0: (0.0, 0.0)}
    return out


def pairs_by_definition(all_paths, gap, radius):
    return {(run, i, j) for run, path in all_paths.items() for j in path for i in path
            if i < j - gap and math.hypot(path[i][0] - path[j][0], path[i][1] - path[j][1]) < radius}


@pytest.mark.parametrize("gap, radius", [(5, 2.0), (0, 0.9), (30, 50.0)])
def test_intervals_expand_to_the_pairs(spark, gap, radius):
    given = paths(gap)
    poses = table(spark, given)
    want = pairs_by_definition(given, gap, radius)
    intervals = L.revisit_intervals(poses, gap, radius)
    rows = intervals.collect()
    got = [tuple(r) for r in L.expand_intervals(intervals, poses).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in L.revisit_pairs(poses, gap, radius).collect()} == want
    # As long as possible: the frame after an interval is not near, or not old enough.
    for r in rows:
        assert r.run == 5 or ((r.run, r.i_to + 1, r.j) not in want and (r.run, r.i_from - 1, r.j) not in want)


def test_a_parked_robot_has_one_interval_a_frame(spark):
    frames = 4000
    poses = spark.range(frames).selectExpr("0L as run", "id as frame", "1.5D as x", "-2.0D as y", "0.0D as theta")
    rows = L.revisit_intervals(poses, 10, 3.0)
    assert rows.count() == frames - 11
    assert rows.where("i_from <> 0 or i_to <> j - 11").count() == 0
    # Never more blocks than a few a level.
    assert L.disc_blocks(poses, 10, 3.0).count() < 3 * 6 * frames


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    given = {run: path for run, path in paths(seed).items() if run != 2}
    given = {run: {f: p for f, p in path.items() if f < 60} for run, path in given.items()}
    points = {(run, f, k): (float(p[0] + x), float(p[1] + y)) for run, path in given.items() for f, p in path.items()
              for k, (x, y) in enumerate(rng.uniform(-4, 4, (int(rng.integers(0, 4)), 2)))}
    world = spark.createDataFrame([(*key, *p) for key, p in points.items()], POINTS)
    want = {}
    old = {}
    for run, i, j in pairs_by_definition(given, 6, 2.0):
        old.setdefault((run, j), set()).add(i)
    for (run, f, k), (x, y) in points.items():
        gaps = [math.hypot(px - x, py - y) for (r, i, _), (px, py) in points.items() if r == run and i in old.get((run, f), ())]
        if gaps:
            want[run, f, k] = min(gaps)
    got = {(r.run, r.j, r.idx): r.distance for r in L.revisit_distances(world, table(spark, given), 6, 2.0).collect()}
    assert want and got.keys() == want.keys() and max(abs(got[key] - want[key]) for key in want) < 1e-12


def test_nothing_to_revisit(spark):
    poses = table(spark, {1: {0: (0.0, 0.0), 1: (9.0, 0.0)}})
    assert L.revisit_intervals(poses, 0, 1.0).collect() == [] and L.revisit_intervals(poses.where("run = 2"), 0, 1.0).collect() == []
    world = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 1, 0, 9.0, 0.0)], POINTS)
    assert L.revisit_distances(world, poses, 0, 1.0).collect() == []
