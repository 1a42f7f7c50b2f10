import math

import numpy as np
import pytest

from poseweave.operators import relations as L
from poseweave.operators.stability import gap_deviation, rigid_deviation, summarise_ensemble

POSES = "run bigint, frame bigint, x double, y double, theta double"
SCAN = "run bigint, frame bigint, idx bigint, sx double, sy double"


def poses(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rows)], POSES)


def test_pair_selection_examples(spark):
    line = poses(spark, [(5.0 * i, 0, 0) for i in range(10)] + [(0.5, 0, 0), (100, 0, 0)])
    assert [(r.i, r.j) for r in L.select_pairs(line, 5, 3.0, 1).collect()] == [(0, 10)]
    half = poses(spark, [(0.5 * i, 0, 0) for i in range(8)])
    band = L.select_pairs(half, 2, 1.2, 1, max_gap=2)
    assert sorted((r.i, r.j) for r in band.collect()) == [(i, i + 2) for i in range(6)]


@pytest.mark.parametrize("max_gap", [None, 40])
def test_pair_selection_equals_brute_force_when_parked(spark, max_gap):
    rng = np.random.default_rng(2)
    path = np.cumsum(rng.normal(scale=.4, size=(120, 2)), axis=0)
    path[30:80] = path[30]  # standing still for a long time: many exact ties
    df = poses(spark, [(*p, 0.0) for p in path])
    got = sorted((r.i, r.j) for r in L.select_pairs(df, 7, 2.0, 3, max_gap).collect())
    want = []
    for j in range(120):
        near = [(((path[i] - path[j]) ** 2).sum(), i) for i in range(0 if max_gap is None else max(0, j - max_gap), j - 7 + 1)]
        want += [(i, j) for d, i in sorted(n for n in near if math.sqrt(n[0]) < 2.0)[:3]]
    assert got == sorted(want)


def test_revisit_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    path = np.cumsum(rng.normal(scale=.8, size=(40, 2)), axis=0)
    path[10:25] = path[10]
    df = poses(spark, [(*p, 0.0) for p in path])
    points = spark.createDataFrame([(0, f, i, *map(float, rng.uniform(-6, 6, 2) + path[f])) for f in range(40) for i in range(3)],
                                   "run bigint, frame bigint, idx bigint, gx double, gy double")
    place = {(r.frame, r.idx): (r.gx, r.gy) for r in points.collect()}
    want = {}
    for j in range(40):
        old = [i for i in range(j - 5) if math.hypot(*(path[i] - path[j])) < 2.0]
        for idx in range(3) if old else ():
            x, y = place[j, idx]
            want[j, idx] = min(math.hypot(place[i, k][0] - x, place[i, k][1] - y) for i in old for k in range(3))
    got = {(r.j, r.idx): r.distance for r in L.revisit_distances(points, df, 5, 2.0).collect()}
    assert want and got.keys() == want.keys()
    assert max(abs(got[key] - want[key]) for key in want) < 1e-12
    score = L.revisit_score(points, df, 5, 2.0).first()
    assert score.median == pytest.approx(np.median(list(want.values()))) and score.frames == len({j for j, _ in want})


def l_scan(shift=(0.0, 0.0, 0.0)):
    walls = np.array([(0.1 * i, 0.0) for i in range(80)] + [(0.0, 0.1 * i) for i in range(1, 81)])
    c, s = math.cos(shift[2]), math.sin(shift[2])
    moved = walls - np.array(shift[:2])
    return np.column_stack([c * moved[:, 0] + s * moved[:, 1], -s * moved[:, 0] + c * moved[:, 1]])


def test_alignment_recovers_a_known_motion_and_reports_no_overlap(spark):
    truth = (0.4, -0.3, 0.15)
    scans = [l_scan(), l_scan(truth), l_scan() + 100.0]
    points = spark.createDataFrame([(0, f, i, float(x), float(y)) for f, s in enumerate(scans) for i, (x, y) in enumerate(s)], SCAN)
    pairs = spark.createDataFrame([(0, 0, 1, 0.6, -0.45, 0.2), (0, 0, 2, 0.0, 0.0, 0.0)],
                                  "run bigint, i bigint, j bigint, dx double, dy double, dtheta double")
    aligner = L.Aligner(points)
    rows = {r.j: r for r in aligner.align(pairs, max_iterations=20).collect()}
    assert (rows[1].dx, rows[1].dy, rows[1].dtheta) == pytest.approx(truth, abs=1e-6)
    assert rows[1].residual < 1e-6 and rows[1].inliers == 160
    assert math.isinf(rows[2].residual) and rows[2].inliers < 3
    seen = {r.frame: r.observability for r in aligner.scan_observability().collect()}
    assert seen[0] > 0.5


def test_corridor_is_poorly_observable(spark):
    walls = [(0.1 * i, y) for i in range(60) for y in (0.0, 2.0)]
    points = spark.createDataFrame([(0, 0, n, *p) for n, p in enumerate(walls)], SCAN)
    assert L.Aligner(points).scan_observability().first().observability < 0.05


def test_weights_and_guards(spark):
    # Two runs with medians 0.3 and 3: each is weighed against its own.
    spreads = [(run, k, scale * v) for run, scale in ((1, 1.0), (2, 10.0)) for k, v in enumerate([0.2, 0.3, 0.4, 3.0, 0.0])]
    df = spark.createDataFrame(spreads, "run bigint, k bigint, residual double")
    got = [r.weight for r in L.residual_weights(df).orderBy("run", "k").collect()]
    assert got == pytest.approx([2.25, 1, 0.5625, .25, 4] * 2)
    fields = "run bigint, i bigint, j bigint, dx double, dy double, dtheta double, seed_dx double, seed_dy double, " \
             "seed_dtheta double, residual double, inliers bigint, observability double"
    rows = [(0, 0, n, dx, 0.0, 0.0, 0.0, 0.0, 0.0, res, inl, obs) for n, (dx, res, inl, obs) in enumerate(
        [(0.1, .1, 60, .5), (9.0, .2, 10, .1), (9.0, .1, 10, .1), (9.0, .1, 60, .1), (0.8, .1, 60, .5)])]
    judged = L.guard(spark.createDataFrame(rows, fields)).orderBy("j").collect()
    assert [r.reason for r in judged] == [None, "residual", "inliers", "observability", "seed_deviation"]


def test_refined_odometry_falls_back_to_the_wheels(spark):
    truth, seed = (-0.3, 0.25, -0.12), (-0.2, 0.35, -0.09)
    scans = [l_scan(), l_scan(truth), l_scan() - 250.0]
    points = spark.createDataFrame([(0, f, i, float(x), float(y)) for f, s in enumerate(scans) for i, (x, y) in enumerate(s)], SCAN)
    start = poses(spark, [(0, 0, 0), seed, (1.0, 0, 0)])
    motions = spark.createDataFrame([(0, 0, 1, *seed), (0, 1, 2, 1.0, 0.0, 0.0)],
                                    "run bigint, i bigint, j bigint, dx double, dy double, dtheta double")
    out, counts = L.refine_odometry(points, start, motions, max_iterations=20)
    rows = out.orderBy("frame").collect()
    assert (rows[1].x, rows[1].y, rows[1].theta) == pytest.approx(truth, abs=1e-5)
    assert rows[2].x == pytest.approx(truth[0] + math.cos(truth[2]), abs=1e-5)
    assert (counts.first().refined, counts.first().pairs) == (1, 2)


def test_gauge_measures(spark):
    s = np.linspace(0, 3, 60)
    spiral = np.column_stack([(1 + s) * np.cos(s), (1 + s) * np.sin(s), s + .5])
    c, d = math.cos(.3), math.sin(.3)
    rigid = np.column_stack([c * spiral[:, 0] - d * spiral[:, 1] + 2, d * spiral[:, 0] + c * spiral[:, 1] - 1, spiral[:, 2] + .3])
    twist = spiral.copy()
    twist[:, 1] += 0.01 * np.arange(60) ** 1.5 / 5
    base = poses(spark, spiral)
    same = rigid_deviation({"a": base, "b": poses(spark, rigid)}).first()
    assert same.internal_max < 1e-9 < same.raw_mean
    gaps = {r.gap: r for r in gap_deviation({"a": base, "b": poses(spark, rigid)}, [1, 20]).collect()}
    assert gaps[20].max < 1e-9
    bent = {r.gap: r for r in gap_deviation({"a": base, "b": poses(spark, twist)}, [1, 20]).collect()}
    assert bent[20].mean > 5 * bent[1].mean


def test_ensemble_summary(spark):
    scores = spark.createDataFrame([(0, v) for v in (0.02, 0.05, 0.4, 0.03)], "run bigint, m double")
    row = summarise_ensemble(scores, ["run"], "m", 5.0).first()
    assert (row.best, row.diverged, row.n) == (0.02, 1, 4)
    assert row.spread == pytest.approx(0.38) and row.median == pytest.approx(0.04)
