"""Scan alignment of whole pairs against a plain loop, and against the distributed rounds."""

import math

import numpy as np
import pytest

from poseweave.operators.alignment import align_scans, alignment_sums
from poseweave.operators.relations import Aligner, judge_relations, refine_odometry

SCAN = "run bigint, frame bigint, idx bigint, sx double, sy double"
PAIRS = "run bigint, i bigint, j bigint, dx double, dy double, dtheta double"


def plain_normals(scan, k=5):
    out = []
    for p in scan:
        near = scan[np.lexsort((np.arange(len(scan)), ((scan - p) ** 2).sum(axis=1)))[:k]]
        spread = near - near.mean(axis=0)
        out.append(np.linalg.eigh(spread.T @ spread)[1][:, 0])
    return np.array(out)


def plain_alignment(source, target, pose, rounds, within, tolerance=1e-9):
    """One pair, one point and one round after the other, by least squares on the rows themselves."""
    normal, residual, inliers, converged, n = plain_normals(target) if len(target) else [], math.inf, 0, False, 0
    x, y, t = pose
    for _ in range(rounds):
        n += 1
        a, b = [], []
        for px, py in source:
            mx, my = x + math.cos(t) * px - math.sin(t) * py, y + math.sin(t) * px + math.cos(t) * py
            gaps = [math.hypot(qx - mx, qy - my) for qx, qy in target]
            k = int(np.argmin(gaps)) if gaps else 0
            if gaps and gaps[k] < within:
                u, v = normal[k]
                a.append([u, v, v * mx - u * my])
                b.append(u * (target[k][0] - mx) + v * (target[k][1] - my))
        inliers = len(a)
        if inliers < 3:
            return (x, y, t), math.inf, inliers, False, n
        residual = float(np.median(np.abs(b)))
        dx, dy, turn = np.linalg.lstsq(np.array(a), np.array(b), rcond=1e-7)[0]
        x, y, t = (math.cos(turn) * x - math.sin(turn) * y + dx, math.sin(turn) * x + math.cos(turn) * y + dy,
                   math.atan2(math.sin(t + turn), math.cos(t + turn)))
        if math.hypot(dx, dy) + abs(turn) < tolerance:
            converged = True
            break
    return (x, y, t), residual, inliers, converged, n


def room(rng, n, pose):
    """``n`` points on the walls of a room with an alcove, seen from ``pose``."""
    walls = [((-4, -3), (4, -3)), ((4, -3), (4, 2)), ((4, 2), (1, 2)), ((1, 2), (1, 3.5)), ((1, 3.5), (-4, 3)), ((-4, 3), (-4, -3))]
    at = np.sort(rng.uniform(0, len(walls), n))
    points = np.array([np.add(np.multiply(walls[int(s)][0], 1 - s % 1), np.multiply(walls[int(s)][1], s % 1)) for s in at]).reshape(-1, 2)
    c, s = math.cos(pose[2]), math.sin(pose[2])
    d = points - np.array(pose[:2])
    return np.column_stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1]])


def scene(seed=3):
    rng = np.random.default_rng(seed)
    truth = [(0.05 * k, 0.03 * k, 0.02 * k) for k in range(14)]
    sizes = [40, 60, 55, 0, 41, 3, 2, 1, 70, 64, 90, 50, 33, 48]
    scans = [room(rng, n, p) for n, p in zip(sizes, truth)]
    scans[11] = scans[11] + 500.0  # nothing to match
    scans[12] = np.repeat(scans[12][:11], 3, axis=0)  # repeated points
    pairs = [(i, j) for i in range(14) for j in (i + 1, i + 4) if j < 14] + [(0, 13), (13, 0), (5, 5), (20, 1), (1, 20)]
    seeds = [(0, i, j, *map(float, rng.normal(scale=(.08, .08, .03)))) for i, j in pairs]
    # A scan of one point has no direction; as a target its normal is a convention.
    return scans, [s for s in seeds if s[1] != 7]


def frames(spark, scans):
    rows = [(0, f, k, float(x), float(y)) for f, scan in enumerate(scans) for k, (x, y) in enumerate(scan)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], SCAN).selectExpr("run", "cast(frame as bigint) frame", "cast(idx as bigint) idx", "sx", "sy")


def check(rows, scans, seeds, rounds, within):
    def at(frame):
        return scans[frame] if frame < len(scans) else np.zeros((0, 2))

    assert len(rows) == len(seeds)
    ended = 0
    for r in rows:
        seed = next(s for s in seeds if (s[1], s[2]) == (r.i, r.j))
        pose, residual, inliers, converged, n = plain_alignment(at(r.j), at(r.i), seed[3:], rounds, within)
        assert (r.inliers, r.converged, r.rounds) == (inliers, converged, n), (r, n)
        assert (r.dx, r.dy, r.dtheta) == pytest.approx(pose, abs=1e-6, rel=1e-6)
        assert r.residual == pytest.approx(residual, abs=1e-7, rel=1e-6)
        ended += converged
    return ended


def test_alignment_equals_a_plain_loop_to_the_end(spark):
    scans, seeds = scene()
    pairs = spark.createDataFrame(seeds, PAIRS)
    rows = align_scans(frames(spark, scans), pairs).collect()
    # Rounds near the tolerance depend on the last bits; everything else must agree.
    converged = [r for r in rows if r.converged]
    assert len(converged) >= 10 and all(r.rounds < 200 for r in converged)
    assert {(r.i, r.j) for r in rows if math.isinf(r.residual)} >= {(20, 1), (1, 20), (3, 4), (2, 3), (10, 11), (6, 7)}
    for r in rows:
        seed = next(s for s in seeds if (s[1], s[2]) == (r.i, r.j))
        source, target = (scans[f] if f < len(scans) else np.zeros((0, 2)) for f in (r.j, r.i))
        pose, residual, inliers, done, _ = plain_alignment(source, target, seed[3:], 200, 1.0)
        assert (r.inliers, r.converged) == (inliers, done), (r, pose)
        assert r.residual == pytest.approx(residual, abs=1e-7)
        assert (r.dx, r.dy, r.dtheta) == pytest.approx(pose, abs=1e-5)


@pytest.mark.parametrize("rounds, packed", [(1, 2048), (3, 2048), (3, 45)])
def test_alignment_rounds(spark, rounds, packed):
    """With ``packed`` 45 larger scans go through the distributed rounds; the pairs of both ways are all there."""
    scans, seeds = scene()
    rows = align_scans(frames(spark, scans), spark.createDataFrame(seeds, PAIRS), rounds, max_correspondence=0.8, packed_points=packed).collect()
    check(rows, scans, seeds, rounds, 0.8)


def test_both_ways_agree_on_quality(spark):
    scans, seeds = scene(5)
    points, pairs = frames(spark, scans), spark.createDataFrame(seeds, PAIRS)
    packed = {(r.i, r.j): r for r in align_scans(points, pairs, 2).collect()}
    spread = {(r.i, r.j): r for r in align_scans(points, pairs, 2, packed_points=0).collect()}
    assert packed.keys() == spread.keys()
    for key, a in packed.items():
        b = spread[key]
        for name in ("observability", "target_observability", "dx", "dtheta"):
            x, y = getattr(a, name), getattr(b, name)
            assert x == pytest.approx(y, abs=1e-7) or name == "observability" and a.inliers < 3, (key, name)


def test_sums_at_the_seeds(spark):
    scans, seeds = scene()
    got = {(r.i, r.j): r for r in alignment_sums(frames(spark, scans), spark.createDataFrame(seeds, PAIRS)).collect()}
    assert len(got) == len(seeds) and got[20, 1].inliers == 0 and got[20, 1].h00 == 0
    r = got[0, 1]
    assert r.h00 + r.h11 == pytest.approx(r.inliers)  # unit normals


def test_no_rounds_and_no_pairs(spark):
    scans, seeds = scene()
    points, pairs = frames(spark, scans), spark.createDataFrame(seeds, PAIRS)
    rows = align_scans(points, pairs, 0).collect()
    assert len(rows) == len(seeds) and all(math.isinf(r.residual) and not r.converged and r.rounds == 0 for r in rows)
    assert align_scans(points, pairs.where("run = 9")).collect() == []
    assert len(align_scans(points.where("run = 9"), pairs).collect()) == len(seeds)


def test_relations_under_the_default_limits(spark):
    """A dense room passes the default guards; the relation is the true motion."""
    rng = np.random.default_rng(1)
    truth = [(0.0, 0.0, 0.0), (0.2, 0.1, 0.05), (0.35, 0.1, -0.04)]
    walls = room(rng, 150, (0, 0, 0))
    scans = []
    for x, y, t in truth:
        c, s = math.cos(t), math.sin(t)
        d = walls - (x, y)
        scans.append(np.column_stack([c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1]]))
    points = frames(spark, scans)
    off = [(0.0, 0.0, 0.0), (0.25, 0.08, 0.07), (0.3, 0.15, -0.02)]
    poses = spark.createDataFrame([(0, f, *p) for f, p in enumerate(off)], "run bigint, frame bigint, x double, y double, theta double")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "run bigint, i bigint, j bigint")
    judged = judge_relations(points, poses, pairs).collect()
    assert all(r.reason is None and r.converged and r.inliers == 150 for r in judged)
    for r in judged:
        assert (r.dx, r.dy, r.dtheta) == pytest.approx(truth[r.j], abs=1e-6)
    motions = spark.createDataFrame([(0, 0, 1, 0.25, 0.08, 0.07)], PAIRS)
    out, counts = refine_odometry(points, poses.where("frame < 2"), motions)
    assert counts.first().refined == 1
    assert tuple(out.where("frame = 1").select("x", "y", "theta").first()) == pytest.approx(truth[1], abs=1e-6)


def test_distributed_rounds_tell_the_end(spark):
    scans, seeds = scene()
    rows = {(r.i, r.j): r for r in Aligner(frames(spark, scans)).align(spark.createDataFrame([s for s in seeds if s[1:3] in ((0, 13), (10, 11))], PAIRS), 3).collect()}
    assert not rows[10, 11].converged and rows[10, 11].rounds == 1 and math.isinf(rows[10, 11].residual)
    assert rows[0, 13].rounds == 3
