"""Point-to-line alignment of scan pairs, all rounds of a pair in one task.

A scan is a bounded number of beams, so it travels as one packed row with the normals of its points.  A pair's two scans are
joined once; matching, the 3×3 solve and the stop test of all rounds run on padded arrays of many pairs.  The number of Spark jobs
does not depend on the number of rounds.  Scans of more than ``PACKED_POINTS`` points, which a row should not hold, are
aligned by the distributed rounds of :class:`poseweave.operators.relations.Aligner` instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.session import pin

PAIR = ["run", "i", "j"]
MOTION = ["dx", "dy", "dtheta"]
#: Points a packed scan holds at most, and distances computed at once.
PACKED_POINTS = 2048
DISTANCES_AT_ONCE = 1 << 18
SIDES = ("xs", "ys", "us", "vs")
RESULT = [*PAIR, *MOTION, "residual", "inliers", "observability", "target_observability", "converged", "rounds"]
RESULT_SCHEMA = ("run bigint, i bigint, j bigint, dx double, dy double, dtheta double, residual double, inliers bigint, "
                 "observability double, target_observability double, converged boolean, rounds bigint")
SUMS = ["h00", "h01", "h02", "h11", "h12", "h22", "g0", "g1", "g2"]


class Scans(NamedTuple):
    """Scans of different lengths side by side; ``there`` marks the real points."""

    x: np.ndarray
    y: np.ndarray
    there: np.ndarray


class Match(NamedTuple):
    """Nearest target points of all source points: moved position, normal, signed distance along it, and whether it counts."""

    x: np.ndarray
    y: np.ndarray
    u: np.ndarray
    v: np.ndarray
    gap: np.ndarray
    near: np.ndarray


def padded(rows: list[np.ndarray], blank: float) -> np.ndarray:
    out = np.full((len(rows), max((len(r) for r in rows), default=0)), blank)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def side_by_side(xs: list[np.ndarray], ys: list[np.ndarray], blank: float) -> Scans:
    there = padded([np.ones(len(x)) for x in xs], 0.0) > 0
    return Scans(padded(xs, blank), padded(ys, blank), there)


def chunks(costs: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers in groups, like sized together, of which the largest times their number stays within ``most``."""
    order = np.argsort(costs, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and costs[order[stop]] * (stop + 1 - start) <= most:
            stop += 1
        yield order[start:stop]
        start = stop


def eigenvalue_ratio(u: np.ndarray, v: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Smaller over larger eigenvalue of the summed outer products of the counted normals; NaN without any."""
    xx, xy, yy = (np.where(counted, a * b, 0.0).sum(axis=1) for a, b in ((u, u), (u, v), (v, v)))
    middle, half = (xx + yy) / 2, np.hypot((xx - yy) / 2, xy)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(middle + half > 0, (middle - half) / (middle + half), np.nan)


def normals(scans: Scans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals, turned to the sensor, from the ``k`` nearest points of each point (itself included; ties: the earlier)."""
    x, y, there = scans
    with np.errstate(invalid="ignore"):
        d2 = (x[:, :, None] - x[:, None, :]) ** 2 + (y[:, :, None] - y[:, None, :]) ** 2
    d2[~(there[:, :, None] & there[:, None, :])] = np.inf
    k = min(max(2, k), x.shape[1])
    rows = np.arange(len(x))[:, None, None]
    at = np.argsort(d2, axis=2, kind="stable")[:, :, :k]
    counted = there[rows, at]
    x, y = np.where(there, x, 0.0), np.where(there, y, 0.0)
    dx, dy = (np.where(counted, c[rows, at] - c[:, :, None], 0.0) for c in (x, y))
    n = np.maximum(counted.sum(axis=2), 1)
    sx, sy = dx.sum(axis=2), dy.sum(axis=2)
    xx, xy, yy = (dx * dx).sum(axis=2) - sx * sx / n, (dx * dy).sum(axis=2) - sx * sy / n, (dy * dy).sum(axis=2) - sy * sy / n
    phi = np.arctan2(2 * xy, xx - yy) / 2
    u, v = -np.sin(phi), np.cos(phi)
    sign = np.where(-u * x - v * y < -1e-9, -1.0, 1.0)
    return u * sign, v * sign


class Pairs:
    """Pairs of scans side by side, with the pose of each source in its target."""

    def __init__(self, target: Scans, u: np.ndarray, v: np.ndarray, source: Scans, pose: np.ndarray):
        self.target, self.u, self.v, self.source, self.pose = target, u, v, source, pose

    def of(self, rows: np.ndarray) -> Pairs:
        return Pairs(Scans(*(a[rows] for a in self.target)), self.u[rows], self.v[rows], Scans(*(a[rows] for a in self.source)), self.pose[rows])

    def matches(self, within: float) -> Match:
        dx, dy, turn = (self.pose[:, k, None] for k in range(3))
        c, s = np.cos(turn), np.sin(turn)
        x = dx + c * self.source.x - s * self.source.y
        y = dy + s * self.source.x + c * self.source.y
        if not self.target.x.shape[1]:
            zero = np.zeros_like(x)
            return Match(x, y, zero, zero, zero, np.zeros(x.shape, dtype=bool))
        d2 = (self.target.x[:, None, :] - x[:, :, None]) ** 2 + (self.target.y[:, None, :] - y[:, :, None]) ** 2
        at = d2.argmin(axis=2)
        near = (np.sqrt(np.take_along_axis(d2, at[:, :, None], axis=2)[:, :, 0]) < within) & self.source.there
        u, v, qx, qy = (np.take_along_axis(a, at, axis=1) for a in (self.u, self.v, self.target.x, self.target.y))
        gap = np.where(near, u * np.where(near, qx - x, 0.0) + v * np.where(near, qy - y, 0.0), 0.0)
        return Match(x, y, u, v, gap, near)


def equations(found: Match) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of the linearised step (shift and turn) of every pair."""
    rows = np.stack([found.u, found.v, found.v * found.x - found.u * found.y], axis=2) * found.near[:, :, None]
    return np.einsum("bnp,bnq->bpq", rows, rows), np.einsum("bnp,bn->bp", rows, found.gap)


def medians(values: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Median of the counted values of every row; infinite without any."""
    n = counted.sum(axis=1)
    ranked = np.sort(np.where(counted, values, np.inf), axis=1)
    if not ranked.shape[1]:
        return np.full(len(values), np.inf)
    low, high = (np.take_along_axis(ranked, np.maximum(r, 0)[:, None], axis=1)[:, 0] for r in ((n - 1) // 2, n // 2 - (n == 0)))
    return np.where(n > 0, (low + high) / 2, np.inf)


def refine(pairs: Pairs, max_iterations: int, tolerance: float, within: float) -> dict[str, np.ndarray]:
    """Align all pairs; those that stop leave the loop.

    A pair stops when its step is shorter than ``tolerance`` (the step is kept), or, with an infinite residual and its pose as it
    was, when fewer than three points match.  The residual is the median distance before the last step.
    """
    n = len(pairs.pose)
    pose, residual = pairs.pose.copy(), np.full(n, np.inf)
    inliers, rounds, converged = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    live = np.arange(n)
    part = pairs.of(live)
    for _ in range(max_iterations):
        if not len(live):
            break
        found = part.matches(within)
        count = found.near.sum(axis=1)
        h, g = equations(found)
        # The pseudo-inverse leaves directions no normal constrains untouched.
        step = np.einsum("bij,bj->bi", np.linalg.pinv(h, rcond=1e-13, hermitian=True), g)
        lost = count < 3
        c, s = np.cos(step[:, 2]), np.sin(step[:, 2])
        x, y, turn = part.pose.T
        moved = np.stack([c * x - s * y + step[:, 0], s * x + c * y + step[:, 1],
                          np.arctan2(np.sin(step[:, 2] + turn), np.cos(step[:, 2] + turn))], axis=1)
        part.pose = np.where(lost[:, None], part.pose, moved)
        short = ~lost & (np.hypot(step[:, 0], step[:, 1]) + np.abs(step[:, 2]) < tolerance)
        pose[live], inliers[live], converged[live] = part.pose, count, short
        residual[live] = np.where(lost, np.inf, medians(np.abs(found.gap), found.near))
        rounds[live] += 1
        on = np.flatnonzero(~(lost | short))
        if len(on) < len(live):
            live, part = live[on], part.of(on)
    final = Pairs(pairs.target, pairs.u, pairs.v, pairs.source, pose).matches(within)
    return {"dx": pose[:, 0], "dy": pose[:, 1], "dtheta": pose[:, 2], "residual": residual, "inliers": inliers,
            "observability": eigenvalue_ratio(final.u, final.v, final.near),
            "target_observability": eigenvalue_ratio(pairs.u, pairs.v, pairs.target.there), "converged": converged, "rounds": rounds}


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A list column as arrays; null is empty."""
    column = batch.column(name)
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if w else flat[:0] for a, b, w in zip(ends[:-1], ends[1:], whole)]


def _with_normals(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = _lists(batch, "xs"), _lists(batch, "ys")
            us, vs = [np.zeros(0)] * len(xs), [np.zeros(0)] * len(xs)
            for rows in chunks(np.array([len(x) ** 2 for x in xs]), DISTANCES_AT_ONCE):
                u, v = normals(side_by_side([xs[r] for r in rows], [ys[r] for r in rows], np.inf), k)
                for place, r in enumerate(rows):
                    us[r], vs[r] = u[place, : len(xs[r])], v[place, : len(xs[r])]
            made = [pa.array(rows, pa.list_(pa.float64())) for rows in (us, vs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "us", "vs"])

    return run


def pack(points: DataFrame, normal_neighbors: int = 5) -> DataFrame:
    """``(run, frame, xs, ys, us, vs)``: one row for each scan of ``points(run, frame, idx, sx, sy)``, by ``idx``, with normals."""
    one = F.sort_array(F.collect_list(F.struct("idx", "sx", "sy")))
    rows = points.groupBy("run", "frame").agg(one.alias("p")).select(
        F.col("run").cast("bigint").alias("run"), F.col("frame").cast("bigint").alias("frame"), F.col("p.sx").alias("xs"), F.col("p.sy").alias("ys"))
    lists = ", ".join(f"{c} array<double>" for c in SIDES)
    return rows.mapInArrow(_with_normals(normal_neighbors), f"run bigint, frame bigint, {lists}")


def _per_chunk(compute, fields: list[str]):
    """Apply ``compute(Pairs)`` to chunks of pairs of like size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = {name: _lists(batch, name) for name in [*SIDES, "sx", "sy"]}
            pose = np.stack([batch.column(m).to_numpy() for m in MOTION], axis=1)
            ids = [batch.column(c).to_numpy() for c in PAIR]
            costs = np.array([max(1, len(a)) * max(1, len(b)) for a, b in zip(parts["xs"], parts["sx"])])
            for rows in chunks(costs, DISTANCES_AT_ONCE):
                xs, ys, us, vs, sx, sy = ([parts[name][r] for r in rows] for name in [*SIDES, "sx", "sy"])
                target = side_by_side(xs, ys, np.inf)
                out = compute(Pairs(target, padded(us, 0.0), padded(vs, 0.0), side_by_side(sx, sy, 0.0), pose[rows]))
                arrays = [pa.array(c[rows]) for c in ids] + [
                    pa.array(out[f], mask=np.isnan(out[f])) if out[f].dtype.kind == "f" else pa.array(out[f]) for f in fields]
                yield pa.RecordBatch.from_arrays(arrays, [*PAIR, *fields])

    return run


def _joined(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair with its target and source; a frame without points leaves nulls.  A frame is one row, so hot frames can be split."""
    target = packed.select("run", F.col("frame").alias("i"), *SIDES)
    source = packed.select("run", F.col("frame").alias("j"), F.col("xs").alias("sx"), F.col("ys").alias("sy"))
    whole = pairs.select(*(F.col(c).cast("bigint").alias(c) for c in PAIR), *(F.col(m).cast("double").alias(m) for m in MOTION))
    return whole.join(target, ["run", "i"], "left").join(source, ["run", "j"], "left").select(*PAIR, *MOTION, *SIDES, "sx", "sy")


def align_scans(points: DataFrame, pairs: DataFrame, max_iterations: int = 200, tolerance: float = 1e-9, max_correspondence: float = 1.0,
                normal_neighbors: int = 5, packed_points: int = PACKED_POINTS) -> DataFrame:
    """Align scan j of ``points(run, frame, idx, sx, sy)`` onto scan i from the seeds ``pairs(run, i, j, dx, dy, dtheta)``.

    One row a pair: the refined motion, ``residual`` (median distance before the last step; infinite if fewer than three points
    match or no round was run), ``inliers``, ``observability`` of the matched normals, ``target_observability`` of all normals of scan i (null
    without normals), ``converged`` (the last step was short) and ``rounds``.  A frame without points matches nothing.
    """
    from poseweave.operators.relations import Aligner

    points = pin(points.select("run", "frame", "idx", "sx", "sy"), "align-points")
    large = pin(points.groupBy("run", "frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > packed_points).select("run", "frame"), "align-large")
    crowded = large.limit(1).count() > 0
    here = points.join(large, ["run", "frame"], "left_anti") if crowded else points
    if crowded:
        pairs = pin(pairs.select(*PAIR, *MOTION), "align-pairs")
        ends = [large.withColumnRenamed("frame", c) for c in ("i", "j")]
        apart = pin(pairs.join(ends[0], ["run", "i"], "left_semi").unionByName(
            pairs.join(ends[0], ["run", "i"], "left_anti").join(ends[1], ["run", "j"], "left_semi")), "align-pairs")
        pairs = pairs.join(apart.select(*PAIR), PAIR, "left_anti")
    packed = pin(pack(here, normal_neighbors), "align-packed")
    run = _per_chunk(lambda part: refine(part, max_iterations, tolerance, max_correspondence), RESULT[3:])
    out = _joined(packed, pairs).mapInArrow(run, RESULT_SCHEMA)
    if not crowded:
        return out
    frames = apart.select("run", F.explode(F.array("i", "j")).alias("frame")).distinct()
    aligner = Aligner(points.join(frames, ["run", "frame"], "left_semi"), max_correspondence, normal_neighbors)
    state = pin(aligner.align(apart, max_iterations, tolerance), "aligned")
    target = aligner.scan_observability().select("run", F.col("frame").alias("i"), F.col("observability").alias("target_observability"))
    rest = state.join(aligner.observability(state), PAIR, "left").join(target, ["run", "i"], "left")
    return out.unionByName(rest.select(*RESULT))


def alignment_sums(points: DataFrame, pairs: DataFrame, max_correspondence: float = 1.0, normal_neighbors: int = 5) -> DataFrame:
    """The normal equations of one round at the given motions, as :func:`align_scans` forms them: six ``h``, three ``g``, ``inliers``.

    All scans are packed, so each must be of moderate size.
    """
    def sums(part: Pairs) -> dict[str, np.ndarray]:
        found = part.matches(max_correspondence)
        h, g = equations(found)
        upper = {f"h{p}{q}": h[:, p, q] for p in range(3) for q in range(p, 3)}
        return upper | {f"g{p}": g[:, p] for p in range(3)} | {"inliers": found.near.sum(axis=1)}

    schema = "run bigint, i bigint, j bigint, " + ", ".join(f"{c} double" for c in SUMS) + ", inliers bigint"
    return _joined(pin(pack(points, normal_neighbors), "align-packed"), pairs).mapInArrow(_per_chunk(sums, [*SUMS, "inliers"]), schema)
