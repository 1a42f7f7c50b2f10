"""Loop-closure operators: pair selection, scan alignment, guards, weights and scores.

A relation is ``(run, i, j, dx, dy, dtheta)``: frame j seen from frame i.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poseweave.functions.linalg import clamp, symmetric_eigen
from poseweave.functions.pose import Pose, apply, pose, pose_error, relative
from poseweave.operators.alignment import align_scans
from poseweave.operators.neighbors import PACKED_POINTS, CellTree, build_tree, nearest
from poseweave.operators.normals import pca_normals
from poseweave.operators.ordered import quantiles
from poseweave.session import pin

PAIR = ["run", "i", "j"]
MOTION = ("dx", "dy", "dtheta")


def dyadic_home(frames: DataFrame, frame: str, top: int) -> DataFrame:
    """Every row once per level: block ``span`` of size 2^level that contains its frame."""
    rows = frames.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return rows.withColumn("span", F.floor(F.col(frame) / F.pow(F.lit(2.0), F.col("level"))))


def dyadic_cover(queries: DataFrame, low: Column, high: Column, top: int) -> DataFrame:
    """Split the frame range [low, high) into disjoint blocks ``(level, span)``, at most two per level."""
    rows = queries.withColumns({"_lo": low, "_hi": high}).withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    size = F.pow(F.lit(2.0), F.col("level"))
    rows = rows.withColumns({"_l": F.ceil(F.col("_lo") / size), "_r": F.floor(F.col("_hi") / size)})
    left = F.when(F.col("_l") % 2 == 1, F.col("_l"))
    right = F.when(F.col("_r") % 2 == 1, F.col("_r") - 1)
    rows = rows.where(F.col("_l") < F.col("_r")).withColumn("span", F.explode(F.array(left, right)))
    return rows.where("span IS NOT NULL").drop("_lo", "_hi", "_l", "_r")


def top_level(frames: DataFrame, frame: str = "frame") -> int:
    last = frames.agg(F.max(frame)).first()[0] or 0
    return max(0, math.ceil(math.log2(last + 1))) if last else 0


def select_pairs(poses: DataFrame, min_gap: int, radius: float, per_frame: int,
                 max_gap: int | None = None) -> DataFrame:
    """For every frame j the ``per_frame`` nearest old frames i with min_gap ≤ j - i ≤ max_gap and distance < radius.

    The allowed frame range is covered by dyadic blocks with one cell tree each, so a robot that
    stands still for most of the log never has its frames compared pairwise.
    """
    top = top_level(poses)
    group = ["run", "level", "span"]
    poses = pin(poses.select("run", "frame", "x", "y"), "pair-poses")
    points = dyadic_home(poses.select("run", F.col("frame").alias("i"), "x", "y"), "i", top)
    tree = build_tree(points, group, ["i"], copies=per_frame, stored=True, packed_points=PACKED_POINTS)
    low = F.greatest(F.lit(0), F.col("j") - max_gap) if max_gap is not None else F.lit(0)
    asked = dyadic_cover(poses.select("run", F.col("frame").alias("j"), "x", "y"), low, F.col("j") - min_gap + 1, top)
    found = nearest(asked, ["j"], tree, per_frame, ["i"], ["i"], within=radius)
    best = F.row_number().over(Window.partitionBy("run", "j").orderBy("d2", "n_i"))
    return found.withColumn("_best", best).where(F.col("_best") <= per_frame).select(
        "run", F.col("n_i").alias("i"), "j", F.sqrt("d2").alias("distance"))


def _pose_bucket(radius: float, x: str = "x", y: str = "y") -> dict[str, Column]:
    return {"bx": F.floor(F.col(x) / radius), "by": F.floor(F.col(y) / radius)}


def _around(rows: DataFrame) -> DataFrame:
    ring = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return rows.withColumn("_a", F.explode(ring)).withColumn("_b", F.explode(ring)).withColumns(
        {"bx": F.col("bx") + F.col("_a"), "by": F.col("by") + F.col("_b")}).drop("_a", "_b")


def revisit_pairs(poses: DataFrame, min_gap: int, radius: float) -> DataFrame:
    """All (i, j) with i < j - min_gap and pose distance < radius; the list itself is the result.

    Scores do not build on this list where it would be long, see :func:`revisit_distances`.
    """
    base = poses.select("run", "frame", "x", "y").withColumns(_pose_bucket(radius))
    old = base.toDF("run", "i", "ix", "iy", "bx", "by")
    late = _around(base.where(F.col("frame") >= min_gap)).withColumnRenamed("frame", "j")
    near = F.hypot(F.col("ix") - F.col("x"), F.col("iy") - F.col("y")) < radius
    return late.join(old, ["run", "bx", "by"]).where((F.col("i") < F.col("j") - min_gap) & near).select(*PAIR)


#: Frames of a block are ``BASE`` blocks of the level below.
BASE = 4


def _block_size(level: Column) -> Column:
    return F.pow(F.lit(float(BASE)), level).cast("bigint")


def disc_blocks(poses: DataFrame, min_gap: int, radius: float) -> DataFrame:
    """``(run, j, level, span)``: disjoint blocks of frames i < j - min_gap, together all whose pose is within ``radius`` of that of j.

    A block holds the frames ``span * 4^level … (span + 1) * 4^level - 1`` of a run, with the bounding box of their poses.  The frames before
    ``j - min_gap`` are a few blocks a level; a block whose box is within the radius is taken whole, one beyond it dropped, any other
    replaced by its parts, a frame at last.  A robot that stands still has boxes of no size, so nothing is refined, however long it
    stands.  Joins are equi-joins on the block, one a level.
    """
    base = pin(poses.select("run", "frame", "x", "y"), "disc-poses")
    last = base.agg(F.max("frame")).first()[0] or 0
    top = max(0, math.ceil(math.log(last + 1, BASE)))
    homes = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    homes = homes.withColumn("span", F.floor(F.col("frame") / _block_size(F.col("level"))))
    boxes = pin(homes.groupBy("run", "level", "span").agg(F.min("x").alias("lo_x"), F.max("x").alias("hi_x"),
                                                           F.min("y").alias("lo_y"), F.max("y").alias("hi_y")), "disc-boxes")
    end = F.col("j") - min_gap
    asked = base.where(F.col("frame") > min_gap).select("run", F.col("frame").alias("j"), "x", "y").withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    first, stop = F.floor(end / _block_size(F.col("level") + 1)) * BASE, F.floor(end / _block_size(F.col("level")))
    cover = pin(asked.where(first < stop).withColumn("span", F.explode(F.sequence(first, stop - 1))), "disc-cover")

    def reach(axis: str) -> tuple[Column, Column]:
        low, high = F.col(axis) - F.col(f"lo_{axis}"), F.col(f"hi_{axis}") - F.col(axis)
        return F.greatest(F.lit(0.0), -low, -high), F.greatest(F.abs(low), F.abs(high))

    (near_x, far_x), (near_y, far_y) = reach("x"), reach("y")
    taken, rest = None, None
    for level in range(top, -1, -1):
        now = cover.where(F.col("level") == level)
        now = now if rest is None else now.unionByName(rest)
        seen = now.join(boxes.where(F.col("level") == level).drop("level"), ["run", "span"]).where(F.hypot(near_x, near_y) < radius)
        seen = pin(seen.withColumn("whole", F.hypot(far_x, far_y) < radius).select("run", "j", "x", "y", "level", "span", "whole"), "disc")
        found = seen.where("whole").select("run", "j", "level", "span")
        taken = found if taken is None else taken.unionByName(found)
        parts = F.sequence(F.col("span") * BASE, F.col("span") * BASE + BASE - 1)
        rest = seen.where("not whole").select("run", "j", "x", "y", (F.col("level") - 1).alias("level"), F.explode(parts).alias("span"))
    return taken


def revisit_intervals(poses: DataFrame, min_gap: int, radius: float) -> DataFrame:
    """``(run, j, i_from, i_to)``: the longest runs of frames i < j - min_gap whose poses are all within ``radius`` of that of j.

    The rows of a frame are as many as the robot's visits, whatever their length.  Frames that a run does not have end no interval
    within a block; :func:`expand_intervals` gives those that exist.
    """
    blocks = disc_blocks(poses, min_gap, radius)
    size = _block_size(F.col("level"))
    ends = blocks.select("run", "j", (F.col("span") * size).alias("a"), ((F.col("span") + 1) * size - 1).alias("b"))
    order = Window.partitionBy("run", "j").orderBy("a")
    opens = F.coalesce(F.lag("b").over(order) + 1 < F.col("a"), F.lit(True)).cast("int")
    numbered = ends.withColumn("_opens", opens).withColumn("_visit", F.sum("_opens").over(order))
    return numbered.groupBy("run", "j", "_visit").agg(F.min("a").alias("i_from"), F.max("b").alias("i_to")).drop("_visit")


def expand_intervals(intervals: DataFrame, poses: DataFrame) -> DataFrame:
    """All pairs ``(run, i, j)`` of :func:`revisit_intervals`, for those who need the list itself."""
    pairs = intervals.select("run", F.explode(F.sequence("i_from", "i_to")).alias("i"), "j")
    return pairs.join(poses.select("run", F.col("frame").alias("i")), ["run", "i"], "left_semi").select(*PAIR)


def revisit_distances(world: DataFrame, poses: DataFrame, min_gap: int, radius: float) -> DataFrame:
    """Distance of every point of frame j to the nearest point of its revisited old frames.

    ``world`` is ``(run, frame, idx, gx, gy)``; output ``(run, j, idx, distance)``.  The old frames of j are the blocks of
    :func:`disc_blocks`; the points of every block that some frame takes have one tree, which is asked for one neighbour, once.  No pool
    of old points is copied for a frame, however many there are.
    """
    group = ["run", "level", "span"]
    blocks = pin(disc_blocks(poses, min_gap, radius), "revisit-blocks")
    points = pin(world.select("run", "frame", "idx", F.col("gx").alias("x"), F.col("gy").alias("y")), "revisit-points")
    wanted = blocks.select(*group).distinct()
    levels = [r["level"] for r in blocks.select("level").distinct().collect()]
    homes = points.withColumn("level", F.explode(F.array(*(F.lit(n) for n in sorted(levels)))) if levels else F.lit(0))
    homes = homes.withColumn("span", F.floor(F.col("frame") / _block_size(F.col("level")))).join(wanted, group, "left_semi")
    tree = build_tree(homes.select(*group, F.col("frame").alias("i"), "idx", "x", "y"), group, ["i", "idx"], copies=1,
                      packed_points=PACKED_POINTS)
    asking = points.select("run", F.col("frame").alias("j"), F.col("idx").alias("q"), "x", "y").join(blocks, ["run", "j"])
    found = nearest(asking, ["j", "q"], tree, 1, ["i", "idx"], ["i"], block_rows=None)
    return found.groupBy("run", "j", F.col("q").alias("idx")).agg(F.sqrt(F.min("d2")).alias("distance"))


def revisit_score(world: DataFrame, poses: DataFrame, min_gap: int, radius: float) -> DataFrame:
    """Median, 90th percentile and number of revisiting frames per run."""
    distances = pin(revisit_distances(world, poses, min_gap, radius), "distances")
    score = quantiles(distances, ["run"], "distance", {"median": 0.5, "p90": 0.9})
    frames = distances.select("run", "j").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("frames"))
    return score.join(frames, "run")


def seeds(pairs: DataFrame, poses: DataFrame) -> DataFrame:
    """Relative pose of j in i for every pair, from the given estimate."""
    ends = pairs.select(*PAIR).join(poses.select("run", F.col("frame").alias("i"), *pose().named("p")), ["run", "i"]).join(
        poses.select("run", F.col("frame").alias("j"), *pose().named("q")), ["run", "j"])
    motion = relative(pose("p"), pose("q"))
    return ends.select(*PAIR, *[c.alias(n) for c, n in zip(motion, MOTION)])


class Aligner:
    """Point-to-line alignment of scan j onto scan i for many pairs at once.

    Every round is one nearest-point join and one aggregation to six sums per pair; only the 3×3
    solves run in Python, vectorised over pairs.
    """

    def __init__(self, points: DataFrame, max_correspondence: float = 1.0, normal_neighbors: int = 5):
        self.points = pin(points.select("run", "frame", "idx", "sx", "sy"), "icp-points")
        local = self.points.select("run", "frame", "idx", F.col("sx").alias("x"), F.col("sy").alias("y"),
                                   F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"))
        self.normals = pin(pca_normals(local, ["run", "frame"], ["run", "frame", "idx"], normal_neighbors, ("ox", "oy")), "icp-normals")
        target = self.normals.select("run", F.col("frame").alias("i"), "idx", "x", "y", "normal_x", "normal_y")
        self.tree: CellTree = build_tree(target, ["run", "i"], ["idx"], leaf_rows=16, copies=1, packed_points=PACKED_POINTS)
        self.max_correspondence = max_correspondence

    def matches(self, state: DataFrame) -> DataFrame:
        """Inlier correspondences under the pair transforms ``(dx, dy, dtheta)``.

        ``idx`` is the source point, ``n_*`` the matched target point, ``gap`` the signed distance
        along the target normal.
        """
        source = self.points.withColumnRenamed("frame", "j").join(state.select(*PAIR, *MOTION), ["run", "j"])
        x, y = apply(Pose(*(F.col(m) for m in MOTION)), F.col("sx"), F.col("sy"))
        moved = source.select(*PAIR, "idx", x.alias("x"), y.alias("y"))
        found = nearest(moved, ["j", "idx"], self.tree, 1, ["idx"], ["idx", "x", "y", "normal_x", "normal_y"],
                        within=self.max_correspondence, block_rows=None)
        gap = F.col("n_normal_x") * (F.col("n_x") - F.col("x")) + F.col("n_normal_y") * (F.col("n_y") - F.col("y"))
        return found.withColumn("gap", gap)

    def align(self, pairs: DataFrame, max_iterations: int = 200, tolerance: float = 1e-9) -> DataFrame:
        """Refine seeds ``(run, i, j, dx, dy, dtheta)``; adds ``residual, inliers, converged, rounds``.

        The residual is the median distance before the last step; fewer than three inliers give an
        infinite residual and leave the transform as it was.
        """
        nothing = [F.lit(0).cast("bigint").alias("inliers"), F.lit(False).alias("lost"), F.lit(False).alias("done"), F.lit(0).cast("bigint").alias("rounds")]
        live = pin(pairs.select(*PAIR, *MOTION, *[F.col(m).alias(f"before_{m}") for m in MOTION], *nothing), "icp")
        settled = live.where(F.lit(False))
        for _ in range(max_iterations):
            sums = self._normal_sums(self.matches(live))
            joined = live.drop("inliers").join(sums, PAIR, "left").fillna(0)
            live = pin(joined.mapInPandas(_align_step(tolerance), live.schema), "icp")
            finished = live.where("done")
            if finished.limit(1).count():
                settled = pin(settled.unionByName(finished), "icp")
                live = pin(live.where("not done"), "icp")
            if live.limit(1).count() == 0:
                break
        state = settled.unionByName(live)
        before = state.where("not lost").select(*PAIR, *[F.col(f"before_{m}").alias(m) for m in MOTION])
        gaps = self.matches(before).withColumn("gap", F.abs("gap"))
        medians = quantiles(gaps, PAIR, "gap", {"residual": 0.5})
        return state.join(medians, PAIR, "left").select(
            *PAIR, *MOTION, F.when(F.col("lost") | (F.col("rounds") == 0), F.lit(float("inf"))).otherwise(F.col("residual")).alias("residual"),
            "inliers", (F.col("done") & ~F.col("lost")).alias("converged"), "rounds")

    @staticmethod
    def _normal_sums(matches: DataFrame) -> DataFrame:
        a = {"0": "n_normal_x", "1": "n_normal_y", "2": "(n_normal_y * x - n_normal_x * y)"}
        names = list(a)
        sums = [F.expr(f"sum({a[p]} * {a[q]}) AS h{p}{q}") for p in names for q in names if p <= q]
        sums += [F.expr(f"sum({a[p]} * gap) AS g{p}") for p in names]
        return matches.groupBy(*PAIR).agg(*sums, F.count(F.lit(1)).alias("inliers"))

    def observability(self, aligned: DataFrame) -> DataFrame:
        """How well the matched target normals pin both translations, per pair."""
        return observability(self.matches(aligned), PAIR, "n_normal_x", "n_normal_y")

    def scan_observability(self) -> DataFrame:
        """The same measure over all normals of a scan."""
        return observability(self.normals, ["run", "frame"], "normal_x", "normal_y")


def observability(normals: DataFrame, group: list[str], nx: str, ny: str) -> DataFrame:
    """Eigenvalue ratio (min/max) of the summed outer products of unit normals."""
    sums = normals.groupBy(*group).agg(F.sum(F.col(nx) * F.col(nx)).alias("xx"), F.sum(F.col(nx) * F.col(ny)).alias("xy"),
                                       F.sum(F.col(ny) * F.col(ny)).alias("yy"))
    eig = symmetric_eigen(F.col("xx"), F.col("xy"), F.col("yy"))
    return sums.select(*group, (eig.low / F.nullif(eig.high, F.lit(0.0))).alias("observability"))


def _align_step(tolerance: float):
    """Solve the 3×3 systems of a batch of pairs and left-multiply the steps."""

    def run(batches):
        for pdf in batches:
            h = np.empty((len(pdf), 3, 3))
            for p in range(3):
                for q in range(p, 3):
                    h[:, p, q] = h[:, q, p] = pdf[f"h{p}{q}"]
            g = pdf[["g0", "g1", "g2"]].to_numpy()
            # The pseudo-inverse leaves directions no normal constrains untouched.
            step = np.einsum("nij,nj->ni", np.linalg.pinv(h, rcond=1e-13, hermitian=True), g) if len(pdf) else g
            lost = pdf.inliers.to_numpy() < 3
            step[lost] = 0.0
            c, s = np.cos(step[:, 2]), np.sin(step[:, 2])
            x, y, t = (pdf[m].to_numpy() for m in MOTION)
            angle = np.where(lost, t, np.arctan2(np.sin(step[:, 2] + t), np.cos(step[:, 2] + t)))
            small = np.hypot(step[:, 0], step[:, 1]) + np.abs(step[:, 2]) < tolerance
            yield pd.DataFrame({
                **{k: pdf[k] for k in PAIR}, "dx": c * x - s * y + step[:, 0], "dy": s * x + c * y + step[:, 1],
                "dtheta": angle, "before_dx": x, "before_dy": y, "before_dtheta": t,
                "inliers": pdf.inliers.astype("int64"), "lost": lost, "done": lost | small, "rounds": pdf.rounds + 1})[
                    [*PAIR, *MOTION, *[f"before_{m}" for m in MOTION], "inliers", "lost", "done", "rounds"]]

    return run


def guard(candidates: DataFrame, max_residual: float = 0.15, min_inliers: int = 50, min_observability: float = 0.15,
          max_seed_shift: float = 0.7, max_seed_rotation: float = 20.0) -> DataFrame:
    """Name the first guard a relation fails in column ``reason``; NULL means it is kept.

    Expects ``seed_dx …``, ``dx …``, ``residual, inliers, observability``.
    """
    shift, turn = pose_error(Pose(*(F.col(f"seed_{m}") for m in MOTION)), Pose(*(F.col(m) for m in MOTION)))
    reason = (F.when(F.col("residual") > max_residual, "residual").when(F.col("inliers") < min_inliers, "inliers")
              .when(F.col("observability") < min_observability, "observability")
              .when((shift > max_seed_shift) | (F.degrees(turn) > max_seed_rotation), "seed_deviation"))
    return candidates.withColumn("reason", reason)


def residual_weights(relations: DataFrame, cap: float = 4.0) -> DataFrame:
    """Weight (median σ / σ)² with σ floored at 1e-6, clamped to [1/cap, cap]; the median is that of the run."""
    floored = relations.withColumn("_sigma", F.greatest(F.col("residual"), F.lit(1e-6)))
    middle = quantiles(floored, ["run"], "_sigma", {"_median": 0.5})
    ratio = F.col("_median") / F.col("_sigma")
    return floored.join(middle, "run").withColumn("weight", clamp(ratio * ratio, 1.0 / cap, cap)).drop("_sigma", "_median")


def judge_relations(points: DataFrame, poses: DataFrame, pairs: DataFrame, max_iterations: int = 200,
                    max_correspondence: float = 1.0, **guards) -> DataFrame:
    """Align all pairs and name the guard each one fails in ``reason``; columns of :func:`align_scans`, and the seeds."""
    start = pin(seeds(pairs, poses), "seeds")
    aligned = align_scans(points, start, max_iterations, max_correspondence=max_correspondence)
    seen = start.select(*PAIR, *[F.col(m).alias(f"seed_{m}") for m in MOTION]).join(aligned, PAIR)
    return pin(guard(seen, **guards), "judged")


def build_relations(points: DataFrame, poses: DataFrame, pairs: DataFrame, weighted: bool = False,
                    max_iterations: int = 200, max_correspondence: float = 1.0, **guards) -> tuple[DataFrame, DataFrame]:
    """Align all pairs, apply the guards and weigh the survivors: (relations, drop counts)."""
    judged = judge_relations(points, poses, pairs, max_iterations, max_correspondence, **guards)
    kept = judged.where("reason IS NULL").select(*PAIR, *MOTION, "residual", "inliers", "converged")
    kept = residual_weights(kept) if weighted else kept.withColumn("weight", F.lit(1.0))
    dropped = judged.where("reason IS NOT NULL").groupBy("run", "reason").agg(F.count(F.lit(1)).alias("dropped"))
    return kept, dropped


def score_relations(relations: DataFrame, poses: DataFrame) -> DataFrame:
    """Median and mean translation and rotation (degrees) error of an estimate against relations."""
    measured = relations.select(*PAIR, *[F.col(m).alias(f"m_{m}") for m in MOTION])
    shift, turn = pose_error(Pose(*(F.col(f"m_{m}") for m in MOTION)), Pose(*(F.col(m) for m in MOTION)))
    errors = pin(measured.join(seeds(relations, poses), PAIR).select(
        "run", shift.alias("t"), F.degrees(turn).alias("r")), "errors")
    means = errors.groupBy("run").agg(F.avg("t").alias("t_mean"), F.avg("r").alias("r_mean"), F.count(F.lit(1)).alias("n"))
    return (means.join(quantiles(errors, ["run"], "t", {"t_med": 0.5}), "run")
            .join(quantiles(errors, ["run"], "r", {"r_med": 0.5}), "run"))


def refine_odometry(points: DataFrame, poses: DataFrame, motions: DataFrame, max_residual: float = 0.1,
                    min_inliers: int = 50, min_observability: float = 0.15, max_iterations: int = 200,
                    max_correspondence: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Replace trusted wheel motions by aligned ones and integrate: (poses, refined counts).

    Observability is judged on all normals of the earlier scan.
    """
    from poseweave.operators.trajectory import append_frames

    aligned = align_scans(points, motions, max_iterations, max_correspondence=max_correspondence).select(
        *PAIR, *[F.col(m).alias(f"icp_{m}") for m in MOTION], "residual", "inliers", F.col("target_observability").alias("observability"))
    seen = motions.select(*PAIR, *MOTION).join(aligned, PAIR)
    good = F.coalesce((F.col("residual") <= max_residual) & (F.col("inliers") >= min_inliers)
                      & (F.col("observability") >= min_observability), F.lit(False))
    chosen = pin(seen.withColumn("refined", good).select(
        *PAIR, "refined", *[F.when(F.col("refined"), F.col(f"icp_{m}")).otherwise(F.col(m)).alias(m) for m in MOTION]), "refined")
    first = poses.where(F.col("frame") == 0).select("run", "frame", "x", "y", "theta")
    counts = chosen.groupBy("run").agg(F.count_if("refined").alias("refined"), F.count(F.lit(1)).alias("pairs"))
    return append_frames(first, chosen, ["run"]), counts
