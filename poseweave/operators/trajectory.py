"""Trajectory operators over ``(run, frame, x, y, theta)`` tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poseweave.functions.pose import Pose, apply, compose, pose, relative, rotate, wrap_angle
from poseweave.operators.ordered import BLOCK_ROWS, block_of, look_ahead, running_sum


def integrate(motions: DataFrame, group: list[str], frame: str = "frame", block_rows: int = BLOCK_ROWS,
              keep: list[str] | None = None) -> DataFrame:
    """Absolute poses from relative motions ``(dx, dy, dtheta)``: an SE(2) prefix product.

    Blocks integrate from the identity, then each block is placed by the product of the blocks
    before it; composition is associative, so this equals the serial product.
    """
    inside = Window.partitionBy(*group, "_block").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    turned = motions.withColumn("_block", block_of(frame, block_rows)).withColumn(
        "_theta", F.sum("dtheta").over(inside))
    sx, sy = rotate(F.col("_theta") - F.col("dtheta"), F.col("dx"), F.col("dy"))
    local = turned.withColumns({"_sx": sx, "_sy": sy}).withColumns(
        {"_x": F.sum("_sx").over(inside), "_y": F.sum("_sy").over(inside)})

    ends = local.groupBy(*group, "_block").agg(
        F.max_by(F.struct("_x", "_y", "_theta"), F.col(frame)).alias("end"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_ct", F.coalesce(F.sum("end._theta").over(before), F.lit(0.0)))
    ex, ey = rotate(F.col("_ct"), F.col("end._x"), F.col("end._y"))
    ends = ends.withColumns({"_ex": ex, "_ey": ey})
    carry = ends.select(*group, "_block", "_ct",
                        F.coalesce(F.sum("_ex").over(before), F.lit(0.0)).alias("_cx"),
                        F.coalesce(F.sum("_ey").over(before), F.lit(0.0)).alias("_cy"))
    placed = local.join(carry, [*group, "_block"])
    x, y = apply(Pose(F.col("_cx"), F.col("_cy"), F.col("_ct")), F.col("_x"), F.col("_y"))
    theta = wrap_angle(F.col("_ct") + F.col("_theta"))
    return placed.select(*group, frame, *(keep or []), x.alias("x"), y.alias("y"), theta.alias("theta"))


def odometry(poses: DataFrame, group: list[str], frame: str = "frame") -> DataFrame:
    """Relative motion from every frame to the next: ``(group, i, j, dx, dy, dtheta)``."""
    pairs = look_ahead(poses, group, frame, 1, {"x": "_nx", "y": "_ny", "theta": "_nt"})
    motion = relative(pose(), Pose(F.col("_nx"), F.col("_ny"), F.col("_nt")))
    return pairs.select(*group, F.col(frame).alias("i"), (F.col(frame) + 1).alias("j"),
                        *[c.alias(n) for c, n in zip(motion, ("dx", "dy", "dtheta"))])


def anchor(poses: DataFrame, group: list[str], frame: str = "frame") -> DataFrame:
    """Express each run in the frame of its first pose."""
    first = poses.groupBy(*group).agg(F.min_by(F.struct("x", "y", "theta"), F.col(frame)).alias("_o"))
    origin = Pose(F.col("_o.x"), F.col("_o.y"), F.col("_o.theta"))
    moved = relative(origin, pose())
    return poses.join(first, group).withColumns(dict(zip(("x", "y", "theta"), moved))).drop("_o")


def unwrap(poses: DataFrame, group: list[str], frame: str = "frame", name: str = "unwrapped") -> DataFrame:
    """Remove 2π jumps from ``theta`` along the frames."""
    # The correction of frame f + 1 is computed at frame f and shifted back by a join on f + 1.
    steps = look_ahead(poses.select(*group, frame, "theta"), group, frame, 1, {"theta": "_next"})
    jump = F.col("_next") - F.col("theta")
    folded = F.pmod(jump + math.pi, F.lit(2 * math.pi)) - math.pi
    folded = F.when((folded == -math.pi) & (jump > 0), F.lit(math.pi)).otherwise(folded)
    fix = F.when(F.abs(jump) >= math.pi, folded - jump).otherwise(F.lit(0.0))
    fixes = steps.select(*group, (F.col(frame) + 1).alias(frame), fix.alias("_fix"))
    joined = poses.join(fixes, [*group, frame], "left")
    summed = running_sum(joined, group, frame, {"_shift": F.coalesce(F.col("_fix"), F.lit(0.0))})
    return summed.withColumn(name, F.col("theta") + F.col("_shift")).drop("_fix", "_shift")


def gap_motions(poses: DataFrame, group: list[str], gap: int, frame: str = "frame") -> DataFrame:
    """Relative transforms over ``gap`` frames; the angle is the difference of unwrapped headings."""
    pairs = look_ahead(unwrap(poses, group, frame), group, frame, gap,
                       {"x": "_nx", "y": "_ny", "unwrapped": "_nu"})
    dx, dy = rotate(-F.col("theta"), F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y"))
    return pairs.select(*group, F.col(frame).alias("i"), dx.alias("dx"), dy.alias("dy"),
                        (F.col("_nu") - F.col("unwrapped")).alias("dtheta"))


def trajectory_errors(estimate: DataFrame, truth: DataFrame, group: list[str], frame: str = "frame") -> DataFrame:
    """Mean absolute and mean frame-to-frame relative errors per run.

    Frames must match one to one and a run needs at least two of them.
    """
    reference = truth.select(*group, frame, *pose().named("t_"))
    both = estimate.join(reference, [*group, frame], "full")
    problem = F.col("x").isNull() | F.col("t_x").isNull()
    both = both.where(F.when(problem, F.raise_error(F.lit("a frame has a pose in one trajectory only")))
                      .otherwise(F.lit(True)))
    steps = look_ahead(both, group, frame, 1, {c: f"_n{c}" for c in ("x", "y", "theta", "t_x", "t_y", "t_theta")})
    est = relative(pose(), Pose(F.col("_nx"), F.col("_ny"), F.col("_ntheta")))
    ref = relative(pose("t_"), Pose(F.col("_nt_x"), F.col("_nt_y"), F.col("_nt_theta")))
    absolute = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(F.hypot(F.col("x") - F.col("t_x"), F.col("y") - F.col("t_y"))).alias("mean_translation_error"),
        F.avg(F.abs(wrap_angle(F.col("theta") - F.col("t_theta")))).alias("mean_rotation_error"))
    step = steps.groupBy(*group).agg(
        F.avg(F.hypot(est.x - ref.x, est.y - ref.y)).alias("mean_relative_translation_error"),
        F.avg(F.abs(wrap_angle(est.theta - ref.theta))).alias("mean_relative_rotation_error"))
    enough = F.when(F.col("frames") < 2, F.raise_error(F.lit("a trajectory needs at least two poses"))).otherwise(
        F.col("frames"))
    return absolute.join(step, group, "left").withColumn("frames", enough)


def append_frames(poses: DataFrame, motions: DataFrame, group: list[str]) -> DataFrame:
    """Extend each run by composing the motions that follow its last optimised pose.

    ``motions`` has ``(group, i, j, dx, dy, dtheta)`` with consecutive j after the last frame.
    """
    last = poses.groupBy(*group).agg(F.max_by(F.struct("frame", "x", "y", "theta"), "frame").alias("_l"))
    local = integrate(motions.withColumn("frame", F.col("j")), group)
    start = Pose(F.col("_l.x"), F.col("_l.y"), F.col("_l.theta"))
    placed = compose(start, pose())
    fresh = local.join(last, group).where(F.col("frame") > F.col("_l.frame")).select(
        *group, "frame", *placed.named())
    return poses.select(*fresh.columns).unionByName(fresh)
