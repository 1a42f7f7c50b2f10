"""How the given tables are read as robot data.

Poses come from ``events`` (one run per user, frames in time order), beams from ``lineitem`` (one
scan per frame, the quantity is the range).  A frame owns the scan whose number is its event id; orders are dealt to the
frames in turn, so every line is a beam of some frame.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poseweave.functions.pose import apply, pose
from poseweave.operators.ordered import number_rows
from poseweave.operators.trajectory import integrate

# Turn in radians per event type; any other type goes straight on.
TURNS = {"click": 0.1, "view": -0.05, "signup": 0.3, "purchase": -0.2}
STEP_SCALE = 100.0
MIN_RANGE, MAX_RANGE = 0.1, 49.0
BEAM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def motion_events(events: DataFrame) -> DataFrame:
    """``(run, ts, scan, dx, dy, dtheta)`` from event rows."""
    turn = F.lit(0.0)
    for kind, angle in TURNS.items():
        turn = F.when(F.col("event_type") == kind, F.lit(angle)).otherwise(turn)
    return events.select(F.col("user_id").alias("run"), "ts", F.col("event_id").alias("scan"),
                         (F.col("value") / STEP_SCALE).alias("dx"), F.lit(0.0).alias("dy"), turn.alias("dtheta"))


def motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, frame, scan, dx, dy, dtheta)``: the motion that leads to each frame."""
    raw = motion_events(table(spark, sf_dir, "events"))
    return number_rows(raw, ["run"], ["ts", "scan"], "frame", keep=["scan", "dx", "dy", "dtheta"])


def poses(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> DataFrame:
    """The poses of all motions, of those in ``numbered`` where they have been read."""
    return integrate(motions(spark, sf_dir) if numbered is None else numbered, ["run"], keep=["scan"])


def drifted(spark: SparkSession, sf_dir: str, turn_scale: float = 1.02) -> DataFrame:
    """A second estimate of the same runs with a scaled turn rate."""
    biased = motions(spark, sf_dir).withColumn("dtheta", F.col("dtheta") * turn_scale)
    return integrate(biased, ["run"], keep=["scan"])


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scan, beam, beams, reading)``."""
    frames = table(spark, sf_dir, "events").count()
    raw = table(spark, sf_dir, "lineitem").select(
        F.pmod(F.col("l_orderkey"), F.lit(max(frames, 1))).alias("scan"), F.col("l_quantity").alias("reading"), *BEAM_ORDER)
    numbered = number_rows(raw, ["scan"], BEAM_ORDER, "beam", total="beams", keep=["reading"])
    return numbered.select("scan", "beam", "beams", "reading")


def beam_points(readings: DataFrame, min_range: float = MIN_RANGE, max_range: float = MAX_RANGE) -> DataFrame:
    """Endpoints of a half-circle sweep; a dropped reading still takes its place in the sweep."""
    angle = F.lit(-math.pi / 2) + F.col("beam") * (F.lit(math.pi) / F.col("beams"))
    kept = readings.where((F.col("reading") >= min_range) & (F.col("reading") < max_range))
    return kept.withColumns({"sx": F.col("reading") * F.cos(angle), "sy": F.col("reading") * F.sin(angle)}).drop(
        "reading", "beams")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scan, idx, sx, sy)`` in the sensor frame."""
    return beam_points(ranges(spark, sf_dir)).withColumnRenamed("beam", "idx")


def to_world(points: DataFrame, trajectory: DataFrame, on: list[str]) -> DataFrame:
    """Place sensor-frame points with the pose they were seen from.

    Poses are unique per key, so a scan that holds most points is split by adaptive skew handling.
    """
    gx, gy = apply(pose(), F.col("sx"), F.col("sy"))
    return points.join(trajectory, on).withColumns({"gx": gx, "gy": gy})


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, frame, idx, sx, sy, x, y, theta, gx, gy)``."""
    return to_world(scans(spark, sf_dir), poses(spark, sf_dir), ["scan"]).drop("scan")


def frame_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, frame, idx, sx, sy)``."""
    frames = motions(spark, sf_dir).select("run", "frame", "scan")
    return scans(spark, sf_dir).join(frames, "scan").drop("scan")
