"""CARMEN laser logs: message parsing, benchmark relations and conversion to scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.operators.ordered import number_rows
from poseweave.operators.thinning import decimate
from poseweave.operators.trajectory import anchor
from poseweave.plans.tables import beam_points
from poseweave.sources.textfiles import tokens

# Message name -> position of the reading count (1-based token number).
COUNT_AT = {"FLASER": 2, "ROBOTLASER1": 9}


def parse_lasers(lines: DataFrame) -> DataFrame:
    """``(file, line_no, readings, x, y, theta, ox, oy, otheta, stamp)`` of the laser messages.

    The timestamp stays text: it is only ever compared for equality.
    """
    t = lines.withColumn("t", tokens()).where(F.element_at("t", 1).isin(*COUNT_AT))
    at = F.lit(0)
    for name, position in COUNT_AT.items():
        at = F.when(F.element_at("t", 1) == name, F.lit(position)).otherwise(at)
    t = t.withColumn("at", at).withColumn("n", F.element_at("t", F.col("at")).cast("int"))
    rest = F.col("at") + F.col("n")
    poses = ["x", "y", "theta", "ox", "oy", "otheta"]
    return t.select("file", "line_no",
                    F.transform(F.slice("t", F.col("at") + 1, F.col("n")), lambda v: v.cast("double")).alias("readings"),
                    *[F.element_at("t", rest + k + 1).cast("double").alias(c) for k, c in enumerate(poses)],
                    F.element_at("t", rest + 7).alias("stamp"))


def stamp_key(column: str):
    """Timestamps compare as numbers, whatever their spelling."""
    return F.col(column).cast("double")


def relation_lines(lines: DataFrame) -> DataFrame:
    """Token lists of a benchmark relations file."""
    return lines.withColumn("t", tokens()).where(F.size("t") >= 2)


def log_key(lines: DataFrame) -> list[str]:
    return ["run"] if "run" in lines.columns else []


def relation_stamps(lines: DataFrame) -> DataFrame:
    """Every scan timestamp the relations refer to, once for each log (``run``, where the lines have it)."""
    stamps = relation_lines(lines).select(*log_key(lines), F.explode(F.slice("t", 1, 2)).alias("s"))
    return stamps.select(*log_key(lines), stamp_key("s").alias("at")).distinct()


def index_relations(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Relations over kept frame numbers; pairs with a dropped end disappear.

    ``kept`` is ``(frame, at)`` with the numeric timestamp.  Where the lines name their log in ``run``, so must ``kept``:
    equal timestamps of other logs are other scans.
    """
    log = log_key(lines)
    full = relation_lines(lines).where(F.size("t") >= 8).select(
        *log, "line_no", *[F.element_at("t", n).cast("double").alias(c)
                     for n, c in ((1, "at_i"), (2, "at_j"), (3, "dx"), (4, "dy"), (8, "dtheta"))])
    return (full.join(kept.select(*log, F.col("at").alias("at_i"), F.col("frame").alias("i")), [*log, "at_i"])
            .join(kept.select(*log, F.col("at").alias("at_j"), F.col("frame").alias("j")), [*log, "at_j"])
            .select(*log, "line_no", "i", "j", "dx", "dy", "dtheta"))


def convert(messages: DataFrame, min_travel: float = 0.5, min_turn: float = 0.2, min_range: float = 0.1,
            max_range: float = 49.0, limit: int = 0, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Thin a log, keep wanted scans, re-anchor: (scan points, poses with their timestamps).

    ``messages`` is the output of :func:`parse_lasers`; each ``file`` is one log and becomes a ``run``
    given by the column of that name if present, else 0.
    """
    run = F.col("run") if "run" in messages.columns else F.lit(0).cast("bigint")
    ordered = number_rows(messages.withColumn("run", run), ["run"], ["line_no"], "message")
    kept = decimate(ordered.withColumnRenamed("message", "frame"), min_travel, min_turn).withColumnRenamed("frame", "message")
    if wanted is not None:
        named = ordered.withColumn("at", stamp_key("stamp")).join(wanted, [*log_key(wanted), "at"], "left_semi").select("run", "message")
        kept = kept.unionByName(named).distinct()
    slots = number_rows(kept, ["run"], ["message"], "frame")
    if limit:
        slots = slots.where(F.col("frame") < limit)
    chosen = ordered.join(slots, ["run", "message"])
    poses = anchor(chosen.select("run", "frame", "x", "y", "theta", stamp_key("stamp").alias("at")), ["run"])
    beams = chosen.select("run", "frame", F.size("readings").alias("beams"), F.posexplode("readings").alias("beam", "reading"))
    points = beam_points(beams, min_range, max_range).withColumn("beam", F.col("beam").cast("bigint")).withColumnRenamed("beam", "idx")
    return points, poses
