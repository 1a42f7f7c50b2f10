"""Comparing estimates of the same runs: rigid part, differential part, ensemble spread."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.functions.pose import rotate
from poseweave.operators.ordered import quantiles
from poseweave.operators.trajectory import gap_motions


def rigid_deviation(estimates: dict[str, DataFrame]) -> DataFrame:
    """Mean and max position deviation per run and estimate pair, raw and after the best rigid fit.

    ``estimates`` maps a name to ``(run, frame, x, y, theta)``; pairs are built from the names.
    """
    parts = []
    for a, b in combinations(estimates, 2):
        left = estimates[a].select("run", "frame", F.col("x").alias("ax"), F.col("y").alias("ay"))
        right = estimates[b].select("run", "frame", F.col("x").alias("bx"), F.col("y").alias("by"))
        parts.append(left.join(right, ["run", "frame"]).withColumns({"a": F.lit(a), "b": F.lit(b)}))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    key = ["run", "a", "b"]
    fit = both.groupBy(*key).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("ax", "ay", "bx", "by")],
        *[F.covar_pop(p, q).alias(f"s_{p}_{q}") for p in ("ax", "ay") for q in ("bx", "by")])
    angle = F.atan2(F.col("s_ax_by") - F.col("s_ay_bx"), F.col("s_ax_bx") + F.col("s_ay_by"))
    fit = fit.select(*key, "m_ax", "m_ay", "m_bx", "m_by", angle.alias("angle"))
    placed = both.join(fit, key)
    x, y = rotate(F.col("angle"), F.col("ax") - F.col("m_ax"), F.col("ay") - F.col("m_ay"))
    raw = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    inner = F.hypot(x + F.col("m_bx") - F.col("bx"), y + F.col("m_by") - F.col("by"))
    return placed.groupBy(*key).agg(F.avg(raw).alias("raw_mean"), F.max(raw).alias("raw_max"),
                                    F.avg(inner).alias("internal_mean"), F.max(inner).alias("internal_max"))


def gap_deviation(estimates: dict[str, DataFrame], gaps: list[int]) -> DataFrame:
    """Mean, 95th percentile and max deviation of gap-g motions, pooled over runs and estimate pairs."""
    moved = {(name, gap): gap_motions(df, ["run"], gap).select("run", "i", "dx", "dy")
             for name, df in estimates.items() for gap in gaps}
    pooled = None
    for gap in gaps:
        for a, b in combinations(estimates, 2):
            other = moved[b, gap].toDF("run", "i", "ex", "ey")
            part = moved[a, gap].join(other, ["run", "i"]).select(
                F.lit(gap).alias("gap"), F.hypot(F.col("dx") - F.col("ex"), F.col("dy") - F.col("ey")).alias("d"))
            pooled = part if pooled is None else pooled.unionByName(part)
    stats = pooled.groupBy("gap").agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.count(F.lit(1)).alias("n"))
    return stats.join(quantiles(pooled, ["gap"], "d", {"p95": 0.95}), "gap")


def summarise_ensemble(scores: DataFrame, group: list[str], value: str, factor: float) -> DataFrame:
    """Best, median, worst, spread and number of members beyond ``factor`` times the best."""
    best = scores.groupBy(*group).agg(F.min(value).alias("best"), F.max(value).alias("worst"), F.count(value).alias("n"))
    diverged = scores.join(best.select(*group, "best"), group).groupBy(*group).agg(
        F.count_if(F.col(value) > factor * F.col("best")).alias("diverged"))
    middle = quantiles(scores, group, value, {"median": 0.5})
    return best.join(middle, group).join(diverged, group).withColumn("spread", F.col("worst") - F.col("best"))
