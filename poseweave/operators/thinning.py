"""Greedy thinning of a trajectory by travelled distance and turn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poseweave.operators.ordered import BLOCK_ROWS, block_of
from poseweave.session import pin


def keep_frames(x: np.ndarray, y: np.ndarray, theta: np.ndarray, last: tuple[float, float, float] | None,
                min_travel: float, min_turn: float) -> list[int]:
    """Positions to keep in one ordered block, given the pose kept before it (None: keep the first).

    Jumps from one kept row to the next: slices of growing width are compared with the kept pose at once.
    """
    kept: list[int] = []
    at, width = 0, 32
    if last is None and len(x):
        kept, at, last = [0], 1, (x[0], y[0], theta[0])
    while at < len(x):
        turn = np.remainder(theta[at: at + width] - last[2] + np.pi, 2 * np.pi) - np.pi
        far = (np.hypot(x[at: at + width] - last[0], y[at: at + width] - last[1]) >= min_travel) | (np.abs(turn) >= min_turn)
        if far.any():
            at += int(np.argmax(far))
            kept.append(at)
            last, width = (x[at], y[at], theta[at]), 32
            at += 1
        else:
            at, width = at + width, width * 2
    return kept


def decimate(poses: DataFrame, min_travel: float, min_turn: float, group: str = "run", frame: str = "frame",
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Frames that moved or turned enough since the last kept one: ``(group, frame)``.

    Blocks of a long run are thinned in parallel, first as if nothing was kept before them, then
    again with the last kept pose of the block in front, until no such pose changes.  Greedy chains
    merge quickly, so a few rounds reach the serial answer.
    """
    blocked = pin(poses.select(group, frame, "x", "y", "theta").withColumn("_block", block_of(frame, block_rows)), "thin")
    key = [group, "_block"]
    carry = blocked.select(*key).distinct().select(
        *key, *[F.lit(None).cast("double").alias(f"_c{c}") for c in ("x", "y", "theta")])
    schema = f"{group} bigint, {frame} bigint, _block bigint, x double, y double, theta double"

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        first = pdf.iloc[0]
        last = None if pd.isna(first["_cx"]) else (first["_cx"], first["_cy"], first["_ctheta"])
        kept = keep_frames(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["theta"].to_numpy(), last, min_travel, min_turn)
        return pdf.iloc[kept][[group, frame, "_block", "x", "y", "theta"]]

    kept, todo = None, carry
    while True:
        # The carry is one row per block and joins on the block, so a long run stays spread out; only blocks
        # whose carry has changed are thinned again.
        thinned = blocked.join(todo, key).groupBy(*key).applyInPandas(thin, schema)
        kept = pin(thinned if kept is None else kept.join(todo.select(*key), key, "left_anti").unionByName(thinned), "kept")
        ends = kept.groupBy(*key).agg(F.max_by(F.struct("x", "y", "theta"), frame).alias("_end"))
        every = carry.select(*key).join(ends, key, "left")
        before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        # A block that kept nothing hands on the pose it was given.
        fresh = every.withColumn("_last", F.last("_end", ignorenulls=True).over(before)).select(
            *key, *[F.col(f"_last.{c}").alias(f"_c{c}") for c in ("x", "y", "theta")])
        fresh = pin(fresh, "carry")
        changed = fresh.join(carry.toDF(*key, "_ox", "_oy", "_ot"), key).where(
            ~(F.col("_cx").eqNullSafe(F.col("_ox")) & F.col("_cy").eqNullSafe(F.col("_oy"))
              & F.col("_ctheta").eqNullSafe(F.col("_ot"))))
        todo = pin(changed.drop("_ox", "_oy", "_ot"), "carry")
        if todo.limit(1).count() == 0:
            return kept.select(group, frame)
        carry = fresh
