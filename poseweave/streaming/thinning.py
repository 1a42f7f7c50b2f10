"""Stateful odometry: a stream of motions becomes poses, relative motions and the choice of kept frames.

The state of a run is one typed row (last event, frame counter, last pose, last kept pose) in the state store; nothing else of
the past is read.  Progress, state and output belong to the checkpoint, so a stopped stream goes on where it was and a batch that is
repeated writes its output once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from poseweave.operators.thinning import keep_frames

STATE = ("ts bigint, scan bigint, frame bigint, x double, y double, theta double, kept_x double, kept_y double, kept_theta double")
OUTPUT = "run bigint, frame bigint, scan bigint, dx double, dy double, dtheta double, x double, y double, theta double, kept boolean"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tracker(StatefulProcessor):
    """Integrates the motions of a run and keeps the frames that moved or turned enough since the last kept one."""

    def __init__(self, min_travel: float, min_turn: float):
        self.min_travel, self.min_turn = min_travel, min_turn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """The events of a run in one micro-batch, in any order among themselves; earlier ones than the state's are an error."""
        events = pd.concat(list(rows)).sort_values(["ts", "scan"], kind="stable")
        ts, scan, dx, dy, turn = (events[c].to_numpy() for c in ("ts", "scan", "dx", "dy", "dtheta"))
        old = self.state.get() if self.state.exists() else None
        last_ts, last_scan, frame, x0, y0, t0, *kept = old if old else (None, None, -1, 0.0, 0.0, 0.0)
        if old and (int(ts[0]), int(scan[0])) <= (last_ts, last_scan):
            raise ValueError(f"frame out of order in run {key[0]}")
        heading = t0 + np.concatenate(([0.0], np.cumsum(turn)))
        cos, sin = np.cos(heading[:-1]), np.sin(heading[:-1])
        x, y = x0 + np.cumsum(cos * dx - sin * dy), y0 + np.cumsum(sin * dx + cos * dy)
        theta = np.arctan2(np.sin(heading[1:]), np.cos(heading[1:]))
        chosen = keep_frames(x, y, theta, tuple(kept) if old else None, self.min_travel, self.min_turn)
        if chosen:
            kept = [float(v[chosen[-1]]) for v in (x, y, theta)]
        numbers = frame + 1 + np.arange(len(ts))
        self.state.update((int(ts[-1]), int(scan[-1]), int(numbers[-1]), float(x[-1]), float(y[-1]), float(theta[-1]), *kept))
        marks = np.zeros(len(ts), dtype=bool)
        marks[chosen] = True
        yield pd.DataFrame({"run": np.full(len(ts), int(key[0])), "frame": numbers, "scan": scan, "dx": dx, "dy": dy, "dtheta": turn,
                            "x": x, "y": y, "theta": theta, "kept": marks})

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The store that typed state needs, for queries started inside."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def track(steps: DataFrame, min_travel: float, min_turn: float) -> DataFrame:
    """Poses of a stream of ``(run, ts, scan, dx, dy, dtheta)``, with ``ts`` in microseconds; columns of ``OUTPUT``.

    The events of a run must come in the order of (ts, scan) from one micro-batch to the next.  A task holds the events of a run in one
    micro-batch, which the source's rate bounds, and one row of state a run.
    """
    return steps.groupBy("run").transformWithStateInPandas(Tracker(min_travel, min_turn), OUTPUT, "Append", "None")


def stream_tracks(spark: SparkSession, folder: str, to_steps: Callable[[DataFrame], DataFrame], out: str, progress: str,
                  min_travel: float, min_turn: float, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Consume the files of ``folder`` that have not been read yet and return all poses written to ``out`` so far.

    ``to_steps`` turns raw rows into motion events.  Files form the micro-batches in their modification order.  ``progress`` is the
    checkpoint: called again with the same folders, the stream goes on with its state and reads new files only.
    """
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder))
    steps = to_steps(raw).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    with keyed_state(spark):
        running = track(steps, min_travel, min_turn).writeStream.format("parquet").outputMode("append").option("path", out).option(
            "checkpointLocation", progress).trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(out)
