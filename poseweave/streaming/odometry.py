"""Odometry integration over a stream of motion events.

Each micro-batch is integrated with the same block-wise prefix product as a batch job and appended
to the last pose of its run, so a run that fills a micro-batch alone is still spread over many
tasks.  The state is one row per run in a table per batch; a repeated batch rewrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poseweave.functions.pose import Pose, compose, pose
from poseweave.operators.ordered import number_rows
from poseweave.operators.trajectory import integrate
from poseweave.session import scratch_path

LAST = "run bigint, ts bigint, scan bigint, frame bigint, x double, y double, theta double"
OUTPUT = "run bigint, frame bigint, x double, y double, theta double"


def extend(steps: DataFrame, last: DataFrame) -> DataFrame:
    """Poses of new motion events ``(run, ts, scan, dx, dy, dtheta)`` after the ``last`` pose of each run.

    An event that is not later than the run's last one is an error, never silently reordered.
    """
    numbered = number_rows(steps, ["run"], ["ts", "scan"], "offset")
    local = integrate(numbered.withColumnRenamed("offset", "frame"), ["run"], keep=["ts", "scan"])
    known = last.select("run", F.col("ts").alias("_ts"), F.col("scan").alias("_scan"), F.col("frame").alias("_frame"),
                        *pose().named("l"))
    joined = local.join(known, "run", "left")
    late = F.struct("ts", "scan") <= F.struct("_ts", "_scan")
    joined = joined.where(F.when(F.col("_ts").isNotNull() & late, F.raise_error(
        F.concat(F.lit("frame out of order in run "), F.col("run").cast("string")))).otherwise(F.lit(True)))
    start = Pose(*(F.coalesce(f"l{c}", F.lit(0.0)) for c in ("x", "y", "theta")))
    placed = compose(start, pose())
    return joined.select("run", "ts", "scan", (F.col("frame") + F.coalesce("_frame", F.lit(-1)) + 1).alias("frame"),
                         *placed.named())


def stream_odometry(spark: SparkSession, folder: str, to_steps, pattern: str = "events*.parquet",
                    files_per_batch: int = 1) -> DataFrame:
    """Run the stream over all files present and return the written trajectory.

    ``to_steps`` turns the raw rows into motion events.  Files form the micro-batches in their
    modification order; progress, state and output live in the shared folder.
    """
    out, state, progress = (scratch_path(spark, f"stream-{part}") for part in ("poses", "state", "progress"))

    def consume(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        previous = session.read.schema(LAST).parquet(f"{state}/{batch_id - 1}") if batch_id else session.createDataFrame([], LAST)
        target = f"{out}/batch={batch_id}"
        # Microseconds compare the same whether the source stores local or zoned timestamps.
        steps = to_steps(batch).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
        extend(steps, previous).write.mode("overwrite").parquet(target)
        written = session.read.parquet(target)
        ends = written.groupBy("run").agg(F.max_by(F.struct("ts", "scan", "frame", "x", "y", "theta"), "frame").alias("e")).select("run", "e.*")
        still = previous.join(ends.select("run"), "run", "left_anti")
        ends.unionByName(still).write.mode("overwrite").parquet(f"{state}/{batch_id}")

    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .option("pathGlobFilter", pattern).parquet(folder))
    running = events.writeStream.foreachBatch(consume).option("checkpointLocation", progress).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out).select(*[c.split()[0] for c in OUTPUT.split(", ")])
