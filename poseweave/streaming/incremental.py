"""Incremental estimation driven by arriving scans.

Scans arrive as parquet files, one micro-batch per trigger; every batch extends the trajectories by odometry and refines map and poses
over all frames so far of the runs it has scans of.  Between batches everything lies in the state folder: the points of each
batch, written once; versions of map, poses and totals named by batch id; and a commit record, written last.  A batch starts from the
last committed version before it, so one that failed half way leaves nothing behind, and one that is committed is not done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poseweave.operators.trajectory import append_frames
from poseweave.plans.pipeline import Result, add_totals, refine_prefix, starting_nodes
from poseweave.session import names_in, pin, remove, scratch_path
from poseweave.sources.config import RunConfig

POINTS = "run bigint, frame bigint, idx bigint, sx double, sy double"
TOTAL = ("run bigint, converged boolean, iterations int, initial_cost double, final_cost double, cost_history array<double>, duration_seconds double")
PARTS = ("nodes", "poses", "total")


class StateTable:
    """Versions of the carried state in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[int]:
        """Ids of the committed batches, ascending."""
        return sorted(int(name) for name in names_in(self.spark, f"{self.folder}/commits") if name.isdigit())

    def read(self, batch_id: int) -> dict[str, DataFrame]:
        return {part: self.spark.read.parquet(f"{self.folder}/versions/{batch_id}/{part}") for part in PARTS}

    def add_points(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Write the points of a batch and return them as written."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/points/{batch_id}")
        return self.points([batch_id])

    def points(self, batch_ids: list[int]) -> DataFrame:
        return self.spark.read.schema(POINTS).parquet(*(f"{self.folder}/points/{k}" for k in batch_ids))

    def commit(self, batch_id: int, **parts: DataFrame) -> None:
        """Write a version and its record; versions before the last committed one are no longer needed."""
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/versions/{batch_id}/{name}")
        earlier = [k for k in self.commits() if k < batch_id]
        self.spark.range(1).select(F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch_id}")
        for k in earlier[:-1]:
            remove(self.spark, f"{self.folder}/versions/{k}")


def stream_incremental(spark: SparkSession, folder: str, first_poses: DataFrame, motions: DataFrame, grids: DataFrame,
                       config: RunConfig, relations: DataFrame | None = None, state: str | None = None, progress: str | None = None) -> Result:
    """Consume the scan files in ``folder`` (columns of ``POINTS``) not read yet and return the state after them.

    ``first_poses`` holds frame 0 of every run and ``motions`` the measured steps ``(run, i, j, …)``.  A run begins, and its map is
    seeded, with the batch of its frame 0.  The frames of a batch must follow the frames already seen.  ``state`` and ``progress`` (the
    checkpoint) name the folders to go on with after a stop; without them the stream is done in one go.
    """
    table = StateTable(spark, state or scratch_path(spark, "incremental-state"))
    progress = progress or scratch_path(spark, "incremental-progress")

    def consume(batch: DataFrame, batch_id: int) -> None:
        done = table.commits()
        if batch_id in done:
            return
        done = [k for k in done if k < batch_id]
        arrived = table.add_points(batch, batch_id)
        old = table.read(done[-1]) if done else {"nodes": None, "poses": first_poses.limit(0), "total": None}
        nodes, poses, total = (old[part] for part in PARTS)
        known = pin(poses.groupBy("run").agg(F.max("frame").alias("known")), "known")
        begun = pin(arrived.where("frame = 0").select("run").distinct().join(known, "run", "left_anti"), "begun")
        late = arrived.join(known, "run", "left").join(begun.withColumn("_begins", F.lit(True)), "run", "left").where(
            "frame <= known or (known is null and _begins is null)")
        if late.limit(1).count():
            raise ValueError("scan arrived out of order")
        if begun.limit(1).count():
            start = pin(first_poses.join(begun, "run", "left_semi"), "poses")
            seeded, _ = starting_nodes(arrived.where("frame = 0").join(begun, "run", "left_semi"), start,
                                       grids.join(begun, "run", "left_semi"), config.map)
            nodes = seeded if nodes is None else nodes.unionByName(seeded)
            poses = poses.unionByName(start)
            known = poses.groupBy("run").agg(F.max("frame").alias("known"))
        points = table.points([*done, batch_id])
        reached = points.groupBy("run").agg(F.max("frame").alias("reached"))
        seen = pin(motions.join(reached, "run").where(F.col("j") <= F.col("reached")).drop("reached"), "seen")
        fresh = pin(seen.join(known, "run").where(F.col("j") > F.col("known")).drop("known"), "fresh")
        moved = fresh.select("run").distinct()
        if fresh.limit(1).count():
            grown = append_frames(poses.join(moved, "run", "left_semi"), fresh, ["run"])
            part_nodes, part_poses, report = refine_prefix(
                points.join(moved, "run", "left_semi"), nodes.join(moved, "run", "left_semi"), grown,
                seen.join(moved, "run", "left_semi"), grids, config, relations)
            total = add_totals(total, report)
            nodes = part_nodes.unionByName(nodes.join(moved, "run", "left_anti").select(*part_nodes.columns))
            poses = part_poses.unionByName(poses.join(moved, "run", "left_anti").select(*part_poses.columns))
        table.commit(batch_id, nodes=nodes, poses=poses, total=spark.createDataFrame([], TOTAL) if total is None else total)

    scans = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", config.increment_size).parquet(folder)
    running = scans.writeStream.foreachBatch(consume).option("checkpointLocation", progress).trigger(availableNow=True).start()
    running.awaitTermination()
    final = table.read(table.commits()[-1])
    return Result(final["nodes"], final["poses"], final["total"], grids)
