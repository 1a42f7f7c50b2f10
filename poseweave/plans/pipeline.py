"""Batch and incremental estimation of maps and trajectories, and the outputs of a run."""

from __future__ import annotations

from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poseweave.functions.pose import apply, pose
from poseweave.operators.gridmap import auto_grid, grid_nodes, init_from_scans, node_owners, outside_share, surface_tree
from poseweave.operators.ordered import number_rows
from poseweave.operators.relations import revisit_score
from poseweave.operators.residuals import build_problem
from poseweave.operators.stability import summarise_ensemble
from poseweave.operators.trajectory import append_frames, odometry, trajectory_errors
from poseweave.plans.solve import SolverOptions, solve
from poseweave.session import pin
from poseweave.sources.config import MapOptions, RunConfig
from poseweave.sources.named import write_snapshot
from poseweave.sources.textfiles import (load_dataset, metrics_json, parse_poses, parse_relations, read_lines, render_csv,
                                         render_map, write_lines)

RUN = ["run"]
POSE_COLUMNS = ["run", "frame", "x", "y", "theta"]


class Result(NamedTuple):
    nodes: DataFrame
    poses: DataFrame
    control: DataFrame
    grids: DataFrame


def place(points: DataFrame, poses: DataFrame) -> DataFrame:
    gx, gy = apply(pose(), F.col("sx"), F.col("sy"))
    return points.join(poses.select(*POSE_COLUMNS), ["run", "frame"]).withColumns({"gx": gx, "gy": gy})


def make_grids(points: DataFrame, poses: DataFrame, options: MapOptions) -> DataFrame:
    """The configured domain for every run, or one fitted to its odometry."""
    if options.auto_domain:
        return auto_grid(place(points, poses), poses, RUN, options.nx, options.ny, options.auto_domain_margin)
    step = [(hi - lo) / (n - 1) for lo, hi, n in zip(options.min, options.max, (options.nx, options.ny))]
    return poses.select("run").distinct().select(
        "run", F.lit(options.nx).cast("bigint").alias("nx"), F.lit(options.ny).cast("bigint").alias("ny"),
        F.lit(options.min[0]).alias("min_x"), F.lit(options.min[1]).alias("min_y"),
        F.lit(step[0]).alias("dx"), F.lit(step[1]).alias("dy"))


def starting_nodes(points: DataFrame, poses: DataFrame, grids: DataFrame, options: MapOptions, k: int = 1):
    """The initial map, and the point tree and node owners when it was seeded from scans."""
    nodes = grid_nodes(grids, RUN, options.initial_value)
    if not options.init_from_scans:
        return pin(nodes, "nodes"), None
    tree = surface_tree(place(points, poses), RUN, ["frame", "idx"], k)
    owners = node_owners(nodes, tree, RUN, ["frame", "idx"])
    return pin(init_from_scans(nodes, owners, RUN, options.init_signed), "nodes"), (tree, owners)


def effective_solver(options: SolverOptions) -> SolverOptions:
    """The frozen-cell backend runs as a trust region whose damping scales with the diagonal, λ being one over its radius."""
    return replace(options, trust_region=True, marquardt_scaling=True) if options.backend == "ceres" else options


def run_batch(points: DataFrame, poses: DataFrame, config: RunConfig, relations: DataFrame | None = None,
              initial: DataFrame | None = None, damping_factors: DataFrame | None = None) -> Result:
    """Refine all frames at once; measured motions always come from ``poses``, the start may not."""
    points, poses = pin(points, "points"), pin(poses.select(*POSE_COLUMNS), "poses")
    grids = pin(make_grids(points, poses, config.map), "grids")
    start = poses if initial is None else pin(initial.select(*POSE_COLUMNS), "poses")
    if initial is not None and start.count() != poses.count():
        raise ValueError("the starting poses do not cover the scans one to one")
    nodes, surface = starting_nodes(points, start, grids, config.map, max(2, config.problem.normals.k_neighbors))
    options = effective_solver(config.solver)
    problem = build_problem(points, nodes, start, odometry(poses, RUN), grids, config.problem, relations,
                            frozen=options.backend == "ceres", surface=surface)
    nodes, start, control = solve(problem, nodes, start, options, damping_factors)
    return Result(nodes, start, control, grids)


def refine_prefix(points: DataFrame, nodes: DataFrame, poses: DataFrame, motions: DataFrame, grids: DataFrame,
                  config: RunConfig, relations: DataFrame | None,
                  damping_factors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One increment: rebuild the problem over all frames so far and refine it."""
    options = effective_solver(replace(config.solver, max_iterations=config.iterations_per_increment))
    problem = build_problem(points, nodes, poses, motions, grids, config.problem, relations,
                            frozen=options.backend == "ceres")
    return solve(problem, nodes, poses, options, damping_factors)


def add_totals(total: DataFrame | None, step: DataFrame) -> DataFrame:
    """Accumulate solver reports: iterations and seconds add up, histories concatenate, the last flags stay."""
    step = step.select("run", "converged", "iterations", "initial_cost", "final_cost", "cost_history", "duration_seconds")
    if total is None:
        return pin(step, "total")
    older = total.toDF("run", *[f"o_{c}" for c in total.columns[1:]])
    both = older.join(step, "run", "full")
    return pin(both.select(
        "run", F.coalesce("converged", "o_converged").alias("converged"),
        (F.coalesce("iterations", F.lit(0)) + F.coalesce("o_iterations", F.lit(0))).alias("iterations"),
        F.coalesce("o_initial_cost", "initial_cost").alias("initial_cost"),
        F.coalesce("final_cost", "o_final_cost").alias("final_cost"),
        F.concat(F.coalesce("o_cost_history", F.array().cast("array<double>")),
                 F.coalesce("cost_history", F.array().cast("array<double>"))).alias("cost_history"),
        (F.coalesce("duration_seconds", F.lit(0.0)) + F.coalesce("o_duration_seconds", F.lit(0.0))).alias("duration_seconds")), "total")


def run_incremental(points: DataFrame, poses: DataFrame, config: RunConfig, relations: DataFrame | None = None,
                    on_snapshot=None, damping_factors: DataFrame | None = None) -> Result:
    """Append frames in increments on the last optimised pose and refine everything so far.

    All runs advance together; a run that has ended keeps its result.  ``on_snapshot(frames, nodes,
    poses)`` is called every ``snapshot_every`` increments and after the last one.
    """
    points, poses = pin(points, "points"), pin(poses.select(*POSE_COLUMNS), "poses")
    grids = pin(make_grids(points, poses, config.map), "grids")
    motions = pin(odometry(poses, RUN), "motions")
    first = poses.where("frame = 0")
    nodes, _ = starting_nodes(points.where("frame = 0"), first, grids, config.map)
    last_frame = poses.agg(F.max("frame")).first()[0]
    estimate, total, reached, increment = first, None, 1, 0
    while reached <= last_frame:
        until = min(last_frame + 1, reached + config.increment_size)
        open_runs = motions.where((F.col("j") >= reached) & (F.col("j") < until)).select("run").distinct()
        fresh = motions.where((F.col("j") >= reached) & (F.col("j") < until))
        grown = pin(append_frames(estimate.join(open_runs, "run", "left_semi"), fresh, RUN), "poses")
        live_nodes = nodes.join(open_runs, "run", "left_semi")
        part_nodes, part_poses, report = refine_prefix(
            points.where(F.col("frame") < until).join(open_runs, "run", "left_semi"), live_nodes, grown,
            motions.where(F.col("j") < until).join(open_runs, "run", "left_semi"), grids, config, relations, damping_factors)
        nodes = pin(part_nodes.unionByName(nodes.join(open_runs, "run", "left_anti")), "nodes")
        estimate = pin(part_poses.unionByName(estimate.join(open_runs, "run", "left_anti").select(*part_poses.columns)), "poses")
        total = add_totals(total, report)
        reached, increment = until, increment + 1
        if on_snapshot and config.snapshot_every and (increment % config.snapshot_every == 0 or reached > last_frame):
            on_snapshot(reached, nodes, estimate)
    return Result(nodes, estimate, total, grids)


def write_outputs(result: Result, points: DataFrame, odometry_poses: DataFrame, folder: str,
                  truth: DataFrame | None = None) -> DataFrame:
    """Write tables and text exports of a run; returns the out-of-domain report."""
    world = place(points, result.poses)
    for name, df in (("poses_estimated", result.poses), ("poses_odometry", odometry_poses), ("map", result.nodes),
                     ("scan_points_global", world.select("run", "frame", "idx", "gx", "gy"))):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    columns = ["x", "y", "theta"]
    write_lines(render_csv(result.poses, "run", "frame", columns), f"{folder}/text/poses_estimated")
    write_lines(render_csv(odometry_poses.select(*POSE_COLUMNS), "run", "frame", columns), f"{folder}/text/poses_odometry")
    write_lines(render_map(result.nodes, result.grids, "run"), f"{folder}/text/map")
    rows = number_rows(world.select("run", "frame", "idx", significant("gx").alias("x"), significant("gy").alias("y")),
                       RUN, ["frame", "idx"], "at")
    write_lines(render_csv(rows, "run", "at", ["x", "y"]), f"{folder}/text/scan_points_global")
    if truth is not None:
        truth.write.mode("overwrite").parquet(f"{folder}/poses_ground_truth")
        write_lines(render_csv(truth, "run", "frame", columns), f"{folder}/text/poses_ground_truth")
    errors = trajectory_errors(result.poses, truth, RUN) if truth is not None else None
    metrics_json(result.control, errors, RUN).write.mode("overwrite").partitionBy("run").text(f"{folder}/text/metrics")
    return outside_share(world, result.grids, RUN)


def significant(column: str, digits: int = 9) -> Column:
    """A number rounded to so many significant digits."""
    unit = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(F.col(column)))))
    return F.when(F.col(column) == 0, 0.0).otherwise(F.rint(F.col(column) * unit) / unit)


def run_summary(result: Result, folder: str) -> DataFrame:
    """What a run reports when it ends: one row each."""
    return result.control.select("run", "iterations", "initial_cost", "final_cost", "duration_seconds", F.lit(folder).alias("outputs"))


def run_config(spark: SparkSession, config: RunConfig) -> Result:
    """Load a dataset folder, estimate, and write the outputs the configuration asks for."""
    zero = F.lit(0).cast("bigint").alias("run")
    points, poses = (pin(df.select(zero, "*"), "dataset") for df in load_dataset(spark, config.dataset_dir))
    if poses.count() < 2:
        raise ValueError("one scan alone cannot be aligned")

    def listed(path: str) -> DataFrame:
        return parse_poses(read_lines(spark, path)).select(zero, "frame", "x", "y", "theta")

    relations = None
    if config.relations_file:
        relations = pin(parse_relations(read_lines(spark, config.relations_file)).select(
            zero, "i", "j", "dx", "dy", "dtheta", "sqrt_weight"), "relations")
    if config.mode == "batch":
        result = run_batch(points, poses, config, relations, listed(config.initial_poses) if config.initial_poses else None)
    else:
        grids = pin(make_grids(points, poses, config.map), "grids")

        def snapshot(frames: int, nodes: DataFrame, estimate: DataFrame) -> None:
            write_snapshot(nodes, grids, estimate, f"{config.output_dir}/snapshots", frames)

        result = run_incremental(points, poses, config, relations, snapshot)
    truth = listed(config.ground_truth_poses) if config.ground_truth_poses else None
    write_outputs(result, points, poses, config.output_dir, truth)
    return result


def stability_ensemble(points: DataFrame, poses: DataFrame, config: RunConfig, runs: int = 8, jitter: float = 1e-9,
                       min_gap: int = 200, radius: float = 3.0, factor: float = 5.0, relations: DataFrame | None = None,
                       initial: DataFrame | None = None) -> DataFrame:
    """Repeat a configuration with tiny damping changes and summarise the revisit medians per run.

    The members of all runs are runs of their own, solved side by side: the number of jobs does not grow with them.  Every member has
    the whole configuration, its relations and starting poses included.  A member without revisits scores infinity.
    """
    return summarise_ensemble(pin(ensemble_scores(points, poses, config, runs, jitter, min_gap, radius, relations, initial), "scores"),
                              RUN, "median", factor)


def ensemble_scores(points: DataFrame, poses: DataFrame, config: RunConfig, members: int, jitter: float, min_gap: int, radius: float,
                    relations: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """``(run, member, median)``: the revisit median of every member, whose first damping is multiplied by 1 + member * jitter."""
    def spread(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        every = df.withColumn("_member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
        return every.withColumn("run", F.col("run") * members + F.col("_member")).drop("_member")

    member = F.pmod(F.col("run"), F.lit(members))
    many = pin(spread(poses), "members")
    factors = many.select("run").distinct().withColumn("factor", 1 + member * F.lit(float(jitter)))
    result = (run_batch(spread(points), many, config, spread(relations), spread(initial), factors) if config.mode == "batch"
              else run_incremental(spread(points), many, config, spread(relations), damping_factors=factors))
    score = revisit_score(place(spread(points), result.poses), result.poses, min_gap, radius)
    return many.select("run").distinct().join(score, "run", "left").select(
        F.floor(F.col("run") / members).alias("run"), member.cast("int").alias("member"), F.coalesce("median", F.lit(float("inf"))).alias("median"))
