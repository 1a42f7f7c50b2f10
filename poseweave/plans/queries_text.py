"""Text-format queries: every one renders table data to lines and reads it back, or parses log lines."""

from pyspark.sql import functions as F

from poseweave.functions.linalg import shown
from poseweave.operators.ordered import number_rows
from poseweave.operators.trajectory import odometry, trajectory_errors
from poseweave.plans import tables as T
from poseweave.plans.catalog import query
from poseweave.plans.queries_grid import GRIDS, NODES, RUN, initial_map
from poseweave.plans.queries_pose import _STEP
from poseweave.plans.queries_relations import THIN_SQL
from poseweave.plans.sqltext import DRIFT, MOTIONS, POSES, SCANS, WORLD, r
from poseweave.session import pin, scratch_path
from poseweave.sources import carmen, textfiles
from poseweave.sources.named import read_named, scan_name, snapshot_name, write_dataset, write_snapshot
from poseweave.streaming.odometry import stream_odometry
from poseweave.streaming.thinning import stream_tracks


@query("pcd_round_trip", f"WITH {SCANS} SELECT scan, idx, {r('sx', 'sx')}, {r('sy', 'sy')} FROM "
       "(SELECT scan, row_number() OVER (PARTITION BY scan ORDER BY idx) - 1 AS idx, sx, sy FROM scans)")
def pcd_round_trip(spark, sf_dir):
    dense = number_rows(T.scans(spark, sf_dir).withColumnRenamed("idx", "beam"), ["scan"], ["beam"], "idx")
    lines = textfiles.render_pcd(dense.withColumn("file", F.concat(F.lit("scan"), F.col("scan"))))
    points = textfiles.parse_pcd(lines)
    return points.select(F.substring("file", 5, 20).cast("bigint").alias("scan"), "idx", shown(F.col("sx")).alias("sx"),
                         shown(F.col("sy")).alias("sy"))


@query("poses_round_trip", f"WITH {POSES} SELECT run, frame, {r('x', 'x')}, {r('y', 'y')}, {r('theta', 'theta')} FROM poses")
def poses_round_trip(spark, sf_dir):
    lines = textfiles.render_csv(T.poses(spark, sf_dir), "run", "frame", ["x", "y", "theta"])
    return textfiles.parse_poses(lines).select(
        F.col("file").alias("run"), "frame", *[shown(F.col(c)).alias(c) for c in ("x", "y", "theta")])


@query("relations_round_trip", f"""WITH {POSES}, {_STEP}
SELECT run, i, j, {r('dx', 'dx')}, {r('dy', 'dy')}, {r('dtheta', 'dtheta')}, {r('sqrt(1 + i % 4)', 'sqrt_weight')} FROM step""")
def relations_round_trip(spark, sf_dir):
    rows = odometry(T.poses(spark, sf_dir), ["run"]).withColumns(
        {"residual": F.lit(0.1), "inliers": F.col("j"), "weight": (1 + F.col("i") % 4).cast("double")})
    lines = textfiles.render_csv(rows, "run", "i", ["i", "j", "dx", "dy", "dtheta", "residual", "inliers", "weight"])
    return textfiles.parse_relations(lines).select(
        F.col("file").alias("run"), "i", "j", *[shown(F.col(c)).alias(c) for c in ("dx", "dy", "dtheta", "sqrt_weight")])


@query("map_round_trip", f"""WITH {WORLD}, {GRIDS}, {NODES}
SELECT run, CAST(node AS BIGINT) AS node, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, {r('value', 'value')} FROM nodes""")
def map_round_trip(spark, sf_dir):
    _, _, grid, nodes = initial_map(spark, sf_dir)
    back, _ = textfiles.parse_map(textfiles.render_map(nodes, grid, "run"))
    return back.select(F.col("file").alias("run"), "node", "w", "h", shown(F.col("value")).alias("value"))


@query("map_files", f"""WITH {WORLD}, {GRIDS}, {NODES}
SELECT run, CAST(node AS BIGINT) AS node, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, {r('value', 'value')} FROM nodes""")
def map_files(spark, sf_dir):
    """The snapshot of every run as files with their own names, read back."""
    _, trajectory, grid, nodes = initial_map(spark, sf_dir)
    folder = scratch_path(spark, "snapshots")
    write_snapshot(nodes, grid, trajectory, folder, 1, run="run")
    names = grid.select(snapshot_name("map", "txt", 1, "run").alias("file"))
    back, _ = textfiles.parse_map(read_named(names, folder))
    return back.select(F.regexp_extract("file", r"([^/]+)/map_", 1).cast("bigint").alias("run"), "node", "w", "h", shown(F.col("value")).alias("value"))


@query("dataset_files", f"WITH {WORLD} SELECT run, frame, row_number() OVER (PARTITION BY run, frame ORDER BY idx) - 1 AS idx, "
       f"{r('sx', 'sx')}, {r('sy', 'sy')} FROM world")
def dataset_files(spark, sf_dir):
    """The data set of every run as scan files with their own names, read back."""
    folder = scratch_path(spark, "dataset")
    poses = pin(T.poses(spark, sf_dir), "poses")
    write_dataset(T.frame_scans(spark, sf_dir), poses, folder, run="run")
    points = textfiles.parse_pcd(read_named(poses.select(scan_name("frame", "run").alias("file")), folder))
    part = r"([^/]+)/scan(\d+)\.pcd$"
    return points.select(*(F.regexp_extract("file", part, k).cast("bigint").alias(c) for k, c in ((1, "run"), (2, "frame"))), "idx",
                         shown(F.col("sx")).alias("sx"), shown(F.col("sy")).alias("sy"))


@query("metrics_documents", f"""WITH {DRIFT}
SELECT a.run, count(*) > 60 AS converged, count(*) AS iterations,
       {r('avg(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)))', 'mean_translation_error')}
FROM poses a JOIN drift c ON c.run = a.run AND c.frame = a.frame GROUP BY a.run""")
def metrics_documents(spark, sf_dir):
    errors = trajectory_errors(T.drifted(spark, sf_dir), T.poses(spark, sf_dir), RUN)
    control = errors.select("run", (F.col("frames") > 60).alias("converged"), F.col("frames").alias("iterations"),
                            F.lit(1.0).alias("initial_cost"), F.lit(0.5).alias("final_cost"))
    back = textfiles.metrics_json(control, errors, RUN).withColumn("d", F.from_json(
        "json", "converged boolean, iterations bigint, mean_translation_error double"))
    return back.select("run", "d.converged", "d.iterations", shown(F.col("d.mean_translation_error")).alias("mean_translation_error"))


@query("snapshot_choice", f"""WITH {MOTIONS}, files AS (
  SELECT 'map_' || lpad(CAST(frame + 1 AS VARCHAR), 6, '0') || '.txt' AS file FROM motions GROUP BY frame),
ranked AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS position, count(*) OVER () AS n FROM files)
SELECT file, position, CAST(substr(file, 5, 6) AS BIGINT) AS frames FROM ranked WHERE position % 7 = 0 OR position = n - 1""")
def snapshot_choice(spark, sf_dir):
    frames = T.motions(spark, sf_dir).select("frame").distinct()
    files = frames.select(F.concat(F.lit("map_"), F.lpad((F.col("frame") + 1).cast("string"), 6, "0"), F.lit(".txt")).alias("file"))
    return textfiles.snapshot_choice(files, 7).select("file", "position", "frames")


def log_lines(spark, sf_dir, motions=None):
    """One log line per frame: laser messages in both spellings, and other messages for error events."""
    kinds = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("scan"), "event_type")
    rows = T.poses(spark, sf_dir, motions).join(kinds, "scan")
    readings = [F.col("scan") % 7 + 0.05, F.col("scan") % 50 + 0.5, F.lit(50.0), F.col("frame") % 20 + 1.0]
    tail = [*[F.col(c) for c in ("x", "y", "theta", "x", "y", "theta")], F.col("scan") + 0.5, F.lit("host"), F.lit(0.1)]
    config = F.lit("0 -1.5708 3.1416 0.0175 80.0 0.01 0")
    head = F.when(F.col("event_type") == "error", F.lit("ODOM 4")).when(
        F.col("event_type") == "signup", F.concat_ws(" ", F.lit("ROBOTLASER1"), config, F.lit("4"))).otherwise(F.lit("FLASER 4"))
    line = F.concat_ws(" ", head, *[c.cast("string") for c in readings + tail])
    return rows.select(F.col("run").cast("string").alias("file"), F.col("frame").alias("line_no"), line.alias("line"))


_LASERS = POSES + """,
lasers AS (
  SELECT p.run, p.frame AS line_no, p.x, p.y, p.theta, p.scan, row_number() OVER (PARTITION BY p.run ORDER BY p.frame) - 1 AS frame,
         [p.scan % 7 + 0.05, p.scan % 50 + 0.5, 50.0, p.frame % 20 + 1.0] AS readings
  FROM poses p JOIN events e ON e.event_id = p.scan WHERE e.event_type <> 'error')"""


@query("laser_messages", f"""WITH {_LASERS}
SELECT CAST(run AS VARCHAR) AS file, line_no, len(readings) AS n, {r('list_sum(readings)', 'total')}, {r('x', 'x')}, {r('y', 'y')},
       {r('theta', 'theta')}, scan + 0.5 AS stamp
FROM lasers""")
def laser_messages(spark, sf_dir):
    m = carmen.parse_lasers(log_lines(spark, sf_dir))
    total = F.aggregate("readings", F.lit(0.0), lambda a, v: a + v)
    return m.select("file", "line_no", F.size("readings").cast("bigint").alias("n"), shown(total).alias("total"),
                    *[shown(F.col(c)).alias(c) for c in ("x", "y", "theta")], F.col("stamp").cast("double").alias("stamp"))


def relation_text(m):
    """Benchmark relation lines between frames one and two steps apart, keyed by log timestamps."""
    later = m.select("run", (F.col("frame") - 2).alias("frame"), F.col("scan").alias("other"))
    rows = m.join(later, ["run", "frame"])
    line = F.concat_ws(" ", (F.col("scan") + 0.5).cast("string"), (F.col("other") + 0.5).cast("string"), F.col("dx").cast("string"),
                       F.lit("0.25 0 0 0"), F.col("dtheta").cast("string"))
    return rows.select("run", F.lit("relations").alias("file"), F.col("scan").alias("line_no"), line.alias("line"))


_WANTED = """wanted AS (
  SELECT a.run, a.scan AS s1, b.scan AS s2, a.dx, a.dtheta FROM motions a JOIN motions b ON b.run = a.run AND b.frame = a.frame + 2)"""
_THIN = THIN_SQL.format(source="lasers", travel=2.03, turn=0.2512)
_SLOTS = f"""{_THIN}, chosen AS (
  SELECT run, frame AS message FROM kept WHERE frame = last
  UNION SELECT l.run, l.frame FROM lasers l WHERE l.scan IN (SELECT s1 FROM wanted UNION SELECT s2 FROM wanted)),
slots AS (SELECT * FROM (SELECT run, message, row_number() OVER (PARTITION BY run ORDER BY message) - 1 AS slot FROM chosen) WHERE slot < LIMIT_FRAMES),
placed AS (SELECT s.run, s.slot, l.x, l.y, l.theta, l.scan, l.readings, first_value(l.x) OVER w AS ox, first_value(l.y) OVER w AS oy,
                  first_value(l.theta) OVER w AS ot
           FROM slots s JOIN lasers l ON l.run = s.run AND l.frame = s.message WINDOW w AS (PARTITION BY s.run ORDER BY s.slot))"""


_LIMITED, _SLOTS = _SLOTS.replace("LIMIT_FRAMES", "30"), _SLOTS.replace(" WHERE slot < LIMIT_FRAMES", "")


def _converted(spark, sf_dir, limit=0):
    motions = T.motions(spark, sf_dir)
    # Written, since numbering reads its input twice, the first time for the ranges only.
    messages = pin(carmen.parse_lasers(log_lines(spark, sf_dir, motions)), "messages").withColumn("run", F.col("file").cast("bigint"))
    relations = relation_text(motions)
    points, poses = carmen.convert(messages, 2.03, 0.2512, limit=limit, wanted=carmen.relation_stamps(relations))
    return points, poses, relations


@query("log_poses", f"""WITH RECURSIVE {_LASERS}, {_WANTED}, {_SLOTS}
SELECT run, slot AS frame, {r('cos(ot) * (x - ox) + sin(ot) * (y - oy)', 'x')}, {r('-sin(ot) * (x - ox) + cos(ot) * (y - oy)', 'y')},
       {r('atan2(sin(theta - ot), cos(theta - ot))', 'theta')}
FROM placed""")
def log_poses(spark, sf_dir):
    _, poses, _ = _converted(spark, sf_dir)
    return poses.select("run", "frame", *[shown(F.col(c)).alias(c) for c in ("x", "y", "theta")])


@query("log_limit", f"""WITH RECURSIVE {_LASERS}, {_WANTED}, {_LIMITED}
SELECT run, slot AS frame, {r('cos(ot) * (x - ox) + sin(ot) * (y - oy)', 'x')}, {r('-sin(ot) * (x - ox) + cos(ot) * (y - oy)', 'y')},
       {r('atan2(sin(theta - ot), cos(theta - ot))', 'theta')}
FROM placed""")
def log_limit(spark, sf_dir):
    """The conversion that keeps the first 30 scans of each log."""
    _, poses, _ = _converted(spark, sf_dir, limit=30)
    return poses.select("run", "frame", *[shown(F.col(c)).alias(c) for c in ("x", "y", "theta")])


@query("log_scans", f"""WITH RECURSIVE {_LASERS}, {_WANTED}, {_SLOTS}
SELECT run, frame, idx, {r('rng * cos(-pi() / 2 + idx * (pi() / 4))', 'sx')}, {r('rng * sin(-pi() / 2 + idx * (pi() / 4))', 'sy')}
FROM (SELECT run, slot AS frame, k AS idx, CAST(readings[k + 1] AS DOUBLE) AS rng FROM placed, (SELECT range AS k FROM range(4)))
WHERE rng >= CAST(0.1 AS DOUBLE) AND rng < 49""")
def log_scans(spark, sf_dir):
    points, _, _ = _converted(spark, sf_dir)
    return points.select("run", "frame", "idx", shown(F.col("sx")).alias("sx"), shown(F.col("sy")).alias("sy"))


@query("log_relations", f"""WITH RECURSIVE {_LASERS}, {_WANTED}, {_SLOTS}
SELECT w.run, w.s1 AS line_no, a.slot AS i, b.slot AS j, {r('w.dx', 'dx')}, {r('0.25', 'dy')}, {r('w.dtheta', 'dtheta')}
FROM wanted w JOIN placed a ON a.run = w.run AND a.scan = w.s1 JOIN placed b ON b.run = w.run AND b.scan = w.s2""")
def log_relations(spark, sf_dir):
    _, poses, relations = _converted(spark, sf_dir)
    out = carmen.index_relations(relations, poses.select("run", "frame", "at"))
    return out.select("run", "line_no", "i", "j", *[shown(F.col(c)).alias(c) for c in ("dx", "dy", "dtheta")])


#: Micro-batches the events are dealt to, in time order, and events of one file.
FEED_BATCHES, FEED_ROWS = 5, 1 << 20


def event_feed(spark, sf_dir):
    """The events as files in time order and the number of files of a micro-batch."""
    rows = T.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    numbered = pin(number_rows(rows, [], ["ts", "event_id"], "at", total="n"), "feed-rows")
    folder = scratch_path(spark, "feed")
    files = 1 + numbered.count() // (FEED_BATCHES * FEED_ROWS)
    for k in range(FEED_BATCHES):
        part = numbered.where(F.floor(F.col("at") * FEED_BATCHES / F.col("n")) == k).drop("at", "n")
        part.repartition(files).write.mode("append").parquet(folder)
    return folder, files


@query("streamed_trajectory", f"WITH {POSES} SELECT run, frame, {r('x', 'x')}, {r('y', 'y')}, {r('theta', 'theta')} FROM poses")
def streamed_trajectory(spark, sf_dir):
    """The trajectory query as a stream over the events in several micro-batches."""
    folder, files = event_feed(spark, sf_dir)
    out = stream_odometry(spark, folder, T.motion_events, pattern="*.parquet", files_per_batch=files)
    return out.select("run", "frame", *[shown(F.col(c)).alias(c) for c in ("x", "y", "theta")])


@query("streamed_thinning", f"""WITH RECURSIVE {POSES}, {THIN_SQL.format(source='poses', travel=2.03, turn=0.2512)},
steps AS (SELECT run, frame, scan, dx, dtheta FROM motions)
SELECT p.run, p.frame, s.scan, {r('s.dx', 'dx')}, {r('s.dtheta', 'dtheta')}, {r('p.x', 'x')}, {r('p.y', 'y')}, {r('p.theta', 'theta')},
       k.frame IS NOT NULL AS kept
FROM poses p JOIN steps s ON s.run = p.run AND s.frame = p.frame
LEFT JOIN (SELECT run, frame FROM kept WHERE frame = last) k ON k.run = p.run AND k.frame = p.frame""")
def streamed_thinning(spark, sf_dir):
    """Poses, motions and kept frames from keyed state, in several micro-batches."""
    folder, files = event_feed(spark, sf_dir)
    out = stream_tracks(spark, folder, T.motion_events, scratch_path(spark, "tracks"), scratch_path(spark, "progress"), 2.03, 0.2512,
                        files_per_batch=files)
    return out.select("run", "frame", "scan", *[shown(F.col(c)).alias(c) for c in ("dx", "dtheta", "x", "y", "theta")], "kept")
