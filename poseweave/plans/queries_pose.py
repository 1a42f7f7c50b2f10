"""Pose and trajectory queries."""

from pyspark.sql import functions as F

from poseweave.functions.linalg import shown
from poseweave.functions.pose import compose, pose, pose_error, relative
from poseweave.operators.ordered import look_ahead
from poseweave.operators.trajectory import anchor, gap_motions, odometry, trajectory_errors, unwrap
from poseweave.plans import tables as T
from poseweave.plans.catalog import query
from poseweave.plans.sqltext import DRIFT, POSES, SCANS, WORLD, r


def _shown(df, keys, values):
    return df.select(*keys, *[shown(F.col(v)).alias(v) for v in values])


@query("endpoint_occupancy", f"""WITH {WORLD}
SELECT run, CAST(floor(round(gx, 6)) AS BIGINT) AS cx, CAST(floor(round(gy, 6)) AS BIGINT) AS cy,
       count(*) AS endpoints, {r('avg(sqrt(sx * sx + sy * sy))', 'mean_range')}
FROM world GROUP BY ALL""")
def endpoint_occupancy(spark, sf_dir):
    cell = [F.floor(F.round(F.col(g), 6)).cast("bigint").alias(c) for g, c in (("gx", "cx"), ("gy", "cy"))]
    return T.world(spark, sf_dir).groupBy("run", *cell).agg(
        F.count(F.lit(1)).alias("endpoints"), shown(F.avg(F.hypot("sx", "sy"))).alias("mean_range"))


@query("trajectory", f"WITH {POSES} SELECT run, frame, {r('x', 'x')}, {r('y', 'y')}, {r('theta', 'theta')} FROM poses")
def trajectory(spark, sf_dir):
    return _shown(T.poses(spark, sf_dir), ["run", "frame"], ["x", "y", "theta"])


@query("anchored_trajectory", f"""WITH {POSES}, o AS (SELECT run, x AS ox, y AS oy, theta AS ot FROM poses WHERE frame = 0)
SELECT run, frame, {r('cos(ot) * (x - ox) + sin(ot) * (y - oy)', 'x')},
       {r('-sin(ot) * (x - ox) + cos(ot) * (y - oy)', 'y')},
       {r('atan2(sin(theta - ot), cos(theta - ot))', 'theta')}
FROM poses JOIN o USING (run)""")
def anchored_trajectory(spark, sf_dir):
    return _shown(anchor(T.poses(spark, sf_dir), ["run"]), ["run", "frame"], ["x", "y", "theta"])


_STEP = """step AS (
  SELECT a.run, a.frame AS i, b.frame AS j, a.x, a.y, a.theta,
         cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS dx,
         -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS dy,
         atan2(sin(b.theta - a.theta), cos(b.theta - a.theta)) AS dtheta
  FROM poses a JOIN poses b ON b.run = a.run AND b.frame = a.frame + 1)"""


@query("odometry_steps", f"""WITH {POSES}, {_STEP}
SELECT run, i, j, {r('dx', 'dx')}, {r('dy', 'dy')}, {r('dtheta', 'dtheta')} FROM step""")
def odometry_steps(spark, sf_dir):
    return _shown(odometry(T.poses(spark, sf_dir), ["run"]), ["run", "i", "j"], ["dx", "dy", "dtheta"])


@query("pose_composition", f"""WITH {POSES}, {_STEP}
SELECT run, i, {r('x + cos(theta) * dx - sin(theta) * dy', 'x')}, {r('y + sin(theta) * dx + cos(theta) * dy', 'y')},
       {r('atan2(sin(theta + dtheta), cos(theta + dtheta))', 'theta')}
FROM step""")
def pose_composition(spark, sf_dir):
    ahead = look_ahead(T.poses(spark, sf_dir), ["run"], "frame", 1, {"x": "bx", "y": "by", "theta": "btheta"})
    again = compose(pose(), relative(pose(), pose("b")))
    return _shown(ahead.select("run", F.col("frame").alias("i"), *again.named()), ["run", "i"], ["x", "y", "theta"])


@query("step_errors", f"""WITH {DRIFT}, pair AS (
  SELECT a.run, a.frame AS i,
         cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS dx,
         -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS dy, b.theta - a.theta AS dt,
         cos(c.theta) * (d.x - c.x) + sin(c.theta) * (d.y - c.y) AS ex,
         -sin(c.theta) * (d.x - c.x) + cos(c.theta) * (d.y - c.y) AS ey, d.theta - c.theta AS et
  FROM poses a JOIN poses b ON b.run = a.run AND b.frame = a.frame + 1
       JOIN drift c ON c.run = a.run AND c.frame = a.frame JOIN drift d ON d.run = a.run AND d.frame = a.frame + 1)
SELECT run, i, {r('sqrt((ex - dx) * (ex - dx) + (ey - dy) * (ey - dy))', 'translation')},
       {r('abs(atan2(sin(et - dt), cos(et - dt)))', 'rotation')}
FROM pair""")
def step_errors(spark, sf_dir):
    truth = odometry(T.poses(spark, sf_dir), ["run"])
    guess = odometry(T.drifted(spark, sf_dir), ["run"]).toDF("run", "i", "j", "ex", "ey", "etheta")
    translation, rotation = pose_error(pose("d"), pose("e"))
    both = truth.join(guess, ["run", "i", "j"])
    return both.select("run", "i", shown(translation).alias("translation"), shown(rotation).alias("rotation"))


_REL = """rel AS (
  SELECT a.run, avg(sqrt((dx - ex) * (dx - ex) + (dy - ey) * (dy - ey))) AS mrt,
         avg(abs(atan2(sin(et - dt), cos(et - dt)))) AS mrr
  FROM (SELECT a.run, cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS dx,
               -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS dy, b.theta - a.theta AS dt,
               cos(c.theta) * (d.x - c.x) + sin(c.theta) * (d.y - c.y) AS ex,
               -sin(c.theta) * (d.x - c.x) + cos(c.theta) * (d.y - c.y) AS ey, d.theta - c.theta AS et
        FROM poses a JOIN poses b ON b.run = a.run AND b.frame = a.frame + 1
             JOIN drift c ON c.run = a.run AND c.frame = a.frame
             JOIN drift d ON d.run = a.run AND d.frame = a.frame + 1) a GROUP BY a.run)"""


@query("trajectory_metrics", f"""WITH {DRIFT}, {_REL}, per AS (
  SELECT a.run, count(*) AS frames, avg(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))) AS mt,
         avg(abs(atan2(sin(c.theta - a.theta), cos(c.theta - a.theta)))) AS mr
  FROM poses a JOIN drift c ON c.run = a.run AND c.frame = a.frame GROUP BY a.run)
SELECT run, frames, {r('mt', 'mean_translation_error')}, {r('mr', 'mean_rotation_error')},
       {r('mrt', 'mean_relative_translation_error')}, {r('mrr', 'mean_relative_rotation_error')}
FROM per JOIN rel USING (run)""")
def trajectory_metrics(spark, sf_dir):
    errors = trajectory_errors(T.drifted(spark, sf_dir), T.poses(spark, sf_dir), ["run"])
    return _shown(errors, ["run", "frames"], [c for c in errors.columns if c.startswith("mean_")])


_UNWRAP = """turns AS (
  SELECT *, theta - lag(theta) OVER (PARTITION BY run ORDER BY frame) AS jump FROM {source}),
folds AS (
  SELECT *, jump + pi() - 2 * pi() * floor((jump + pi()) / (2 * pi())) - pi() AS m FROM turns),
unwrapped AS (
  SELECT run, frame, x, y, theta,
         theta + sum(CASE WHEN abs(jump) >= pi() THEN (CASE WHEN m = -pi() AND jump > 0 THEN pi() ELSE m END) - jump
                     ELSE 0 END) OVER (PARTITION BY run ORDER BY frame ROWS UNBOUNDED PRECEDING) AS u FROM folds)"""


@query("unwrapped_heading", f"""WITH {POSES}, {_UNWRAP.format(source='poses')}
SELECT run, frame, {r('u', 'unwrapped')} FROM unwrapped""")
def unwrapped_heading(spark, sf_dir):
    return _shown(unwrap(T.poses(spark, sf_dir), ["run"]), ["run", "frame"], ["unwrapped"])


@query("gap_motions", f"""WITH {POSES}, {_UNWRAP.format(source='poses')}
SELECT a.run, a.frame AS i, {r('cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y)', 'dx')},
       {r('-sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y)', 'dy')}, {r('b.u - a.u', 'dtheta')}
FROM unwrapped a JOIN unwrapped b ON b.run = a.run AND b.frame = a.frame + 5""")
def gap_motions_5(spark, sf_dir):
    return _shown(gap_motions(T.poses(spark, sf_dir), ["run"], 5), ["run", "i"], ["dx", "dy", "dtheta"])


@query("beam_endpoints", f"WITH {SCANS} SELECT scan, idx, {r('sx', 'sx')}, {r('sy', 'sy')} FROM scans")
def beam_endpoints(spark, sf_dir):
    return _shown(T.scans(spark, sf_dir), ["scan", "idx"], ["sx", "sy"])


@query("world_points", f"WITH {WORLD} SELECT run, frame, idx, {r('gx', 'gx')}, {r('gy', 'gy')} FROM world")
def world_points(spark, sf_dir):
    return _shown(T.world(spark, sf_dir), ["run", "frame", "idx"], ["gx", "gy"])


@query("frame_slice", f"""WITH {POSES}
SELECT run, frame, {r('x', 'x')}, {r('y', 'y')}, {r('theta', 'theta')} FROM poses WHERE frame >= 10 AND frame < 40""")
def frame_slice(spark, sf_dir):
    region = T.poses(spark, sf_dir).where((F.col("frame") >= 10) & (F.col("frame") < 40))
    return _shown(region, ["run", "frame"], ["x", "y", "theta"])
