"""Loop-closure, revisit and stability queries."""

from pyspark.sql import functions as F

from poseweave.functions.linalg import shown
from poseweave.operators import relations as L
from poseweave.operators.alignment import alignment_sums
from poseweave.operators.stability import gap_deviation, rigid_deviation, summarise_ensemble
from poseweave.operators.thinning import decimate
from poseweave.operators.trajectory import odometry
from poseweave.plans import tables as T
from poseweave.plans.catalog import query
from poseweave.plans.queries_grid import _LOCAL_NEAR, _normals_sql
from poseweave.plans.sqltext import DRIFT, MOTIONS, POSES, WORLD, integrated, materialized, r
from poseweave.session import pin

MIN_GAP, RADIUS = 10, 3.0
SCALES = {"a": 1.0, "b": 1.02, "c": 0.97}


def _pairs_sql(low: str) -> str:
    return f"""pairs AS (
  SELECT p.run, p.frame AS i, q.frame AS j, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS distance
  FROM poses q JOIN poses p ON p.run = q.run AND p.frame <= q.frame - {MIN_GAP} {low}
  WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < {RADIUS}
  QUALIFY row_number() OVER (PARTITION BY q.run, q.frame
     ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), p.frame) <= 2)"""


@query("select_pairs", f"WITH {POSES}, {_pairs_sql('')} SELECT run, i, j, {r('distance', 'distance')} FROM pairs")
def select_pairs(spark, sf_dir):
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    return L.select_pairs(trajectory, MIN_GAP, RADIUS, 2).withColumn("distance", shown(F.col("distance")))


@query("select_pairs_band", f"WITH {POSES}, {_pairs_sql('AND p.frame >= q.frame - 20')} SELECT run, i, j, {r('distance', 'distance')} FROM pairs")
def select_pairs_band(spark, sf_dir):
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    return L.select_pairs(trajectory, MIN_GAP, RADIUS, 2, max_gap=20).withColumn("distance", shown(F.col("distance")))


_REVISIT = f"""revisit AS (
  SELECT q.run, p.frame AS i, q.frame AS j FROM poses q JOIN poses p ON p.run = q.run AND p.frame < q.frame - {MIN_GAP}
  WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < {RADIUS})"""


@query("revisit_pairs", f"WITH {POSES}, {_REVISIT} SELECT run, i, j FROM revisit")
def revisit_pairs(spark, sf_dir):
    return L.revisit_pairs(T.poses(spark, sf_dir), MIN_GAP, RADIUS)


@query("revisit_intervals", f"""WITH {POSES}, {_REVISIT},
island AS (SELECT *, i - row_number() OVER (PARTITION BY run, j ORDER BY i) AS visit FROM revisit)
SELECT run, j, min(i) AS i_from, max(i) AS i_to FROM island GROUP BY run, j, visit""")
def revisit_intervals(spark, sf_dir):
    return L.revisit_intervals(T.poses(spark, sf_dir), MIN_GAP, RADIUS)


@query("revisit_scores", f"""WITH {WORLD}, {_REVISIT}, near AS (
  SELECT q.run, q.frame, q.idx, sqrt(min((p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy))) AS d
  FROM revisit v JOIN world q ON q.run = v.run AND q.frame = v.j JOIN world p ON p.run = v.run AND p.frame = v.i
  GROUP BY q.run, q.frame, q.idx)
SELECT run, {r('quantile_cont(d, 0.5)', 'median')}, {r('quantile_cont(d, 0.9)', 'p90')}, count(DISTINCT frame) AS frames
FROM near GROUP BY run""")
def revisit_scores(spark, sf_dir):
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    world = T.to_world(T.scans(spark, sf_dir), trajectory, ["scan"])
    score = L.revisit_score(world, trajectory, MIN_GAP, RADIUS)
    return score.select("run", shown(F.col("median")).alias("median"), shown(F.col("p90")).alias("p90"), "frames")


_MATCH = """m AS (
  SELECT a.run, a.frame AS i, b.frame AS j, cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS dx,
         -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS dy,
         atan2(sin(b.theta - a.theta), cos(b.theta - a.theta)) AS dt
  FROM drift a JOIN drift b ON b.run = a.run AND b.frame = a.frame + 1),
moved AS (SELECT m.run, m.i, m.j, w.idx, dx + cos(dt) * sx - sin(dt) * sy AS x, dy + sin(dt) * sx + cos(dt) * sy AS y
          FROM m JOIN world w ON w.run = m.run AND w.frame = m.j),
hit AS (SELECT q.run, q.i, q.j, q.idx, p.idx AS n_idx, (p.sx - q.x) * (p.sx - q.x) + (p.sy - q.y) * (p.sy - q.y) AS d2
        FROM moved q JOIN world p ON p.run = q.run AND p.frame = q.i
        QUALIFY row_number() OVER (PARTITION BY q.run, q.i, q.j, q.idx ORDER BY d2, p.idx) = 1)"""


@query("scan_matches", f"""WITH {WORLD}, {integrated('drift', 'dtheta * CAST(1.02 AS DOUBLE)')}, {_MATCH}
SELECT run, i, j, idx, n_idx, {r('sqrt(d2)', 'distance')} FROM hit WHERE sqrt(d2) < 10""")
def scan_matches(spark, sf_dir):
    aligner = L.Aligner(T.frame_scans(spark, sf_dir), max_correspondence=10.0)
    found = aligner.matches(odometry(T.drifted(spark, sf_dir), ["run"]))
    return found.select("run", "i", "j", "idx", "n_idx", shown(F.sqrt("d2")).alias("distance"))


@query("scan_observability", f"""WITH {WORLD}, {_LOCAL_NEAR.replace('<= 3', '<= 5')}, {_normals_sql('sx', 'sy', ('zx', 'zy'))},
s AS (SELECT run, frame, sum(normal_x * normal_x) AS xx, sum(normal_x * normal_y) AS xy, sum(normal_y * normal_y) AS yy
      FROM normals GROUP BY run, frame),
e AS (SELECT *, (xx + yy) / 2 AS mid, sqrt((xx - yy) / 2 * ((xx - yy) / 2) + xy * xy) AS half FROM s)
SELECT run, frame, {r('(mid - half) / (mid + half)', 'observability')} FROM e""")
def scan_observability(spark, sf_dir):
    out = L.Aligner(T.frame_scans(spark, sf_dir)).scan_observability()
    return out.withColumn("observability", shown(F.col("observability")))


def _judgeable(spark, sf_dir):
    """Step motions with quality columns derived from them, so every guard fires somewhere."""
    motion = odometry(T.poses(spark, sf_dir), ["run"])
    seed = odometry(T.drifted(spark, sf_dir, 1.5), ["run"]).toDF("run", "i", "j", "seed_dx", "seed_dy", "seed_dtheta")
    return motion.join(seed, ["run", "i", "j"]).withColumns({
        "residual": F.abs("dx") / 10, "inliers": F.col("i") + 40, "observability": F.abs("dtheta")})


_JUDGE = POSES + ",\n" + integrated("drift", "dtheta * CAST(1.5 AS DOUBLE)") + """,
judged AS (
  SELECT run, i, j, dx, dy, dt, abs(dx) / 10 AS residual, i + 40 AS inliers, abs(dt) AS observability,
         sqrt((dx - ex) * (dx - ex) + (dy - ey) * (dy - ey)) AS shift,
         degrees(abs(atan2(sin(dt - et), cos(dt - et)))) AS turn
  FROM (SELECT a.run, a.frame AS i, b.frame AS j, cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS dx,
               -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS dy,
               atan2(sin(b.theta - a.theta), cos(b.theta - a.theta)) AS dt,
               cos(c.theta) * (d.x - c.x) + sin(c.theta) * (d.y - c.y) AS ex,
               -sin(c.theta) * (d.x - c.x) + cos(c.theta) * (d.y - c.y) AS ey,
               atan2(sin(d.theta - c.theta), cos(d.theta - c.theta)) AS et
        FROM poses a JOIN poses b ON b.run = a.run AND b.frame = a.frame + 1
             JOIN drift c ON c.run = a.run AND c.frame = a.frame JOIN drift d ON d.run = a.run AND d.frame = a.frame + 1)),
reasons AS (SELECT *, CASE WHEN residual > 0.15 THEN 'residual' WHEN inliers < 50 THEN 'inliers'
     WHEN observability < 0.06 THEN 'observability' WHEN shift > 0.7 OR turn > 5 THEN 'seed_deviation' END AS reason FROM judged)"""


@query("relation_guards", f"WITH {_JUDGE} SELECT run, coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY ALL")
def relation_guards(spark, sf_dir):
    judged = L.guard(_judgeable(spark, sf_dir), min_observability=0.06, max_seed_rotation=5.0)
    return judged.groupBy("run", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("relation_weights", f"""WITH {_JUDGE}, f AS (SELECT *, greatest(residual, 1e-6) AS s FROM judged),
m AS (SELECT run, quantile_cont(s, 0.5) AS mid FROM f GROUP BY run)
SELECT run, i, j, {r('greatest(0.25, least(4.0, (mid / s) * (mid / s)))', 'weight')} FROM f JOIN m USING (run)""")
def relation_weights(spark, sf_dir):
    weighted = L.residual_weights(_judgeable(spark, sf_dir).select("run", "i", "j", "residual"))
    return weighted.select("run", "i", "j", shown(F.col("weight")).alias("weight"))


@query("relation_scores", f"""WITH {DRIFT}, pair AS (
  SELECT a.run, cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS dx,
         -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS dy, b.theta - a.theta AS dt,
         cos(c.theta) * (d.x - c.x) + sin(c.theta) * (d.y - c.y) AS ex,
         -sin(c.theta) * (d.x - c.x) + cos(c.theta) * (d.y - c.y) AS ey, d.theta - c.theta AS et
  FROM poses a JOIN poses b ON b.run = a.run AND b.frame = a.frame + 1
       JOIN drift c ON c.run = a.run AND c.frame = a.frame JOIN drift d ON d.run = a.run AND d.frame = a.frame + 1),
err AS (SELECT run, sqrt((ex - dx) * (ex - dx) + (ey - dy) * (ey - dy)) AS t, degrees(abs(atan2(sin(et - dt), cos(et - dt)))) AS rot FROM pair)
SELECT run, count(*) AS n, {r('avg(t)', 't_mean')}, {r('quantile_cont(t, 0.5)', 't_med')}, {r('avg(rot)', 'r_mean')},
       {r('quantile_cont(rot, 0.5)', 'r_med')}
FROM err GROUP BY run""")
def relation_scores(spark, sf_dir):
    scores = L.score_relations(odometry(T.drifted(spark, sf_dir), ["run"]), pin(T.poses(spark, sf_dir), "poses"))
    return scores.select("run", "n", *[shown(F.col(c)).alias(c) for c in ("t_mean", "t_med", "r_mean", "r_med")])


_SUMS = {f"h{p}{q}": f"sum(a{p} * a{q})" for p in range(3) for q in range(p, 3)} | {f"g{p}": f"sum(a{p} * gap)" for p in range(3)}


@query("alignment_sums", materialized(f"""WITH {WORLD}, {integrated('drift', 'dtheta * CAST(1.02 AS DOUBLE)')}, {_MATCH},
{_LOCAL_NEAR.replace('<= 3', '<= 5')}, {_normals_sql('sx', 'sy', ('zx', 'zy'))},
line AS (SELECT h.run, h.i, h.j, n.normal_x AS a0, n.normal_y AS a1, n.normal_y * q.x - n.normal_x * q.y AS a2,
                n.normal_x * (p.sx - q.x) + n.normal_y * (p.sy - q.y) AS gap
         FROM hit h JOIN moved q ON q.run = h.run AND q.i = h.i AND q.j = h.j AND q.idx = h.idx
              JOIN world p ON p.run = h.run AND p.frame = h.i AND p.idx = h.n_idx
              JOIN normals n ON n.run = h.run AND n.frame = h.i AND n.idx = h.n_idx WHERE sqrt(h.d2) < 10)
SELECT m.run, m.i, m.j, {', '.join(r(f'coalesce({v}, 0)', c) for c, v in _SUMS.items())}, count(a0) AS inliers
FROM m LEFT JOIN line USING (run, i, j) GROUP BY m.run, m.i, m.j"""))
def alignment_sums_of_steps(spark, sf_dir):
    """Normal equations of the first alignment round of all neighbouring frames."""
    found = alignment_sums(T.frame_scans(spark, sf_dir), odometry(T.drifted(spark, sf_dir), ["run"]), max_correspondence=10.0)
    return found.select("run", "i", "j", *[shown(F.col(c)).alias(c) for c in _SUMS], "inliers")


@query("icp_relations")
def icp_relations(spark, sf_dir):
    """All selected pairs, aligned to the end under the operators' own limits, with the guard each one fails, if any.

    The weight is that among the relations that are kept.
    """
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    judged = L.judge_relations(T.frame_scans(spark, sf_dir), trajectory, L.select_pairs(trajectory, MIN_GAP, RADIUS, 1))
    weights = L.residual_weights(judged.where("reason is null")).select(*L.PAIR, "weight")
    return judged.drop(*[f"seed_{m}" for m in L.MOTION], "target_observability").join(weights, L.PAIR, "left")


@query("icp_odometry")
def icp_odometry(spark, sf_dir):
    """Poses integrated from wheel motions, replaced by aligned ones where the operators' own guards allow it."""
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    out, _ = L.refine_odometry(T.frame_scans(spark, sf_dir), trajectory, odometry(trajectory, ["run"]))
    return out


def _estimates(spark, sf_dir):
    return {name: pin(T.drifted(spark, sf_dir, scale), "estimate") for name, scale in SCALES.items()}


_THREE = MOTIONS + "".join(",\n" + integrated(f"est_{n}", f"dtheta * CAST({s} AS DOUBLE)") for n, s in SCALES.items())
_COMBOS = [("a", "b"), ("a", "c"), ("b", "c")]


@query("gauge_rigid", f"""WITH {_THREE}, both_ AS (
  {' UNION ALL '.join(f"SELECT p.run, '{a}' AS a, '{b}' AS b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM est_{a} p JOIN est_{b} q ON q.run = p.run AND q.frame = p.frame" for a, b in _COMBOS)}),
fit AS (SELECT run, a, b, avg(ax) AS max_, avg(ay) AS may, avg(bx) AS mbx, avg(by_) AS mby,
  atan2(covar_pop(ax, by_) - covar_pop(ay, bx), covar_pop(ax, bx) + covar_pop(ay, by_)) AS g FROM both_ GROUP BY run, a, b),
dev AS (SELECT run, a, b, sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS raw,
  sqrt(pow(cos(g) * (ax - max_) - sin(g) * (ay - may) + mbx - bx, 2) + pow(sin(g) * (ax - max_) + cos(g) * (ay - may) + mby - by_, 2)) AS inner_
  FROM both_ JOIN fit USING (run, a, b))
SELECT run, a, b, {r('avg(raw)', 'raw_mean')}, {r('max(raw)', 'raw_max')}, {r('avg(inner_)', 'internal_mean')},
       {r('max(inner_)', 'internal_max')}
FROM dev GROUP BY run, a, b""")
def gauge_rigid(spark, sf_dir):
    out = rigid_deviation(_estimates(spark, sf_dir))
    return out.select("run", "a", "b", *[shown(F.col(c)).alias(c) for c in ("raw_mean", "raw_max", "internal_mean", "internal_max")])


def _gap_sql(gap: int, a: str, b: str) -> str:
    def motion(e):
        return (f"SELECT p.run, p.frame, cos(p.theta) * (q.x - p.x) + sin(p.theta) * (q.y - p.y) AS dx, "
                f"-sin(p.theta) * (q.x - p.x) + cos(p.theta) * (q.y - p.y) AS dy FROM est_{e} p "
                f"JOIN est_{e} q ON q.run = p.run AND q.frame = p.frame + {gap}")

    return (f"SELECT CAST({gap} AS INTEGER) AS gap, sqrt(pow(m.dx - n.dx, 2) + pow(m.dy - n.dy, 2)) AS d FROM ({motion(a)}) m "
            f"JOIN ({motion(b)}) n ON n.run = m.run AND n.frame = m.frame")


@query("gauge_gaps", f"""WITH {_THREE}, pooled AS ({' UNION ALL '.join(_gap_sql(g, a, b) for g in (1, 5) for a, b in _COMBOS)})
SELECT gap, count(*) AS n, {r('avg(d)', 'mean')}, {r('quantile_cont(d, 0.95)', 'p95')}, {r('max(d)', 'max')} FROM pooled GROUP BY gap""")
def gauge_gaps(spark, sf_dir):
    out = gap_deviation(_estimates(spark, sf_dir), [1, 5])
    return out.select("gap", "n", *[shown(F.col(c)).alias(c) for c in ("mean", "p95", "max")])


def _member_sql(name: str) -> str:
    return (f"SELECT p.run, '{name}' AS member, quantile_cont(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 0.5) AS score "
            f"FROM poses p JOIN est_{name} q ON q.run = p.run AND q.frame = p.frame GROUP BY p.run")


@query("ensemble_summary", f"""WITH {_THREE}, {integrated('poses', 'dtheta * CAST(1.01 AS DOUBLE)')},
scores AS ({' UNION ALL '.join(_member_sql(n) for n in SCALES)}),
best AS (SELECT run, min(score) AS best FROM scores GROUP BY run)
SELECT run, {r('any_value(best)', 'best')}, {r('quantile_cont(score, 0.5)', 'median')}, {r('max(score)', 'worst')},
       {r('max(score) - any_value(best)', 'spread')}, count(*) FILTER (WHERE score > 2.5 * best) AS diverged, count(*) AS n
FROM scores JOIN best USING (run) GROUP BY run""")
def ensemble_summary(spark, sf_dir):
    from poseweave.operators.ordered import quantiles

    base = pin(T.drifted(spark, sf_dir, 1.01), "base").toDF("run", "frame", "scan", "bx", "by", "bt")
    scores = None
    for name, estimate in _estimates(spark, sf_dir).items():
        apart = estimate.join(base, ["run", "frame"]).select(
            "run", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")).alias("d"))
        member = quantiles(apart, ["run"], "d", {"score": 0.5}).withColumn("member", F.lit(name))
        scores = member if scores is None else scores.unionByName(member)
    out = summarise_ensemble(pin(scores, "scores"), ["run"], "score", 2.5)
    return out.select("run", *[shown(F.col(c)).alias(c) for c in ("best", "median", "worst", "spread")], "diverged", "n")


THIN_SQL = """kept AS (
  SELECT run, frame, x, y, theta, frame AS last, x AS lx, y AS ly, theta AS lt FROM {source} WHERE frame = 0
  UNION ALL
  SELECT p.run, p.frame, p.x, p.y, p.theta,
         CASE WHEN moved THEN p.frame ELSE last END, CASE WHEN moved THEN p.x ELSE lx END,
         CASE WHEN moved THEN p.y ELSE ly END, CASE WHEN moved THEN p.theta ELSE lt END
  FROM (SELECT q.run, q.frame, q.x, q.y, q.theta, k.last, k.lx, k.ly, k.lt,
               sqrt(pow(q.x - k.lx, 2) + pow(q.y - k.ly, 2)) >= {travel} OR abs(atan2(sin(q.theta - k.lt), cos(q.theta - k.lt))) >= {turn} AS moved
        FROM kept k JOIN {source} q ON q.run = k.run AND q.frame = k.frame + 1) p)"""


@query("thinned_frames", f"""WITH RECURSIVE {POSES}, {THIN_SQL.format(source='poses', travel=2.03, turn=0.2512)}
SELECT run, frame FROM kept WHERE frame = last""")
def thinned_frames(spark, sf_dir):
    return decimate(T.poses(spark, sf_dir), 2.03, 0.2512)
