"""Queries over the least-squares problem: specs, residual rows, cost, normal equations, refinement."""

from pyspark.sql import functions as F

from poseweave.functions.linalg import shown
from poseweave.operators.gridmap import auto_grid, init_from_scans
from poseweave.operators.ordered import number_rows
from poseweave.operators.residuals import (Hallucination, Normals, ProblemOptions, active_nodes, build_problem, cost,
                                           evaluate_eikonal, evaluate_links, evaluate_points, normal_equations,
                                           place_specs, point_specs)
from poseweave.operators.trajectory import odometry
from poseweave.plans import tables as T
from poseweave.plans.catalog import query
from poseweave.plans.queries_grid import GRIDS, MARGIN, NORMALS, NX, NY, OWNER, SLOPES, surface_inputs
from poseweave.plans.solve import SolverOptions, damped, solve, solve_step
from poseweave.plans.sqltext import MOTIONS, NODES, SCANS, integrated, materialized, r
from poseweave.session import pin

OPTIONS = ProblemOptions(hallucination=Hallucination(2, 0.1, True), normals=Normals("weighted", 6, False, 0.2),
                         huber_delta=0.5)
POINT_COLUMNS = ["r", "d_00", "d_10", "d_01", "d_11", "d_x", "d_y", "d_theta"]


def problem(spark, sf_dir, options=OPTIONS, frozen=False):
    """The problem of every run: measured motions come from the drifted estimate."""
    world, trajectory, grid, blank, tree, owners = surface_inputs(spark, sf_dir, options.normals.k_neighbors)
    nodes = pin(init_from_scans(blank, owners, ["run"]), "nodes")
    points = world.select("run", "frame", "idx", "sx", "sy")
    measured = odometry(T.drifted(spark, sf_dir), ["run"])
    made = build_problem(points, nodes, trajectory, measured, grid, options, frozen=frozen, surface=(tree, owners))
    return made, nodes, trajectory


_BASE = MOTIONS + ",\n" + integrated("poses") + ",\n" + integrated("drift", "dtheta * CAST(1.02 AS DOUBLE)") + ",\n" + SCANS
_WORLD = _BASE + """,
world AS (
  SELECT p.run, p.frame, s.idx, s.sx, s.sy, p.x, p.y, p.theta,
         p.x + cos(p.theta) * s.sx - sin(p.theta) * s.sy AS gx,
         p.y + sin(p.theta) * s.sx + cos(p.theta) * s.sy AS gy
  FROM scans s JOIN poses p ON p.scan = s.scan)"""
_SPECS = """specs AS (
  SELECT run, frame, idx * 3 AS row, sx, sy, CAST(0 AS DOUBLE) AS delta FROM world
  UNION ALL
  SELECT run, frame, idx * 3 + CASE side WHEN 1 THEN 1 ELSE 2 END,
         sx - sx / len * (side * CAST(0.1 AS DOUBLE)), sy - sy / len * (side * CAST(0.1 AS DOUBLE)), side * CAST(0.1 AS DOUBLE)
  FROM (SELECT *, sqrt(sx * sx + sy * sy) AS len FROM world), (SELECT unnest([1, -1]) AS side) WHERE len >= 1e-9)"""
_PLACED = """placed AS (
  SELECT s.*, p.theta, g.nx, g.ny, g.dx, g.dy,
         (p.x + cos(p.theta) * sx - sin(p.theta) * sy - g.min_x) / g.dx AS fx,
         (p.y + sin(p.theta) * sx + cos(p.theta) * sy - g.min_y) / g.dy AS fy
  FROM specs s JOIN {poses} p ON p.run = s.run AND p.frame = s.frame JOIN grids g ON g.run = s.run),
cells AS (
  SELECT *, fx BETWEEN 0 AND nx - 1 AND fy BETWEEN 0 AND ny - 1 AS valid,
         greatest(0, least(floor(fx), nx - 2)) AS w, greatest(0, least(floor(fy), ny - 2)) AS h FROM placed)"""


@query("problem_specs", f"""WITH {_WORLD}, {_SPECS}
SELECT run, frame, row, {r('sx', 'sx')}, {r('sy', 'sy')}, {r('delta', 'delta')} FROM specs""")
def problem_specs(spark, sf_dir):
    specs = point_specs(T.frame_scans(spark, sf_dir), OPTIONS)
    return specs.select("run", "frame", "row", *[shown(F.col(c)).alias(c) for c in ("sx", "sy", "delta")])


@query("active_nodes", f"""WITH {_WORLD}, {GRIDS}, {_SPECS}, {_PLACED.format(poses='poses')},
touched AS (SELECT DISTINCT run, nx, ny, w, h FROM cells WHERE valid),
grown AS (SELECT DISTINCT run, CAST((h + b) * nx + w + a AS BIGINT) AS node
  FROM touched, (SELECT range - 1 AS a FROM range(4)), (SELECT range - 1 AS b FROM range(4))
  WHERE w + a BETWEEN 0 AND nx - 1 AND h + b BETWEEN 0 AND ny - 1)
SELECT run, node, row_number() OVER (PARTITION BY run ORDER BY node) - 1 AS position FROM grown""")
def active(spark, sf_dir):
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    world = pin(T.to_world(T.scans(spark, sf_dir), trajectory, ["scan"]).select("run", "frame", "idx", "sx", "sy", "gx", "gy"), "world")
    grid = auto_grid(world, trajectory, ["run"], NX, NY, MARGIN)
    placed = place_specs(point_specs(world.select("run", "frame", "idx", "sx", "sy"), OPTIONS), trajectory, grid)
    return number_rows(active_nodes(placed, 1), ["run"], ["node"], "position")


_CORNERS = """ FROM cells c LEFT JOIN slopes n00 ON n00.run = c.run AND n00.w = c.w AND n00.h = c.h
  LEFT JOIN slopes n10 ON n10.run = c.run AND n10.w = c.w + 1 AND n10.h = c.h
  LEFT JOIN slopes n01 ON n01.run = c.run AND n01.w = c.w AND n01.h = c.h + 1
  LEFT JOIN slopes n11 ON n11.run = c.run AND n11.w = c.w + 1 AND n11.h = c.h + 1"""
_MIX = "((1-a)*(1-b)*{0}00 + a*(1-b)*{0}10 + (1-a)*b*{0}01 + a*b*{0}11)"
_POINT_ROWS = f"""corners AS (
  SELECT c.*, fx - c.w AS a, fy - c.h AS b,
         {', '.join(f'n{t}.{col} AS {name}{t}' for t in ('00', '10', '01', '11')
                    for col, name in (('value', 'v'), ('sx', 'gx'), ('sy', 'gy')))}
  {_CORNERS}),
raw AS (
  SELECT *, CASE WHEN valid THEN {_MIX.format('v')} ELSE CAST(0 AS DOUBLE) END - delta AS r0,
         {_MIX.format('gx')} AS slope_x, {_MIX.format('gy')} AS slope_y FROM corners),
robust AS (SELECT *, CASE WHEN abs(r0) > 0.5 THEN sqrt(CAST(0.5 AS DOUBLE) / abs(r0)) ELSE CAST(1 AS DOUBLE) END AS s FROM raw),
point_rows AS (
  SELECT run, frame, row, valid, w, h, nx, r0, s * r0 AS r, s * (1-a)*(1-b) AS d_00, s * a*(1-b) AS d_10,
         s * (1-a)*b AS d_01, s * a*b AS d_11, s * slope_x AS d_x, s * slope_y AS d_y,
         s * (slope_x * (-sin(theta) * sx - cos(theta) * sy) + slope_y * (cos(theta) * sx - sin(theta) * sy)) AS d_theta
  FROM robust)"""
_PROBLEM = f"{_WORLD}, {GRIDS}, {NODES}, {SLOPES}, {_SPECS}, {_PLACED.format(poses='poses')}, {_POINT_ROWS}"


@query("point_residuals", f"""WITH {_PROBLEM}
SELECT run, frame, row, {', '.join(r(c, c) for c in POINT_COLUMNS)} FROM point_rows WHERE valid""")
def point_residuals(spark, sf_dir):
    p, nodes, trajectory = problem(spark, sf_dir)
    rows = evaluate_points(p, nodes, trajectory).where("valid")
    return rows.select("run", "frame", "row", *[shown(F.col(c)).alias(c) for c in POINT_COLUMNS])


# Frozen mode: the cell is chosen at the initial poses, alpha and beta follow the other estimate.
_FROZEN = f"""{_WORLD}, {GRIDS}, {NODES}, {_SPECS}, {_PLACED.format(poses='poses')},
moved AS (
  SELECT c.run, c.frame, c.row, c.sx, c.sy, c.delta, c.w, c.h, c.dx, c.dy, p.theta,
         (p.x + cos(p.theta) * sx - sin(p.theta) * sy - (g.min_x + c.w * c.dx)) / c.dx AS a,
         (p.y + sin(p.theta) * sx + cos(p.theta) * sy - (g.min_y + c.h * c.dy)) / c.dy AS b
  FROM cells c JOIN drift p ON p.run = c.run AND p.frame = c.frame JOIN grids g ON g.run = c.run WHERE c.valid),
vals AS (
  SELECT m.*, n00.value AS v00, n10.value AS v10, n01.value AS v01, n11.value AS v11 FROM moved m
  JOIN nodes n00 ON n00.run = m.run AND n00.w = m.w AND n00.h = m.h
  JOIN nodes n10 ON n10.run = m.run AND n10.w = m.w + 1 AND n10.h = m.h
  JOIN nodes n01 ON n01.run = m.run AND n01.w = m.w AND n01.h = m.h + 1
  JOIN nodes n11 ON n11.run = m.run AND n11.w = m.w + 1 AND n11.h = m.h + 1),
raw AS (SELECT *, {_MIX.format('v')} - delta AS r0, ((1-b)*(v10-v00) + b*(v11-v01)) / dx AS slope_x,
               ((1-a)*(v01-v00) + a*(v11-v10)) / dy AS slope_y FROM vals),
frozen AS (
  SELECT run, frame, row, s * r0 AS r, s * (1-a)*(1-b) AS d_00, s * a*(1-b) AS d_10, s * (1-a)*b AS d_01, s * a*b AS d_11,
         s * slope_x AS d_x, s * slope_y AS d_y,
         s * (slope_x * (-sin(theta) * sx - cos(theta) * sy) + slope_y * (cos(theta) * sx - sin(theta) * sy)) AS d_theta
  FROM (SELECT *, CASE WHEN abs(r0) > 0.5 THEN sqrt(CAST(0.5 AS DOUBLE) / abs(r0)) ELSE CAST(1 AS DOUBLE) END AS s FROM raw))"""


@query("frozen_residuals", materialized(f"""WITH {_FROZEN}
SELECT run, frame, row, {', '.join(r(c, c) for c in POINT_COLUMNS)} FROM frozen"""))
def frozen_residuals(spark, sf_dir):
    p, nodes, _ = problem(spark, sf_dir, frozen=True)
    rows = evaluate_points(p, nodes, T.drifted(spark, sf_dir))
    return rows.select("run", "frame", "row", *[shown(F.col(c)).alias(c) for c in POINT_COLUMNS])


_EIKONAL = f"""{NORMALS}, {OWNER},
eik AS (
  SELECT n.run, n.w, n.h, g.nx, sqrt(1 - o.corner) AS sw, o.normal_x / g.dx AS ax, o.normal_y / g.dy AS ay,
         n.value AS v00, e.value AS v10, u.value AS v01
  FROM nodes n JOIN grids g USING (run) JOIN owner o ON o.run = n.run AND o.node = n.node
  JOIN nodes e ON e.run = n.run AND e.h = n.h AND e.w = n.w + 1
  JOIN nodes u ON u.run = n.run AND u.w = n.w AND u.h = n.h + 1
  WHERE n.w < g.nx - 1 AND n.h < g.ny - 1 AND 1 - o.corner > 0),
eik_rows AS (SELECT run, w, h, nx, sw * (1 - (ax * (v10 - v00) + ay * (v01 - v00))) AS r,
                    sw * (ax + ay) AS d_00, -sw * ax AS d_10, -sw * ay AS d_01 FROM eik)"""


@query("eikonal_residuals", materialized(f"""WITH {_WORLD}, {GRIDS}, {NODES}, {_EIKONAL}
SELECT run, CAST(w AS BIGINT) AS cw, CAST(h AS BIGINT) AS ch, {', '.join(r(c, c) for c in ('r', 'd_00', 'd_10', 'd_01'))}
FROM eik_rows"""))
def eikonal_residuals(spark, sf_dir):
    p, nodes, _ = problem(spark, sf_dir)
    return evaluate_eikonal(p, nodes).select(
        "run", "cw", "ch", *[shown(F.col(c)).alias(c) for c in ("r", "d_00", "d_10", "d_01")])


_LINKS = """link AS (
  SELECT p.run, p.frame AS i, q.frame AS j, cos(p.theta) AS c, sin(p.theta) AS s,
         cos(p.theta) * (q.x - p.x) + sin(p.theta) * (q.y - p.y) AS rx,
         -sin(p.theta) * (q.x - p.x) + cos(p.theta) * (q.y - p.y) AS ry, q.theta - p.theta AS rt,
         cos(a.theta) * (b.x - a.x) + sin(a.theta) * (b.y - a.y) AS mx,
         -sin(a.theta) * (b.x - a.x) + cos(a.theta) * (b.y - a.y) AS my,
         atan2(sin(b.theta - a.theta), cos(b.theta - a.theta)) AS mt
  FROM poses p JOIN poses q ON q.run = p.run AND q.frame = p.frame + 1
  JOIN drift a ON a.run = p.run AND a.frame = p.frame JOIN drift b ON b.run = p.run AND b.frame = p.frame + 1),
link_rows AS (SELECT *, rx - mx AS r_x, ry - my AS r_y, atan2(sin(rt - mt), cos(rt - mt)) AS r_theta FROM link)"""


@query("link_residuals", f"""WITH {_WORLD}, {_LINKS}
SELECT run, i, j, {', '.join(r(c, c) for c in ('r_x', 'r_y', 'r_theta'))}, {r('rx', 'rel_x')}, {r('ry', 'rel_y')}
FROM link_rows""")
def link_residuals(spark, sf_dir):
    from poseweave.operators.residuals import Problem, link_specs

    trajectory = T.poses(spark, sf_dir)
    measured = odometry(T.drifted(spark, sf_dir), ["run"])
    links = link_specs(measured, None, trajectory, OPTIONS.weights)
    rows = evaluate_links(Problem(None, None, links, None, None, OPTIONS, False), trajectory)
    return rows.select("run", "i", "j", *[shown(F.col(c)).alias(c) for c in ("r_x", "r_y", "r_theta", "rel_x", "rel_y")])


@query("problem_cost", f"""WITH {_PROBLEM}, {_EIKONAL}, {_LINKS}, parts AS (
  SELECT run, CASE WHEN abs(r0) > 0.5 THEN 0.5 * (2 * abs(r0) - 0.5) ELSE r0 * r0 END AS c FROM point_rows
  UNION ALL SELECT run, r * r FROM eik_rows
  UNION ALL SELECT run, r_x * r_x + r_y * r_y + r_theta * r_theta FROM link_rows)
SELECT run, {r('sum(c)', 'cost')} FROM parts GROUP BY run""")
def problem_cost(spark, sf_dir):
    p, nodes, trajectory = problem(spark, sf_dir)
    return cost(p, nodes, trajectory).withColumn("cost", shown(F.col("cost")))


def _jacobian_sql() -> str:
    """Every derivative as (run, kind, a, b, col, val) where (kind, a, b) names the residual row."""
    node = "CAST((h + {b}) * nx + w + {a} AS BIGINT)"
    cells = [("00", 0, 0), ("10", 1, 0), ("01", 0, 1), ("11", 1, 1)]
    parts = [f"SELECT run, 0 AS kind, frame AS k1, row AS k2, {node.format(a=a, b=b)} AS col, d_{t} AS val, r FROM point_rows WHERE valid"
             for t, a, b in cells]
    parts += [f"SELECT run, 0, frame, row, -3 * frame - {n + 1}, d_{p}, r FROM point_rows WHERE valid AND frame > 0"
              for n, p in enumerate(("x", "y", "theta"))]
    parts += [f"SELECT run, 1, CAST(h AS BIGINT), CAST(w AS BIGINT), {node.format(a=a, b=b)}, d_{t}, r FROM eik_rows"
              for t, a, b in cells[:3]]
    rows = {"r_x": ["-c", "-s", "ry", "c", "s", None], "r_y": ["s", "-c", "-rx", "-s", "c", None],
            "r_theta": [None, None, "CAST(-1 AS DOUBLE)", None, None, "CAST(1 AS DOUBLE)"]}
    for kind, (name, entries) in enumerate(rows.items()):
        for n, value in enumerate(entries):
            if value:
                end = "ij"[n // 3]
                parts.append(f"SELECT run, {kind + 2}, i, j, -3 * {end} - {n % 3 + 1}, {value}, {name} FROM link_rows WHERE {end} > 0")
    return "jac AS (" + "\n  UNION ALL ".join(parts) + ")"


_NORMAL_SQL = f"WITH {_PROBLEM}, {_EIKONAL}, {_LINKS}, {_jacobian_sql()}"


@query("normal_matrix", f"""{_NORMAL_SQL}
SELECT a.run, a.col AS i, b.col AS j, {r('sum(a.val * b.val)', 'v')}
FROM jac a JOIN jac b ON b.run = a.run AND b.kind = a.kind AND b.k1 = a.k1 AND b.k2 = a.k2 AND b.col >= a.col
GROUP BY a.run, a.col, b.col""")
def normal_matrix(spark, sf_dir):
    p, nodes, trajectory = problem(spark, sf_dir)
    return normal_equations(p, nodes, trajectory).where("j IS NOT NULL").withColumn("v", shown(F.col("v")))


@query("gradient_vector", f"""{_NORMAL_SQL}
SELECT run, col, {r('sum(-val * r)', 'v')} FROM jac GROUP BY run, col""")
def gradient_vector(spark, sf_dir):
    p, nodes, trajectory = problem(spark, sf_dir)
    rows = normal_equations(p, nodes, trajectory).where("j IS NULL")
    return rows.select("run", F.col("i").alias("col"), shown(F.col("v")).alias("v"))


@query("solved_step", f"""{_NORMAL_SQL}
SELECT run, col, {r('sum(-val * r)', 'v')} FROM jac GROUP BY run, col""")
def solved_step(spark, sf_dir):
    """The damped system applied to its solution, which must give the right-hand side back."""
    p, nodes, trajectory = problem(spark, sf_dir)
    entries = pin(normal_equations(p, nodes, trajectory), "entries")
    control = entries.select("run", F.lit(1.0).alias("lam")).distinct()
    step = solve_step(entries, control, SolverOptions(), nodes, trajectory)
    upper = damped(entries, control, False).where("j IS NOT NULL")
    both = upper.unionByName(upper.where("i <> j").select("run", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    back = both.join(step.select("run", F.col("col").alias("j"), "delta"), ["run", "j"]).groupBy("run", F.col("i").alias("col")).agg(
        F.sum(F.col("v") * F.col("delta")).alias("v"))
    return back.withColumn("v", shown(F.col("v")))


@query("map_and_pose_refinement")
def map_and_pose_refinement(spark, sf_dir):
    """Every run's joint map and pose problem, to convergence or the solver's own limit of iterations."""
    p, nodes, trajectory = problem(spark, sf_dir)
    _, _, control = solve(p, nodes, trajectory, SolverOptions(trust_region=True))
    return control.select("run", "iterations", "converged", "initial_cost", "final_cost", "cost_history")
