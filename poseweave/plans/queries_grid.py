"""Grid-map, neighbour and surface-normal queries."""

from pyspark.sql import functions as F

from poseweave.functions.linalg import shown
from poseweave.operators import gridmap as G
from poseweave.operators.neighbors import PACKED_POINTS, build_tree, nearest
from poseweave.operators.normals import node_normals, scan_normals
from poseweave.plans import tables as T
from poseweave.plans.catalog import query
from poseweave.plans.sqltext import NODES, SCANS, WORLD, grids, materialized, r
from poseweave.session import pin

NX, NY, MARGIN = 21, 17, 5.0
GRIDS = grids(NX, NY, MARGIN)
RUN = ["run"]


def map_inputs(spark, sf_dir):
    """World points, poses and one auto-sized grid per run."""
    world = T.world(spark, sf_dir)
    trajectory = T.poses(spark, sf_dir)
    return world, trajectory, G.auto_grid(world, trajectory, RUN, NX, NY, MARGIN)


def surface_inputs(spark, sf_dir, k=1):
    """World points, poses, grids, blank nodes, the point tree and the owner of every node."""
    trajectory = pin(T.poses(spark, sf_dir), "poses")
    world = pin(T.to_world(T.scans(spark, sf_dir), trajectory, ["scan"]).drop("scan"), "world")
    grid = pin(G.auto_grid(world, trajectory, RUN, NX, NY, MARGIN), "grids")
    blank = G.grid_nodes(grid, RUN)
    tree = G.surface_tree(world, RUN, ["frame", "idx"], k)
    return world, trajectory, grid, blank, tree, G.node_owners(blank, tree, RUN, ["frame", "idx"])


def initial_map(spark, sf_dir):
    world, trajectory, grid, blank, _, owners = surface_inputs(spark, sf_dir)
    return world, trajectory, grid, pin(G.init_from_scans(blank, owners, RUN), "nodes")


@query("domain_bounds", f"""WITH {WORLD}, {GRIDS}
SELECT run, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, {r('min_x', 'min_x')}, {r('min_y', 'min_y')},
       {r('dx', 'dx')}, {r('dy', 'dy')} FROM grids""")
def domain_bounds(spark, sf_dir):
    _, _, grid = map_inputs(spark, sf_dir)
    return grid.select("run", "nx", "ny", *[shown(F.col(c)).alias(c) for c in ("min_x", "min_y", "dx", "dy")])


@query("map_nodes", f"""WITH {WORLD}, {GRIDS}
SELECT run, CAST(node AS BIGINT) AS node, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, {r('x', 'x')}, {r('y', 'y')}
FROM blank""")
def map_nodes(spark, sf_dir):
    _, _, grid = map_inputs(spark, sf_dir)
    return G.grid_nodes(grid, RUN).select("run", "node", "w", "h", shown(F.col("x")).alias("x"),
                                          shown(F.col("y")).alias("y"))


# A fixed window that does not cover everything, so that some points fall outside.
WINDOW_SQL = "(gx BETWEEN -30 AND 60 AND gy BETWEEN -40 AND 40)"


@query("out_of_domain", f"""WITH {WORLD}
SELECT run, count(*) FILTER (WHERE NOT {WINDOW_SQL}) AS outside, count(*) AS total,
       {r(f'100.0 * count(*) FILTER (WHERE NOT {WINDOW_SQL}) / count(*)', 'percent')}
FROM world GROUP BY run""")
def out_of_domain(spark, sf_dir):
    world = T.world(spark, sf_dir)
    window = world.select("run").distinct().select(
        "run", F.lit(31).alias("nx"), F.lit(33).alias("ny"), F.lit(-30.0).alias("min_x"), F.lit(-40.0).alias("min_y"),
        F.lit(3.0).alias("dx"), F.lit(2.5).alias("dy"))
    return G.outside_share(world, window, RUN).withColumn("percent", shown(F.col("percent")))


@query("hallucinated_points", f"""WITH {SCANS}, b AS (SELECT *, sqrt(sx * sx + sy * sy) AS len FROM scans)
SELECT scan, idx, j, side, {r('sx - sx / len * (side * j * 0.1)', 'sx')}, {r('sy - sy / len * (side * j * 0.1)', 'sy')},
       {r('side * j * 0.1', 'delta')}
FROM b, (SELECT range + 1 AS j FROM range(2)), (SELECT unnest([1, -1]) AS side) WHERE len >= 1e-9""")
def hallucinated_points(spark, sf_dir):
    rows = G.hallucinate(T.scans(spark, sf_dir), 5, 0.1, both=True)
    return rows.select("scan", "idx", "j", "side", *[shown(F.col(c)).alias(c) for c in ("sx", "sy", "delta")])


@query("located_cells", f"""WITH {WORLD}, {GRIDS}, f AS (
  SELECT run, frame, idx, nx, ny, (gx - min_x) / dx AS fx, (gy - min_y) / dy AS fy FROM world JOIN grids USING (run)),
c AS (SELECT *, least(floor(fx), nx - 2) AS w, least(floor(fy), ny - 2) AS h FROM f
      WHERE fx BETWEEN 0 AND nx - 1 AND fy BETWEEN 0 AND ny - 1)
SELECT run, frame, idx, CAST(w AS BIGINT) AS cw, CAST(h AS BIGINT) AS ch, {r('fx - w', 'alpha')}, {r('fy - h', 'beta')}
FROM c""")
def located_cells(spark, sf_dir):
    world, _, grid = map_inputs(spark, sf_dir)
    cells = G.attach_cells(world.join(grid, "run")).where("inside")
    return cells.select("run", "frame", "idx", "cw", "ch", shown(F.col("alpha")).alias("alpha"),
                        shown(F.col("beta")).alias("beta"))


@query("clamped_cells", f"""WITH {WORLD}, f AS (
  SELECT run, frame, idx, (gx - 0) / 2 AS fx, (gy + 5) / CAST(2.5 AS DOUBLE) AS fy FROM world),
c AS (SELECT *, greatest(0, least(floor(fx), 9)) AS w, greatest(0, least(floor(fy), 7)) AS h FROM f)
SELECT run, frame, idx, CAST(w AS BIGINT) AS cw, CAST(h AS BIGINT) AS ch, {r('fx - w', 'alpha')}, {r('fy - h', 'beta')}
FROM c""")
def clamped_cells(spark, sf_dir):
    from poseweave.functions.grid import fixed_grid, with_grid

    small = with_grid(T.world(spark, sf_dir), fixed_grid(11, 9, (0.0, -5.0), (20.0, 15.0)))
    return G.attach_cells(small).select("run", "frame", "idx", "cw", "ch", shown(F.col("alpha")).alias("alpha"),
                                        shown(F.col("beta")).alias("beta"))


@query("map_from_scans", f"""WITH {WORLD}, {GRIDS}, {NODES}
SELECT run, CAST(node AS BIGINT) AS node, {r('value', 'value')} FROM nodes""")
def map_from_scans(spark, sf_dir):
    _, _, _, nodes = initial_map(spark, sf_dir)
    return nodes.select("run", "node", shown(F.col("value")).alias("value"))


SLOPES = """slopes AS (
  SELECT n.run, n.node, n.w, n.h, n.value,
         (coalesce(e.value, n.value) - coalesce(o.value, n.value))
           / ((CASE WHEN e.node IS NULL THEN 0 ELSE 1 END + CASE WHEN o.node IS NULL THEN 0 ELSE 1 END) * g.dx) AS sx,
         (coalesce(u.value, n.value) - coalesce(d.value, n.value))
           / ((CASE WHEN u.node IS NULL THEN 0 ELSE 1 END + CASE WHEN d.node IS NULL THEN 0 ELSE 1 END) * g.dy) AS sy
  FROM nodes n JOIN grids g USING (run)
  LEFT JOIN nodes e ON e.run = n.run AND e.h = n.h AND e.w = n.w + 1
  LEFT JOIN nodes o ON o.run = n.run AND o.h = n.h AND o.w = n.w - 1
  LEFT JOIN nodes u ON u.run = n.run AND u.w = n.w AND u.h = n.h + 1
  LEFT JOIN nodes d ON d.run = n.run AND d.w = n.w AND d.h = n.h - 1)"""
LOCATED = """located AS (
  SELECT run, frame, idx, gx, gy, nx, dx, dy, w, h, fx - w AS a, fy - h AS b FROM (
    SELECT *, least(floor(fx), nx - 2) AS w, least(floor(fy), ny - 2) AS h FROM (
      SELECT run, frame, idx, gx, gy, nx, ny, dx, dy, (gx - min_x) / dx AS fx, (gy - min_y) / dy AS fy
      FROM world JOIN grids USING (run)) WHERE fx BETWEEN 0 AND nx - 1 AND fy BETWEEN 0 AND ny - 1))"""


@query("map_samples", f"""WITH {WORLD}, {GRIDS}, {NODES}, {SLOPES}, {LOCATED}
SELECT l.run, l.frame, l.idx,
  {r('(1-a)*(1-b)*p.value + a*(1-b)*q.value + (1-a)*b*s.value + a*b*t.value', 'sdf')},
  {r('((1-b)*(q.value - p.value) + b*(t.value - s.value)) / l.dx', 'exact_gx')},
  {r('((1-a)*(s.value - p.value) + a*(t.value - q.value)) / l.dy', 'exact_gy')},
  {r('(1-a)*(1-b)*p.sx + a*(1-b)*q.sx + (1-a)*b*s.sx + a*b*t.sx', 'smooth_gx')},
  {r('(1-a)*(1-b)*p.sy + a*(1-b)*q.sy + (1-a)*b*s.sy + a*b*t.sy', 'smooth_gy')}
FROM located l JOIN slopes p ON p.run = l.run AND p.w = l.w AND p.h = l.h
JOIN slopes q ON q.run = l.run AND q.w = l.w + 1 AND q.h = l.h
JOIN slopes s ON s.run = l.run AND s.w = l.w AND s.h = l.h + 1
JOIN slopes t ON t.run = l.run AND t.w = l.w + 1 AND t.h = l.h + 1""")
def map_samples(spark, sf_dir):
    world, _, grid, nodes = initial_map(spark, sf_dir)
    out = G.sample(world, nodes, grid, RUN)
    return out.select("run", "frame", "idx", *[shown(F.col(c)).alias(c) for c in (
        "sdf", "exact_gx", "exact_gy", "smooth_gx", "smooth_gy")])


@query("probe_gradients", f"""WITH {WORLD}, {GRIDS}, {NODES},
probe AS (
  SELECT run, frame, idx, da, db, nx, fx - w AS a, fy - h AS b, w, h FROM (
    SELECT *, greatest(0, least(floor(fx), nx - 2)) AS w, greatest(0, least(floor(fy), ny - 2)) AS h FROM (
      SELECT run, frame, idx, da, db, nx, ny, (gx + da * 0.5 - min_x) / dx AS fx, (gy + db * 0.5 - min_y) / dy AS fy
      FROM world JOIN grids USING (run),
           (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) arms(da, db)))),
val AS (
  SELECT l.run, l.frame, l.idx, da, db,
         (1-a)*(1-b)*p.value + a*(1-b)*q.value + (1-a)*b*s.value + a*b*t.value AS v
  FROM probe l JOIN nodes p ON p.run = l.run AND p.w = l.w AND p.h = l.h
  JOIN nodes q ON q.run = l.run AND q.w = l.w + 1 AND q.h = l.h
  JOIN nodes s ON s.run = l.run AND s.w = l.w AND s.h = l.h + 1
  JOIN nodes t ON t.run = l.run AND t.w = l.w + 1 AND t.h = l.h + 1)
SELECT run, frame, idx, {r('sum(v * da)', 'probe_gx')}, {r('sum(v * db)', 'probe_gy')} FROM val GROUP BY run, frame, idx""")
def probe_gradients(spark, sf_dir):
    world, _, grid, nodes = initial_map(spark, sf_dir)
    out = G.probe_gradient(world, nodes, grid, RUN, ["run", "frame", "idx"], 0.5)
    return out.select("run", "frame", "idx", shown(F.col("probe_gx")).alias("probe_gx"),
                      shown(F.col("probe_gy")).alias("probe_gy"))


@query("map_upsampled", materialized(f"""WITH {WORLD}, {GRIDS}, {NODES},
px AS (SELECT run, nx, ny, col, row, least(col // 3, nx - 2) AS w, least(row // 3, ny - 2) AS h
       FROM grids, (SELECT range AS col FROM range({(NX - 1) * 3 + 1})), (SELECT range AS row FROM range({(NY - 1) * 3 + 1}))),
f AS (SELECT *, (col - 3 * w) / CAST(3 AS DOUBLE) AS a, (row - 3 * h) / CAST(3 AS DOUBLE) AS b FROM px)
SELECT l.run, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col,
       {r('(1-a)*(1-b)*p.value + a*(1-b)*q.value + (1-a)*b*s.value + a*b*t.value', 'value')}
FROM f l JOIN nodes p ON p.run = l.run AND p.w = l.w AND p.h = l.h
JOIN nodes q ON q.run = l.run AND q.w = l.w + 1 AND q.h = l.h
JOIN nodes s ON s.run = l.run AND s.w = l.w AND s.h = l.h + 1
JOIN nodes t ON t.run = l.run AND t.w = l.w + 1 AND t.h = l.h + 1"""))
def map_upsampled(spark, sf_dir):
    _, _, grid, nodes = initial_map(spark, sf_dir)
    return G.upsample(nodes, grid, RUN, 3).withColumn("value", shown(F.col("value")))


@query("zoom_box", f"""WITH {WORLD}, {GRIDS}, {NODES},
flat AS (SELECT *, CASE WHEN abs(value) > 10 THEN 0 ELSE round(value, 3) END AS v FROM nodes),
freq AS (SELECT run, v, count(*) AS c FROM flat GROUP BY run, v),
modal AS (SELECT run, v AS m FROM freq QUALIFY row_number() OVER (PARTITION BY run ORDER BY c DESC, v) = 1),
changed AS (SELECT f.run, f.x, f.y FROM flat f JOIN modal USING (run) WHERE v <> m),
rows AS (SELECT * FROM changed UNION ALL SELECT run, x, y FROM poses WHERE run IN (SELECT run FROM changed)),
box AS (SELECT run, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM rows GROUP BY run)
SELECT run, {r('greatest(lx - 2, min_x)', 'x0')}, {r('least(hx + 2, min_x + (nx - 1) * dx)', 'x1')},
       {r('greatest(ly - 2, min_y)', 'y0')}, {r('least(hy + 2, min_y + (ny - 1) * dy)', 'y1')}
FROM box JOIN grids USING (run)""")
def zoom_box(spark, sf_dir):
    _, trajectory, grid, nodes = initial_map(spark, sf_dir)
    # Far nodes are set to one background value, as an unobserved map would have.
    flat = nodes.withColumn("value", F.when(F.abs("value") > 10, F.lit(0.0)).otherwise(shown(F.col("value"), 3)))
    box = G.zoom_box(flat, grid, trajectory, RUN, 2.0)
    return box.select("run", *[shown(F.col(c)).alias(c) for c in ("x0", "x1", "y0", "y1")])


KNN = """near AS (
  SELECT q.run, q.frame, q.idx, q.gx, q.gy, q.x AS ox, q.y AS oy, p.frame AS n_frame, p.idx AS n_idx, p.gx AS n_x, p.gy AS n_y,
         (p.gx - q.gx) * (p.gx - q.gx) + (p.gy - q.gy) * (p.gy - q.gy) AS d2
  FROM world q JOIN world p ON p.run = q.run {extra}
  QUALIFY row_number() OVER (PARTITION BY q.run, q.frame, q.idx ORDER BY d2, p.frame, p.idx) <= {k})"""


@query("nearest_points", f"""WITH {WORLD}, {KNN.format(k=4, extra='')}
SELECT run, frame, idx, n_frame, n_idx, {r('sqrt(d2)', 'distance')} FROM near""")
def nearest_points(spark, sf_dir):
    points = T.world(spark, sf_dir).select("run", "frame", "idx", F.col("gx").alias("x"), F.col("gy").alias("y"))
    tree = build_tree(points, RUN, ["frame", "idx"], copies=4, packed_points=PACKED_POINTS)
    asking = tree if tree.whole else points
    found = nearest(asking, ["frame", "idx"], tree, 4, ["frame", "idx"], ["frame", "idx"])
    return found.select("run", "frame", "idx", "n_frame", "n_idx", shown(F.sqrt("d2")).alias("distance"))


def _normals_sql(x: str, y: str, towards: tuple[str, str]) -> str:
    return f"""sums AS (
  SELECT run, frame, idx, any_value({x}) AS px, any_value({y}) AS py, any_value({towards[0]}) AS ox,
         any_value({towards[1]}) AS oy, count(*) AS n,
         sum(n_x - {x}) AS u, sum(n_y - {y}) AS v, sum((n_x - {x}) * (n_x - {x})) AS uu,
         sum((n_x - {x}) * (n_y - {y})) AS uv, sum((n_y - {y}) * (n_y - {y})) AS vv
  FROM near GROUP BY run, frame, idx),
mom AS (SELECT *, uu - u * u / n AS cxx, uv - u * v / n AS cxy, vv - v * v / n AS cyy FROM sums),
eig AS (SELECT *, (cxx + cyy) / 2 AS mid, sqrt((cxx - cyy) / 2 * ((cxx - cyy) / 2) + cxy * cxy) AS spread,
               atan2(2 * cxy, cxx - cyy) / 2 AS phi FROM mom),
normals AS (SELECT run, frame, idx, px AS gx, py AS gy,
       -sin(phi) * sgn AS normal_x, cos(phi) * sgn AS normal_y,
       greatest(mid - spread, 0) / greatest(mid + spread, 1e-12) AS cornerness
  FROM (SELECT *, CASE WHEN -sin(phi) * (ox - px) + cos(phi) * (oy - py) < -1e-9 THEN -1 ELSE 1 END AS sgn FROM eig))"""


NORMALS = KNN.format(k=6, extra="") + ",\n" + _normals_sql("gx", "gy", ("ox", "oy"))
NORMAL_COLUMNS = ["normal_x", "normal_y", "cornerness"]


@query("scan_normals", f"""WITH {WORLD}, {NORMALS}
SELECT run, frame, idx, {', '.join(r(c, c) for c in NORMAL_COLUMNS)} FROM normals""")
def scan_normals_global(spark, sf_dir):
    out = scan_normals(T.world(spark, sf_dir), 6)
    return out.select("run", "frame", "idx", *[shown(F.col(c)).alias(c) for c in NORMAL_COLUMNS])


_LOCAL_NEAR = """near AS (
  SELECT q.run, q.frame, q.idx, q.sx, q.sy, CAST(0 AS DOUBLE) AS zx, CAST(0 AS DOUBLE) AS zy, p.sx AS n_x, p.sy AS n_y,
         (p.sx - q.sx) * (p.sx - q.sx) + (p.sy - q.sy) * (p.sy - q.sy) AS d2
  FROM world q JOIN world p ON p.run = q.run AND p.frame = q.frame
  QUALIFY row_number() OVER (PARTITION BY q.run, q.frame, q.idx ORDER BY d2, p.idx) <= 3)"""


@query("scan_normals_per_scan", f"""WITH {WORLD}, {_LOCAL_NEAR}, {_normals_sql('sx', 'sy', ('zx', 'zy'))}
SELECT w.run, w.frame, w.idx, {r('cos(w.theta) * normal_x - sin(w.theta) * normal_y', 'normal_x')},
       {r('sin(w.theta) * normal_x + cos(w.theta) * normal_y', 'normal_y')}, {r('cornerness', 'cornerness')}
FROM normals n JOIN world w ON w.run = n.run AND w.frame = n.frame AND w.idx = n.idx""")
def scan_normals_local(spark, sf_dir):
    out = scan_normals(T.world(spark, sf_dir), 3, per_scan=True)
    return out.select("run", "frame", "idx", *[shown(F.col(c)).alias(c) for c in NORMAL_COLUMNS])


OWNER = """owner AS (
  SELECT b.run, b.node, b.x, b.y, n.gx, n.gy, n.normal_x, n.normal_y,
         greatest(0, least(1, n.cornerness / CAST(0.2 AS DOUBLE))) AS corner
  FROM blank b JOIN normals n ON n.run = b.run
  QUALIFY row_number() OVER (PARTITION BY b.run, b.node ORDER BY
     (n.gx - b.x) * (n.gx - b.x) + (n.gy - b.y) * (n.gy - b.y), n.frame, n.idx) = 1)"""
_NODE = {
    "pca": ("owner2 AS (SELECT *, normal_x AS ax, normal_y AS ay FROM owner)", "1"),
    "weighted": ("owner2 AS (SELECT *, normal_x AS ax, normal_y AS ay FROM owner)", "1 - corner"),
    "hybrid": ("""cue AS (SELECT *, sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)) AS len,
         CASE WHEN (gx - x) * normal_x + (gy - y) * normal_y < 0 THEN -1 ELSE 1 END AS flip FROM owner),
  mix AS (SELECT *, (1 - corner) * normal_x + corner * flip / nullif(len, 0) * (gx - x) AS bx,
         (1 - corner) * normal_y + corner * flip / nullif(len, 0) * (gy - y) AS by_ FROM cue),
  owner2 AS (SELECT *, CASE WHEN len < 1e-9 OR sqrt(bx * bx + by_ * by_) <= 1e-9 THEN normal_x
                       ELSE bx / sqrt(bx * bx + by_ * by_) END AS ax,
         CASE WHEN len < 1e-9 OR sqrt(bx * bx + by_ * by_) <= 1e-9 THEN normal_y
              ELSE by_ / sqrt(bx * bx + by_ * by_) END AS ay FROM mix)""", "1"),
}


def _register_node_normals(method: str) -> None:
    cte, scale = _NODE[method]

    @query(f"node_normals_{method}", f"""WITH {WORLD}, {GRIDS}, {NORMALS}, {OWNER}, {cte}
SELECT b.run, CAST(b.node AS BIGINT) AS node, {r('coalesce(ax, 0)', 'normal_x')}, {r('coalesce(ay, 0)', 'normal_y')},
       {r(f'coalesce({scale}, 1)', 'eikonal_scale')}
FROM blank b LEFT JOIN owner2 o ON o.run = b.run AND o.node = b.node""")
    def build(spark, sf_dir):
        world, _, _, blank, tree, owners = surface_inputs(spark, sf_dir, k=6)
        out = node_normals(blank, scan_normals(world, 6, tree=tree), owners, method, 0.2)
        return out.select("run", "node", *[shown(F.col(c)).alias(c) for c in ("normal_x", "normal_y", "eikonal_scale")])


for _method in _NODE:
    _register_node_normals(_method)
