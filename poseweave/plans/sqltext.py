"""Common table expressions shared by the check SQL."""

import re

MOTIONS = """motions AS (
  SELECT user_id AS run, event_id AS scan,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         value / CAST(100 AS DOUBLE) AS dx,
         CAST(CASE event_type WHEN 'click' THEN 0.1 WHEN 'view' THEN -0.05 WHEN 'signup' THEN 0.3
              WHEN 'purchase' THEN -0.2 ELSE 0 END AS DOUBLE) AS dtheta
  FROM events)"""


def integrated(name: str, turn: str = "dtheta") -> str:
    """Running composition of the motions, with an optional turn expression."""
    return f"""{name} AS (
  SELECT run, frame, scan,
         sum(dx * cos(heading)) OVER w AS x, sum(dx * sin(heading)) OVER w AS y,
         atan2(sin(heading + turn), cos(heading + turn)) AS theta
  FROM (SELECT run, frame, scan, dx, {turn} AS turn,
               coalesce(sum({turn}) OVER (PARTITION BY run ORDER BY frame
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS heading
        FROM motions)
  WINDOW w AS (PARTITION BY run ORDER BY frame ROWS UNBOUNDED PRECEDING))"""


POSES = MOTIONS + ",\n" + integrated("poses")
DRIFT = POSES + ",\n" + integrated("drift", "dtheta * CAST(1.02 AS DOUBLE)")

SCANS = """ranges AS (
  SELECT scan, l_quantity AS reading,
         row_number() OVER (PARTITION BY scan ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_shipdate) - 1 AS beam,
         count(*) OVER (PARTITION BY scan) AS beams
  FROM (SELECT *, l_orderkey % (SELECT count(*) FROM events) AS scan FROM lineitem)),
scans AS (
  SELECT scan, beam AS idx, reading * cos(angle) AS sx, reading * sin(angle) AS sy
  FROM (SELECT *, -pi() / 2 + beam * (pi() / beams) AS angle FROM ranges)
  WHERE reading >= CAST(0.1 AS DOUBLE) AND reading < 49)"""

WORLD = POSES + ",\n" + SCANS + """,
world AS (
  SELECT p.run, p.frame, s.idx, s.sx, s.sy, p.x, p.y, p.theta,
         p.x + cos(p.theta) * s.sx - sin(p.theta) * s.sy AS gx,
         p.y + sin(p.theta) * s.sx + cos(p.theta) * s.sy AS gy
  FROM scans s JOIN poses p ON p.scan = s.scan)"""


def grids(nx: int, ny: int, margin: float) -> str:
    return f"""grids AS (
  SELECT run, {nx} AS nx, {ny} AS ny, min_x, min_y,
         (max_x - min_x) / ({nx} - 1) AS dx, (max_y - min_y) / ({ny} - 1) AS dy
  FROM (SELECT run, min(x) - {margin} AS min_x, max(x) + {margin} AS max_x,
               min(y) - {margin} AS min_y, max(y) + {margin} AS max_y
        FROM (SELECT run, gx AS x, gy AS y FROM world UNION ALL SELECT run, x, y FROM poses) GROUP BY run)),
blank AS (
  SELECT run, nx, ny, h * nx + w AS node, w, h, min_x + w * dx AS x, min_y + h * dy AS y
  FROM grids, (SELECT range AS w FROM range({nx})), (SELECT range AS h FROM range({ny})))"""


NODES = """hits AS (
  SELECT b.run, b.node, b.w, b.h, b.x, b.y, p.gx, p.gy, p.x AS ox, p.y AS oy,
         (p.gx - b.x) * (p.gx - b.x) + (p.gy - b.y) * (p.gy - b.y) AS d2, p.frame, p.idx
  FROM blank b JOIN world p ON p.run = b.run),
first_hit AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY run, node ORDER BY d2, frame, idx) = 1),
nodes AS (
  SELECT b.run, b.node, b.w, b.h, b.x, b.y,
         coalesce(sqrt(f.d2) * CASE WHEN sqrt((b.x - f.ox) * (b.x - f.ox) + (b.y - f.oy) * (b.y - f.oy))
                                      <= sqrt((f.gx - f.ox) * (f.gx - f.ox) + (f.gy - f.oy) * (f.gy - f.oy))
                                    THEN 1 ELSE -1 END, CAST(0 AS DOUBLE)) AS value
  FROM blank b LEFT JOIN first_hit f ON f.run = b.run AND f.node = b.node)"""


def materialized(sql: str) -> str:
    """The shared expressions computed once, where a query uses them many times."""
    names = "world|nodes|cells|specs|poses|drift|scans|hits|first_hit|grids|blank|ranges|motions"
    return re.sub(rf"\b({names}) AS \(", r"\1 AS MATERIALIZED (", sql)


def r(expression: str, name: str) -> str:
    """Rounded output column without negative zero."""
    return f"round({expression}, 6) + CAST(0 AS DOUBLE) AS {name}"
