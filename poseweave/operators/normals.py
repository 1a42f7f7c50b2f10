"""Surface normals of scan points and the normals map nodes inherit from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.functions.linalg import clamp, symmetric_eigen
from poseweave.operators.neighbors import PACKED_POINTS, CellTree, build_tree, nearest_moments


def pca_normals(points: DataFrame, group: list[str], key: list[str], k: int, towards: tuple[str, str],
                tree: CellTree | None = None) -> DataFrame:
    """Normal and cornerness per point from its ``k`` nearest points (itself included) in ``group``.

    ``points`` carry ``x, y``; the normal is turned towards the position in the two ``towards`` columns.
    A ``tree`` over the same points that answers k is used instead of building one.
    """
    k = max(2, k)
    order = [c for c in key if c not in group]
    if tree is None:
        tree = build_tree(points.select(*group, *order, "x", "y", *towards), group, order, copies=k, packed_points=PACKED_POINTS)
    # Copies left out of the tree still need a normal.
    asking = tree if tree.whole else points.select(*group, *order, "x", "y", *towards)
    sums = nearest_moments(asking, order, tree, k, order)
    n = F.col("_n")
    eig = symmetric_eigen(F.col("_uu") - F.col("_u") * F.col("_u") / n, F.col("_uv") - F.col("_u") * F.col("_v") / n,
                          F.col("_vv") - F.col("_v") * F.col("_v") / n)
    facing = eig.axis_x * (F.col(towards[0]) - F.col("x")) + eig.axis_y * (F.col(towards[1]) - F.col("y"))
    # A line through the sensor position faces neither way; the tolerance keeps its sign from being noise.
    sign = F.when(facing < -1e-9, F.lit(-1.0)).otherwise(F.lit(1.0))
    corner = F.greatest(eig.low, F.lit(0.0)) / F.greatest(eig.high, F.lit(1e-12))
    return sums.select(*group, *order, "x", "y", (eig.axis_x * sign).alias("normal_x"),
                       (eig.axis_y * sign).alias("normal_y"), corner.alias("cornerness"))


def scan_normals(world: DataFrame, k: int, per_scan: bool = False, tree: CellTree | None = None) -> DataFrame:
    """Normals of world points ``(run, frame, idx, sx, sy, x, y, theta, gx, gy)``.

    Per-scan normals are estimated in the sensor frame and then rotated by the pose.
    """
    key = ["run", "frame", "idx"]
    if not per_scan:
        points = world.select(*key, F.col("x").alias("ox"), F.col("y").alias("oy"),
                              F.col("gx").alias("x"), F.col("gy").alias("y"))
        return pca_normals(points, ["run"], key, k, ("ox", "oy"), tree).withColumnsRenamed({"x": "gx", "y": "gy"})
    local = world.select(*key, F.col("sx").alias("x"), F.col("sy").alias("y"),
                         F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"))
    found = pca_normals(local, ["run", "frame"], key, k, ("ox", "oy")).drop("x", "y")
    # Written points pack small; their normals are not to be taken for a table to broadcast.
    placed = found.hint("merge").join(world.select(*key, "theta", "gx", "gy"), key)
    cos, sin = F.cos("theta"), F.sin("theta")
    return placed.select(*key, "gx", "gy", (cos * F.col("normal_x") - sin * F.col("normal_y")).alias("normal_x"),
                         (sin * F.col("normal_x") + cos * F.col("normal_y")).alias("normal_y"), "cornerness")


def node_normals(nodes: DataFrame, normals: DataFrame, owners: DataFrame, method: str, corner_threshold: float,
                 group: list[str] = ("run",), order: list[str] = ("frame", "idx")) -> DataFrame:
    """Normal and eikonal scale per node from its owner, the nearest scan point.

    ``pca`` copies the normal, ``hybrid`` blends in the direction to the point near corners,
    ``weighted`` fades the scale out instead.  Nodes of runs without points get (0, 0) and scale 1.
    """
    group, order = list(group), list(order)
    source = normals.select(*group, *[F.col(c).alias(f"n_{c}") for c in (*order, "normal_x", "normal_y", "cornerness")])
    found = owners.join(source, [*group, *[f"n_{c}" for c in order]])
    corner = clamp(F.col("n_cornerness") / corner_threshold, 0.0, 1.0)
    nx, ny, scale = F.col("n_normal_x"), F.col("n_normal_y"), F.lit(1.0)
    found = found.withColumn("corner", corner)
    if method == "weighted":
        scale = 1 - F.col("corner")
    elif method == "hybrid":
        dx, dy = F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")
        found = found.withColumns({"_len": F.hypot(dx, dy)}).withColumns(
            {"_flip": F.when(dx * nx + dy * ny < 0, F.lit(-1.0)).otherwise(F.lit(1.0))})
        near = F.col("_len") < 1e-9
        # A zero length is caught by `near`; nullif keeps the unused branch from dividing by it.
        pull = F.col("corner") * F.col("_flip") / F.nullif(F.col("_len"), F.lit(0.0))
        found = found.withColumns({"_bx": (1 - F.col("corner")) * nx + pull * dx,
                                   "_by": (1 - F.col("corner")) * ny + pull * dy})
        found = found.withColumn("_blen", F.hypot("_bx", "_by"))
        keep = near | F.col("_blen").isNull() | (F.col("_blen") <= 1e-9)
        nx, ny = (F.when(keep, F.col(f"n_normal_{a}")).otherwise(
            F.col(f"_b{a}") / F.nullif(F.col("_blen"), F.lit(0.0))) for a in ("x", "y"))
    elif method != "pca":
        raise ValueError(f"unknown normals method {method!r}")
    assigned = found.select(*group, "node", nx.alias("normal_x"), ny.alias("normal_y"), scale.alias("eikonal_scale"))
    return nodes.select(*group, "node", "w", "h").join(assigned, [*group, "node"], "left").select(
        *group, "node", "w", "h", F.coalesce("normal_x", F.lit(0.0)).alias("normal_x"),
        F.coalesce("normal_y", F.lit(0.0)).alias("normal_y"),
        F.coalesce("eikonal_scale", F.lit(1.0)).alias("eikonal_scale"))
