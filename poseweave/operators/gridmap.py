"""Grid-map operators: domain, nodes, cell patches, interpolation, gradients, resampling, initialisation.

Node tables are ``(run, node, w, h, value)``; grids are tables ``(run, nx, ny, min_x, min_y, dx, dy)``.
A lookup joins on the cell, not on four nodes: :func:`patches` lays the four corner values of a cell
side by side, so a point needs one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poseweave.functions.grid import GRID_COLUMNS, blend, grid_columns, in_domain, locate, node_position, patch_gradient
from poseweave.operators.neighbors import PACKED_POINTS, CellTree, build_tree, nearest
from poseweave.session import pin

CORNERS = ["00", "10", "01", "11"]
OFFSETS = [(0, 0), (1, 0), (0, 1), (1, 1)]
#: Nodes along a side of the tiles in which nodes meet their neighbours.
TILE_NODES = 32


def auto_grid(points: DataFrame, trajectory: DataFrame, group: list[str], nx: int, ny: int, margin: float) -> DataFrame:
    """One grid per run that covers all world points and all poses plus a margin."""
    both = points.select(*group, F.col("gx").alias("x"), F.col("gy").alias("y")).unionByName(
        trajectory.select(*group, "x", "y"))
    box = both.groupBy(*group).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y")
                                     for f, n in ((F.min, "lo"), (F.max, "hi"))])
    low_x, low_y = F.col("lo_x") - margin, F.col("lo_y") - margin
    return box.select(*group, F.lit(nx).cast("bigint").alias("nx"), F.lit(ny).cast("bigint").alias("ny"),
                      low_x.alias("min_x"), low_y.alias("min_y"),
                      ((F.col("hi_x") + margin - low_x) / (nx - 1)).alias("dx"),
                      ((F.col("hi_y") + margin - low_y) / (ny - 1)).alias("dy"))


def grid_nodes(grids: DataFrame, group: list[str], value: float = 0.0) -> DataFrame:
    """Every node of every grid with its position and a constant value."""
    grid = grid_columns()
    rows = grids.withColumn("h", F.explode(F.sequence(F.lit(0).cast("bigint"), grid.ny - 1)))
    rows = rows.withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), grid.nx - 1)))
    x, y = node_position(grid, F.col("w"), F.col("h"))
    return rows.select(*group, (F.col("h") * grid.nx + F.col("w")).alias("node"), "w", "h",
                       x.alias("x"), y.alias("y"), F.lit(float(value)).alias("value"))


def _tiled(nodes: DataFrame, group: list[str], values: list[str], before: int) -> DataFrame:
    """Nodes dealt out by tiles with their neighbours up to the next tile (``before``: and the last one): one row per place and tile.

    Adds ``_tw, _th`` and ``_n``, the number of rows at the place, and keeps the largest value of each column.
    """
    def tiles(place: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(place) - 1) / TILE_NODES), F.floor((F.col(place) + before) / TILE_NODES)))

    rows = nodes.select(*group, "w", "h", *values, tiles("w").alias("_tw")).withColumn("_th", tiles("h"))
    tile = [*group, "_tw", "_th"]
    return rows.repartition(*tile).groupBy(*tile, "w", "h").agg(*[F.max(v).alias(v) for v in values], F.count(F.lit(1)).alias("_n"))


def _beside(group: list[str], along: str, other: str, step: int, value: str) -> Column:
    """The value ``step`` nodes further along a row or column of a tile; null if there is no such node."""
    line = Window.partitionBy(*group, "_tw", "_th", other).orderBy(along)
    return F.when(F.lead(along, step).over(line) == F.col(along) + step, F.lead(value, step).over(line))


def node_gradients(nodes: DataFrame, grids: DataFrame, group: list[str]) -> DataFrame:
    """Central differences per node, one-sided at the border: adds ``grad_x, grad_y``.

    Nodes meet their neighbours in tiles: each is shuffled once, those at the edge of a tile twice.
    """
    rows = _tiled(nodes, group, ["value"], 1)
    sides = [("_left", "w", "h", -1), ("_right", "w", "h", 1), ("_down", "h", "w", -1), ("_up", "h", "w", 1)]
    for name, along, other, step in sides:
        rows = rows.withColumn(name, _beside(group, along, other, step, "value"))
    own = (F.col("_tw") == F.floor(F.col("w") / TILE_NODES)) & (F.col("_th") == F.floor(F.col("h") / TILE_NODES))
    stencil = rows.where(own).drop("_tw", "_th", "_n").where("value is not null").join(grids, group)

    def slope(low: str, high: str, step: str) -> Column:
        span = (F.col(low).isNotNull().cast("int") + F.col(high).isNotNull().cast("int")) * F.col(step)
        rise = F.coalesce(F.col(high), F.col("value")) - F.coalesce(F.col(low), F.col("value"))
        return rise / span

    return stencil.select(*group, (F.col("h") * F.col("nx") + F.col("w")).alias("node"), "w", "h", "value",
                          slope("_left", "_right", "dx").alias("grad_x"), slope("_down", "_up", "dy").alias("grad_y"))


def patches(nodes: DataFrame, group: list[str], values: list[str] = ("value",)) -> DataFrame:
    """One row per cell ``(cw, ch)`` with corner columns ``<value>_00 … <value>_11``.

    Nodes are dealt out by tiles; a node takes its neighbour's values in the row, then both take those of the row above.
    """
    rows = _tiled(nodes, group, list(values), 0)
    right = {f"{v}_10": _beside(group, "w", "h", 1, v) for v in (*values, "_n")}
    rows = rows.withColumns(right)
    above = {f"{v}_{tag}": _beside(group, "h", "w", 1, v if tag == "01" else f"{v}_10") for v in (*values, "_n") for tag in ("01", "11")}
    rows = rows.withColumns(above).where("_n + _n_10 + _n_01 + _n_11 = 4")
    # Nodes at the far edge of a tile are there for their neighbours; their own cells are made in the next one.
    own = (F.col("_tw") == F.floor(F.col("w") / TILE_NODES)) & (F.col("_th") == F.floor(F.col("h") / TILE_NODES))
    return rows.where(own).select(*group, F.col("w").alias("cw"), F.col("h").alias("ch"), *[
        (F.col(v) if tag == "00" else F.col(f"{v}_{tag}")).alias(f"{v}_{tag}") for v in values for tag in CORNERS])


def attach_cells(points: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """Add ``inside, cw, ch, alpha, beta`` to points that carry grid columns."""
    grid = grid_columns()
    cell = locate(grid, F.col(x), F.col(y))
    return points.withColumns({"inside": in_domain(grid, F.col(x), F.col(y)), "cw": cell.w, "ch": cell.h,
                               "alpha": cell.alpha, "beta": cell.beta})


def corners(value: str = "value") -> list[Column]:
    return [F.col(f"{value}_{tag}") for tag in CORNERS]


def sample(points: DataFrame, nodes: DataFrame, grids: DataFrame, group: list[str]) -> DataFrame:
    """Interpolated value, exact gradient and smooth gradient at world points inside the domain."""
    sloped = node_gradients(nodes, grids, group)
    table = patches(sloped, group, ["value", "grad_x", "grad_y"])
    located = attach_cells(points.join(grids, group)).where("inside")
    joined = located.join(table, [*group, "cw", "ch"])
    a, b = F.col("alpha"), F.col("beta")
    gx, gy = patch_gradient(grid_columns(), a, b, corners())
    return joined.withColumns({
        "sdf": blend(a, b, corners()), "exact_gx": gx, "exact_gy": gy,
        "smooth_gx": blend(a, b, corners("grad_x")), "smooth_gy": blend(a, b, corners("grad_y")),
    }).drop(*[f"{v}_{t}" for v in ("value", "grad_x", "grad_y") for t in CORNERS], *GRID_COLUMNS, "inside")


def probe_gradient(points: DataFrame, nodes: DataFrame, grids: DataFrame, group: list[str], key: list[str],
                   step: float) -> DataFrame:
    """Central difference of the interpolated value at ±``step`` metres: ``(key, probe_gx, probe_gy)``.

    Probes beyond the border extrapolate the border cell.
    """
    arms = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
                     for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    probes = points.join(grids, group).withColumn("arm", F.explode(arms)).withColumns(
        {"gx": F.col("gx") + F.col("arm.a") * step, "gy": F.col("gy") + F.col("arm.b") * step})
    joined = attach_cells(probes).join(patches(nodes, group), [*group, "cw", "ch"])
    value = blend(F.col("alpha"), F.col("beta"), corners())
    return joined.groupBy(*key).agg((F.sum(value * F.col("arm.a")) / (2 * step)).alias("probe_gx"),
                                    (F.sum(value * F.col("arm.b")) / (2 * step)).alias("probe_gy"))


def upsample(nodes: DataFrame, grids: DataFrame, group: list[str], factor: int) -> DataFrame:
    """Bilinear raster ``(row, col, value)`` with ``factor`` samples per cell edge, borders included."""
    table = patches(nodes, group).join(grids.select(*group, "nx", "ny"), group)

    def inner(cell: Column, last: Column) -> Column:
        # The last cell also owns the closing border line.
        return F.sequence(F.lit(0).cast("bigint"), F.when(cell == last - 2, F.lit(factor)).otherwise(
            F.lit(factor - 1)).cast("bigint"))

    rows = table.withColumn("i", F.explode(inner(F.col("cw"), F.col("nx")))).withColumn(
        "j", F.explode(inner(F.col("ch"), F.col("ny"))))
    value = blend(F.col("i") / factor, F.col("j") / factor, corners())
    return rows.select(*group, (F.col("ch") * factor + F.col("j")).alias("row"),
                       (F.col("cw") * factor + F.col("i")).alias("col"), value.alias("value"))


def surface_tree(points: DataFrame, group: list[str], order: list[str], k: int = 1) -> CellTree:
    """Tree over world points ``gx, gy`` that remembers the sensor position ``ox, oy`` of each.

    ``points`` carry ``gx, gy`` and the sensor position in ``x, y``.
    """
    rows = points.select(*group, *[c for c in order if c not in group], F.col("gx").alias("x"), F.col("gy").alias("y"),
                         F.col("x").alias("ox"), F.col("y").alias("oy"))
    return build_tree(rows, group, order, copies=k, packed_points=PACKED_POINTS)


def node_owners(nodes: DataFrame, tree: CellTree, group: list[str], order: list[str]) -> DataFrame:
    """The surface point nearest to every node: its key, place and sensor position as ``n_…``, and ``d2``.

    Square tiles of nodes search together.
    """
    tile = {"_tw": F.floor(F.col("w") / 3), "_th": F.floor(F.col("h") / 3)}
    found = nearest(nodes.select(*group, "node", "w", "h", "x", "y"), ["node"], tree, 1, order,
                    [*order, "x", "y", "ox", "oy"], tile=tile)
    return pin(found.drop("w", "h", "rank"), "owners")


def init_from_scans(nodes: DataFrame, owners: DataFrame, group: list[str], signed: bool = True) -> DataFrame:
    """Node value = distance to its owner, negative behind the surface the owner belongs to.

    Nodes of runs without points keep their value.
    """
    to_node = F.hypot(F.col("x") - F.col("n_ox"), F.col("y") - F.col("n_oy"))
    to_surface = F.hypot(F.col("n_x") - F.col("n_ox"), F.col("n_y") - F.col("n_oy"))
    sign = F.when(to_node <= to_surface, F.lit(1.0)).otherwise(F.lit(-1.0)) if signed else F.lit(1.0)
    fresh = owners.select(*group, "node", (sign * F.sqrt("d2")).alias("_fresh"))
    return nodes.join(fresh, [*group, "node"], "left").withColumn(
        "value", F.coalesce(F.col("_fresh"), F.col("value"))).drop("_fresh")


def hallucinate(points: DataFrame, count: int, step: float, both: bool) -> DataFrame:
    """Points shifted along their beam with the distance they are expected to have.

    Adds ``j, side, delta`` and moves ``sx, sy``; side +1 lies toward the sensor.
    """
    per_side = count // 2 if both else count
    if per_side < 1:
        empty = {"j": F.lit(1).cast("bigint"), "side": F.lit(1), "delta": F.lit(0.0)}
        return points.withColumns(empty).where(F.lit(False))
    length = F.hypot(F.col("sx"), F.col("sy"))
    sides = F.array(F.lit(1), F.lit(-1)) if both else F.array(F.lit(1))
    rows = points.where(length >= 1e-9).withColumn(
        "j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(per_side).cast("bigint")))).withColumn(
        "side", F.explode(sides))
    delta = F.col("side") * F.col("j") * F.lit(float(step))
    return rows.withColumn("delta", delta).withColumn("_len", length).withColumns(
        {"sx": F.col("sx") - F.col("sx") / F.col("_len") * F.col("delta"),
         "sy": F.col("sy") - F.col("sy") / F.col("_len") * F.col("delta")}).drop("_len")


def outside_share(points: DataFrame, grids: DataFrame, group: list[str]) -> DataFrame:
    """How many world points the map does not cover."""
    out = points.join(grids, group).groupBy(*group).agg(
        F.count_if(~in_domain(grid_columns(), F.col("gx"), F.col("gy"))).alias("outside"),
        F.count(F.lit(1)).alias("total"))
    return out.withColumn("percent", F.col("outside") * 100.0 / F.col("total"))


def zoom_box(nodes: DataFrame, grids: DataFrame, trajectory: DataFrame, group: list[str], pad: float) -> DataFrame:
    """Box of nodes that differ from the most frequent value, joined with the path, clamped to the map."""
    counted = nodes.groupBy(*group, "value").count()
    modal = counted.groupBy(*group).agg(
        F.max_by("value", F.struct(F.col("count"), -F.col("value"))).alias("_mode"))
    changed = nodes.join(modal, group).where(F.col("value") != F.col("_mode")).select(*group, "x", "y")
    touched = changed.select(*group).distinct()
    rows = changed.unionByName(trajectory.select(*group, "x", "y").join(touched, group, "left_semi"))
    box = rows.groupBy(*group).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y")
                                     for f, n in ((F.min, "lo"), (F.max, "hi"))]).join(grids, group)
    far_x = F.col("min_x") + (F.col("nx") - 1) * F.col("dx")
    far_y = F.col("min_y") + (F.col("ny") - 1) * F.col("dy")
    return box.select(*group, F.greatest(F.col("lo_x") - pad, "min_x").alias("x0"),
                      F.least(F.col("hi_x") + pad, far_x).alias("x1"),
                      F.greatest(F.col("lo_y") - pad, "min_y").alias("y0"),
                      F.least(F.col("hi_y") + pad, far_y).alias("y1"))
