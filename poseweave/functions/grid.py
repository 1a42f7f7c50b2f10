"""Regular node grid: ids, cell lookup and bilinear interpolation as Column expressions.

A grid is described by six columns (``nx, ny, min_x, min_y, dx, dy``), so that every run can carry
its own map.  Nodes are numbered row by row: ``node = h * nx + w``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_COLUMNS = ["nx", "ny", "min_x", "min_y", "dx", "dy"]


class Grid(NamedTuple):
    nx: Column
    ny: Column
    min_x: Column
    min_y: Column
    dx: Column
    dy: Column


def grid_columns() -> Grid:
    return Grid(*(F.col(name) for name in GRID_COLUMNS))


def fixed_grid(nx: int, ny: int, low: tuple[float, float], high: tuple[float, float]) -> Grid:
    if nx < 2 or ny < 2:
        raise ValueError("a grid needs at least two nodes per axis")
    dx, dy = (high[0] - low[0]) / (nx - 1), (high[1] - low[1]) / (ny - 1)
    return Grid(F.lit(nx).cast("bigint"), F.lit(ny).cast("bigint"), F.lit(float(low[0])), F.lit(float(low[1])),
                F.lit(dx), F.lit(dy))


def with_grid(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns(dict(zip(GRID_COLUMNS, grid)))


def node_id(grid: Grid, w: Column, h: Column) -> Column:
    return h * grid.nx + w


def node_position(grid: Grid, w: Column, h: Column) -> tuple[Column, Column]:
    return grid.min_x + w * grid.dx, grid.min_y + h * grid.dy


class Cell(NamedTuple):
    w: Column
    h: Column
    alpha: Column
    beta: Column


def in_domain(grid: Grid, x: Column, y: Column) -> Column:
    fx, fy = (x - grid.min_x) / grid.dx, (y - grid.min_y) / grid.dy
    return (~F.isnan(fx) & ~F.isnan(fy)
            & fx.between(F.lit(0.0), grid.nx - F.lit(1.0)) & fy.between(F.lit(0.0), grid.ny - F.lit(1.0)))


def locate(grid: Grid, x: Column, y: Column) -> Cell:
    """Cell of a point; outside the domain the border cell is used and alpha/beta extrapolate.

    Combine with :func:`in_domain` where outside points must be told apart.
    """
    fx, fy = (x - grid.min_x) / grid.dx, (y - grid.min_y) / grid.dy
    w = F.greatest(F.lit(0), F.least(F.floor(fx), grid.nx - 2))
    h = F.greatest(F.lit(0), F.least(F.floor(fy), grid.ny - 2))
    return Cell(w, h, fx - w, fy - h)


def bilinear_weights(alpha: Column, beta: Column) -> list[Column]:
    """Weights of the corners in the order (0,0), (1,0), (0,1), (1,1)."""
    return [(1 - alpha) * (1 - beta), alpha * (1 - beta), (1 - alpha) * beta, alpha * beta]


def blend(alpha: Column, beta: Column, corners: list[Column]) -> Column:
    w = bilinear_weights(alpha, beta)
    return w[0] * corners[0] + w[1] * corners[1] + w[2] * corners[2] + w[3] * corners[3]


def patch_gradient(grid: Grid, alpha: Column, beta: Column, v: list[Column]) -> tuple[Column, Column]:
    """Exact gradient of the bilinear patch with corner values ``v``."""
    return (((1 - beta) * (v[1] - v[0]) + beta * (v[3] - v[2])) / grid.dx,
            ((1 - alpha) * (v[2] - v[0]) + alpha * (v[3] - v[1])) / grid.dy)
