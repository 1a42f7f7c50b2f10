"""Closed-form 2×2 linear algebra on Columns, and output rounding."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class SymmetricEigen(NamedTuple):
    low: Column
    high: Column
    axis_x: Column
    axis_y: Column


def symmetric_eigen(xx: Column, xy: Column, yy: Column) -> SymmetricEigen:
    """Eigenvalues of [[xx, xy], [xy, yy]] and the unit eigenvector of the smaller one."""
    mid, half = (xx + yy) / 2, (xx - yy) / 2
    spread = F.sqrt(half * half + xy * xy)
    phi = F.atan2(2 * xy, xx - yy) / 2
    return SymmetricEigen(mid - spread, mid + spread, -F.sin(phi), F.cos(phi))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def shown(value: Column, digits: int = 6) -> Column:
    """Round for output; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
