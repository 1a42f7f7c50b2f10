"""SE(2) algebra as Column expressions. Angles are radians, lengths metres."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pose(NamedTuple):
    """Three columns that together describe a pose or a relative motion."""

    x: Column
    y: Column
    theta: Column

    def named(self, prefix: str = "") -> list[Column]:
        return [self.x.alias(f"{prefix}x"), self.y.alias(f"{prefix}y"), self.theta.alias(f"{prefix}theta")]


def pose(prefix: str = "", suffix: str = "") -> Pose:
    return Pose(*(F.col(f"{prefix}{part}{suffix}") for part in ("x", "y", "theta")))


def wrap_angle(angle: Column) -> Column:
    return F.atan2(F.sin(angle), F.cos(angle))


def rotate(theta: Column, x: Column, y: Column) -> tuple[Column, Column]:
    cos, sin = F.cos(theta), F.sin(theta)
    return cos * x - sin * y, sin * x + cos * y


def apply(at: Pose, x: Column, y: Column) -> tuple[Column, Column]:
    """A sensor-frame point in the frame ``at`` is expressed in."""
    rx, ry = rotate(at.theta, x, y)
    return at.x + rx, at.y + ry


def compose(first: Pose, then: Pose) -> Pose:
    x, y = apply(first, then.x, then.y)
    return Pose(x, y, wrap_angle(first.theta + then.theta))


def relative(origin: Pose, target: Pose) -> Pose:
    """``target`` seen from ``origin``; the inverse of :func:`compose`."""
    x, y = rotate(-origin.theta, target.x - origin.x, target.y - origin.y)
    return Pose(x, y, wrap_angle(target.theta - origin.theta))


def pose_error(reference: Pose, estimate: Pose) -> tuple[Column, Column]:
    """Translation length and absolute angle of ``reference``⁻¹ ∘ ``estimate``."""
    delta = relative(reference, estimate)
    return F.hypot(delta.x, delta.y), F.abs(delta.theta)
