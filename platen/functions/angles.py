"""Orientations: angles modulo a half turn. Column expressions that stay inside whole-stage code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def orientation_distance(a: Column, b: Column) -> Column:
    """Distance of two orientations in degrees, 0 to 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def wrap_orientation(a: Column) -> Column:
    """Degrees to (-90, 90]."""
    d = F.pmod(a, F.lit(180.0))
    return F.when(d > 90.0, d - 180.0).otherwise(d)


def long_axis_degrees(w: Column, h: Column, angle: Column) -> Column:
    """Orientation in degrees of a rectangle's longer side; angle: of its w side, in radians."""
    return wrap_orientation(F.degrees(angle) + F.when(w >= h, 0.0).otherwise(90.0))


def normalize_orientation(radians: Column) -> Column:
    """Radians to (-pi/2, pi/2]: the same line, whichever way it is run along."""
    turned = F.pmod(radians, F.lit(math.pi))
    return F.when(turned > math.pi / 2, turned - math.pi).otherwise(turned)
