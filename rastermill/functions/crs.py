"""South-polar stereographic projection of a sphere, in closed form, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the Moon's reference sphere in metres (fixed value).
RADIUS_M = 1737400.0


def stereo_x(lon: Column, lat: Column, radius: float = RADIUS_M) -> Column:
    return 2 * radius * F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2) * F.sin(F.radians(lon))


def stereo_y(lon: Column, lat: Column, radius: float = RADIUS_M) -> Column:
    return 2 * radius * F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2) * F.cos(F.radians(lon))


def lon_of(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(x, y))


def lat_of(x: Column, y: Column, radius: float = RADIUS_M) -> Column:
    return F.degrees(2 * F.atan(F.hypot(x, y) / (2 * radius)) - math.pi / 2)


def convergence(x: Column, y: Column) -> Column:
    """Grid convergence in radians: the angle from grid north to true north."""
    return F.atan2(x, y)
