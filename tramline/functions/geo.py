"""Distances and walks on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_194.0
DETOUR = 1.3


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def rounded(value: Column) -> Column:
    """Half up to a whole number."""
    return F.floor(value + 0.5).cast("long")


def walk_seconds(distance: Column, speed: float = 1.4) -> Column:
    """Seconds to walk a bee-line distance with the usual detour."""
    return rounded(distance * DETOUR / speed)


def valid_coordinate(lat: Column, lon: Column) -> Column:
    inside = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of two points of a plane, in the unit of its axes."""
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))
