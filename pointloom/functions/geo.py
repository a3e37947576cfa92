"""Positions on the sphere and on the Web-Mercator square."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .values import clamp

# Fixed values.
EARTH_RADIUS = 6371008.8
FOOT = 0.3048
NAUTICAL_MILE = 1852.0
MAX_MERCATOR_LATITUDE = 85.05112878


def coordinates_ok(lon: Column, lat: Column) -> Column:
    """Finite WGS84 degrees; never null."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def clamp_latitude(lat: Column) -> Column:
    return clamp(lat, -MAX_MERCATOR_LATITUDE, MAX_MERCATOR_LATITUDE)


def is_clamped(lat: Column) -> Column:
    """True where the map cannot show the latitude; the stored value is kept."""
    return F.abs(lat) > MAX_MERCATOR_LATITUDE


def mercator_x(lon: Column) -> Column:
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    """0 at the top of the map, 1 at the bottom."""
    angle = F.lit(math.pi / 4) + clamp_latitude(lat) * F.lit(math.pi) / 360
    y = (1 - F.log(F.tan(angle)) / F.lit(math.pi)) / 2
    return clamp(y, 0.0, 1.0)


def mercator_point(lon: float, lat: float) -> tuple[float, float]:
    """Driver-side projection of one map position."""
    if not (math.isfinite(lon) and math.isfinite(lat) and abs(lon) <= 180 and abs(lat) <= 90):
        raise ValueError(f"Outside the globe: longitude {lon}, latitude {lat}")
    lat = max(-MAX_MERCATOR_LATITUDE, min(MAX_MERCATOR_LATITUDE, lat))
    y = (1 - math.log(math.tan(math.pi / 4 + lat * math.pi / 360)) / math.pi) / 2
    return (lon + 180) / 360, max(0.0, min(1.0, y))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on the mean-radius sphere."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(clamp(h, 0.0, 1.0)))


def to_feet(metres: Column) -> Column:
    return metres / F.lit(FOOT)


def to_nautical_miles(metres: Column) -> Column:
    return metres / F.lit(NAUTICAL_MILE)


def format_coordinate(lon: Column, lat: Column) -> Column:
    """``Lat 53.99000°  Lon -1.55000°``."""
    return F.format_string("Lat %.5f°  Lon %.5f°", lat, lon)
