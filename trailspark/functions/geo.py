"""Column expressions for positions, distances, bearings and tiles.

The distances use different radii on purpose: each belongs to the operators named with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii and scales of the distance formulas.
SEARCH_KM = 6371.0
ROUTE_M = 6371008.8
PLANE_M = 6371000.0
DEGREE_M = 111195.0
DEGREE_KM = 111.2
EQUATOR_M = 40075016.686
UNITS = 360.0 / (1 << 24)
EXTENT = 4096

OCTANTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def even_round(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def _hav(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.asin(F.when(a > 1, 1.0).when(a.isNotNull(), F.sqrt(a)))  # least() would take an unknown position for the other side of the globe


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.lit(2 * SEARCH_KM) * _hav(lon1, lat1, lon2, lat2)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.lit(2 * ROUTE_M) * _hav(lon1, lat1, lon2, lat2)


def plane_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular, at the mean latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(PLANE_M) * F.sqrt(x * x + y * y)


def degree_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees as lengths, at the first latitude."""
    x, y = (lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1
    return F.lit(DEGREE_M) * F.sqrt(x * x + y * y)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def turn(before: Column, after: Column) -> Column:
    """Signed angle from one bearing to the next, above -180 up to 180."""
    d = F.pmod(after - before, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def octant(degrees: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in OCTANTS]), (js_round(F.pmod(degrees, F.lit(360.0)) / 45) % 8 + 1).cast("int"))


def tile_x(lon: Column, zoom: Column | int) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))).cast("long")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * F.pow(F.lit(2.0), z)).cast("long")


def tile_west(x: Column, zoom: int) -> Column:
    return x / float(1 << zoom) * 360 - 180


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - y * 2 / float(1 << zoom)))))


def zoom_for(speed_scale: Column, lat: Column) -> Column:
    """Zoom at which a pixel has that many metres."""
    return F.log2(F.lit(EQUATOR_M) * F.cos(F.radians(lat)) / (speed_scale * 512))
