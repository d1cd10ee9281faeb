"""Coordinate systems: web map metres and UTM to longitude and latitude, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid of WGS 84, and UTM's scale and offsets.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0


def web_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857."""
    return F.degrees(x / AXIS), F.degrees(F.atan(F.exp(y / AXIS)) * 2 - math.pi / 2)


def utm_to_degrees(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """EPSG:32601 to 32660 (north) and 32701 to 32760 (south), by the series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - (SOUTH if south else 0.0)) / (SCALE * radius), (x - EAST) / (SCALE * radius)
    a, b = xi, eta
    for k, c in enumerate(beta, 1):
        a = a - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * c
        b = b - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * c
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for k, c in enumerate(delta, 1):
        lat = lat + F.sin(chi * (2 * k)) * c
    lon = F.atan2(F.sinh(b), F.cos(a)) + math.radians(6 * zone - 183)
    return F.degrees(lon), F.degrees(lat)


def to_degrees(df: DataFrame, epsg: int, *, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points of a coordinate system with their columns as longitude and latitude (EPSG:4326)."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    if epsg == 4326:
        return df
    if epsg == 3857:
        a, b = web_to_degrees(x, y)
    elif epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60:
        a, b = utm_to_degrees(x, y, epsg % 100, epsg // 100 == 327)
    else:
        raise ValueError(f"EPSG:{epsg} is not known; convert it first")
    return df.withColumns({lon: a, lat: b})
