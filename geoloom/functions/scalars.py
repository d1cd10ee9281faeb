"""Small scalar rules as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def gtfs_hour(departure: Column) -> Column:
    """Hour of "H:MM:SS" or "HH:MM:SS"; hours of 24 and more wrap."""
    return (F.regexp_replace(F.substring(departure, 1, 2), ":", "").try_cast("int") % 24).cast("int")


def feature_id(*parts: Column) -> Column:
    """Index levels joined by a slash."""
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def geometry_hash(wkt: Column) -> Column:
    return F.sha2(wkt, 256)


def haversine_m(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat1 - lat0) / 2.0, F.radians(lon1 - lon0) / 2.0
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def line_length(points: Column) -> Column:
    """Planar length of an array of (lon, lat) structs, in degrees."""
    pairs = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.sqrt((b["lon"] - a["lon"]) * (b["lon"] - a["lon"]) + (b["lat"] - a["lat"]) * (b["lat"] - a["lat"])),
    )
    return F.aggregate(pairs, F.lit(0.0), lambda acc, d: acc + d)


def mape_term(true: Column, predicted: Column, epsilon: float = 1e-10) -> Column:
    """One row's part of the mean absolute percentage error."""
    return F.abs((true - predicted) / (true + F.lit(epsilon))) * 100.0


def smape_term(true: Column, predicted: Column, epsilon: float = 1e-10) -> Column:
    return F.abs(predicted - true) * 2.0 / (F.abs(predicted) + F.abs(true) + F.lit(epsilon)) * 100.0


def shifted_time(ts: Column, source: str = "UTC", target: str = "Asia/Shanghai") -> Column:
    """A naive timestamp moved from one zone's clock to another's."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


def region_name(tags: Column, element_id: Column, prefer_english: bool = True) -> Column:
    """name:en if preferred, else name, else the id; empty names don't count."""
    names = [F.nullif(tags[k], F.lit("")) for k in (("name:en", "name") if prefer_english else ("name",))]
    return F.coalesce(*names, element_id.cast("string"))


def sincos_position(position: Column, dim: int) -> list[Column]:
    """Sinusoidal embedding of a position: dim / 2 sines, then as many cosines."""
    if dim % 2:
        raise ValueError("dim must be even")
    rates = [1.0 / 10000 ** (k / (dim / 2.0)) for k in range(dim // 2)]
    return [F.sin(position * w) for w in rates] + [F.cos(position * w) for w in rates]


def map_zoom(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Zoom level at which an extent fills a map."""
    extent = F.greatest(maxx - minx, maxy - miny) * 111.0
    return F.lit(12.5) - F.log(extent)


def hex_patch_weights(distance: Column, radius: int) -> tuple[Column, Column]:
    """Distance and numerosity weights of a hexagonal patch's cells."""
    inside = distance <= radius
    w_dist = F.when(inside, F.lit(1.0) / (distance + 1.0)).otherwise(F.lit(0.0))
    w_num = F.when(~inside, F.lit(0.0)).when(distance == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (distance * 6.0))
    return w_dist, w_num


def degrees_per_metre(lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that one metre spans at a latitude."""
    per = 180.0 / (math.pi * EARTH_RADIUS_M)
    return F.lit(per) / F.cos(F.radians(lat)), F.lit(per)
