"""Map-tile grid algebra as Column expressions: closed forms, inside whole-stage codegen.

A tile is (x, y) at a zoom from 0 to 19; its id is "x_y_zoom". Latitudes beyond about 85.05
degrees lie outside the projection and should be filtered by the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 19


def check_zoom(zoom: int) -> int:
    if not 0 <= zoom <= MAX_ZOOM:
        raise ValueError(f"zoom must be from 0 to {MAX_ZOOM}, not {zoom}")
    return zoom


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(2 ** check_zoom(zoom))).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(2 ** check_zoom(zoom))).cast("long")


def tile_lon(x: Column, zoom: int) -> Column:
    """Western edge of a tile column."""
    return x / float(2 ** check_zoom(zoom)) * 360.0 - 180.0


def tile_lat(y: Column, zoom: int) -> Column:
    """Northern edge of a tile row."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2.0 / float(2 ** check_zoom(zoom))))))


def tile_id(x: Column, y: Column, zoom: int) -> Column:
    return F.concat_ws("_", x.cast("string"), y.cast("string"), F.lit(str(zoom)))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    return tile_id(tile_x(lon, zoom), tile_y(lat, zoom), zoom)


def tile_parent(x: Column, y: Column, zoom: int, up: int) -> Column:
    """Id of the tile ``up`` zoom levels above."""
    return tile_id(F.shiftright(x, up), F.shiftright(y, up), zoom - up)


def disk(x: Column, y: Column, k: int) -> Column:
    """Array of (x, y, distance) within Chebyshev distance k, the tile itself included."""
    steps = F.sequence(F.lit(-k), F.lit(k)) if k else F.array(F.lit(0))
    return F.flatten(
        F.transform(
            steps,
            lambda dx: F.transform(
                steps,
                lambda dy: F.struct(
                    (x + dx).alias("x"), (y + dy).alias("y"), F.greatest(F.abs(dx), F.abs(dy)).cast("int").alias("distance")
                ),
            ),
        )
    )


def ring(x: Column, y: Column, k: int) -> Column:
    """Array of (x, y, distance) at Chebyshev distance k exactly."""
    return F.filter(disk(x, y, k), lambda c: c["distance"] == k)


def path(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Tiles of the straight path between two tiles, both ends included: (x, y) per step.

    As many steps as the Chebyshev distance, each coordinate rounded half up, so that
    neighbours in the path are neighbours in the grid.
    """
    n = F.greatest(F.abs(x1 - x0), F.abs(y1 - y0))

    def at(a: Column, b: Column, i: Column) -> Column:
        # floor((2 * i * (b - a) + n) / (2 n)) in integers
        return a + F.floor((F.lit(2) * i * (b - a) + n) / (F.lit(2) * F.greatest(n, F.lit(1)))).cast("long")

    return F.transform(
        F.sequence(F.lit(0).cast("long"), n.cast("long")),
        lambda i: F.struct(at(x0, x1, i).alias("x"), at(y0, y1, i).alias("y")),
    )


# --- Hexagons in axial coordinates. Not the H3 system. ----------------------------------------


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """Axial (q, r) of the pointy-top hexagon of edge ``size`` that holds a planar point."""
    q = (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / size
    r = y * (2.0 / 3.0) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.struct(
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long").alias("q"),
        F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr).cast("long").alias("r"),
    )


def hex_distance(q0: Column, r0: Column, q1: Column, r1: Column) -> Column:
    dq, dr = q1 - q0, r1 - r0
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2).cast("int")


def hex_disk(q: Column, r: Column, k: int) -> Column:
    """Array of (q, r, distance) within hex distance k."""
    steps = F.sequence(F.lit(-k), F.lit(k)) if k else F.array(F.lit(0))
    zero = F.lit(0)
    cells = F.flatten(
        F.transform(
            steps,
            lambda dq: F.transform(
                steps,
                lambda dr: F.struct(
                    (q + dq).alias("q"), (r + dr).alias("r"), hex_distance(zero, zero, dq, dr).alias("distance")
                ),
            ),
        )
    )
    return F.filter(cells, lambda c: c["distance"] <= k)


def hilbert(lon: Column, lat: Column, bits: int = 16) -> Column:
    """A place's number along a Hilbert curve through a grid of 2^bits by 2^bits cells of the map: near numbers are near places. Null places give null."""
    n = 1 << bits
    at = lambda v, low, width: F.least(F.greatest(F.floor((v - low) / width * n), F.lit(0)), F.lit(n - 1)).cast("long")
    start = F.struct(at(lon, -180.0, 360.0).alias("x"), at(lat, -90.0, 180.0).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, k: Column) -> Column:
        s = F.lit(1).cast("long") * F.pow(F.lit(2), k).cast("long")
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        x = F.when((ry == 0) & (rx == 1), n - 1 - acc["x"]).otherwise(acc["x"])
        y = F.when((ry == 0) & (rx == 1), n - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (acc["d"] + s * s * (3 * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["d"])
