"""Regionalizers: areas to tables of micro-regions."""

from __future__ import annotations

import itertools
import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import grid, h3, s2
from geoloom.operators import voronoi
from geoloom.operators.borders import simplify_shared
from geoloom.functions.scalars import EARTH_RADIUS_M, haversine_m
from geoloom.functions.geometry import st_area, st_centroid, st_clip_box, st_holds, st_intersects, st_merged, st_parts
from geoloom.schema import BOX, GEOMETRY, need, with_bounds
from geoloom.storage import written


def explode_parts(df: DataFrame) -> DataFrame:
    """Multipart geometries as single parts; other columns repeat."""
    return df.withColumn(GEOMETRY, F.explode(st_parts(F.col(GEOMETRY)))).drop(*BOX)


def tile_boxes(tiles: DataFrame, zoom: int) -> DataFrame:
    """Adds the boxes of tiles (x, y)."""
    x, y = F.col("x"), F.col("y")
    return tiles.withColumns(
        {
            "minx": grid.tile_lon(x, zoom), "miny": grid.tile_lat(y + 1, zoom),
            "maxx": grid.tile_lon(x + 1, zoom), "maxy": grid.tile_lat(y, zoom),
        }
    )


def slippy_regions(areas: DataFrame, zoom: int) -> DataFrame:
    """Map tiles that meet the areas: region_id, x, y, z and the box, each tile once.

    Areas are boxes, points or WKB; for WKB each tile is tested against the exact geometry.
    """
    grid.check_zoom(zoom)
    exact = GEOMETRY in areas.columns
    if exact:
        areas = explode_parts(areas.select(GEOMETRY))
    a = with_bounds(areas).select(*([GEOMETRY] if exact else []), *[F.col(c).alias(f"a_{c}") for c in BOX])
    x = F.sequence(grid.tile_x(F.col("a_minx"), zoom), grid.tile_x(F.col("a_maxx"), zoom))
    y = F.sequence(grid.tile_y(F.col("a_maxy"), zoom), grid.tile_y(F.col("a_miny"), zoom))
    tiles = tile_boxes(a.withColumn("x", F.explode(x)).withColumn("y", F.explode(y)), zoom)
    if exact:
        from geoloom.operators.spatial_join import _box_wkb

        tiles = tiles.filter(st_intersects(F.col(GEOMETRY), _box_wkb("")))
    tiles = tiles.select("x", "y", *BOX).dropDuplicates(["x", "y"])
    return tiles.select(grid.tile_id(F.col("x"), F.col("y"), zoom).alias("region_id"), "x", "y", F.lit(zoom).alias("z"), *BOX)


def ring_buffer(tiles: DataFrame, distance: int, zoom: int) -> DataFrame:
    """A set of tiles (x, y) with all tiles within a Chebyshev distance."""
    near = F.explode(grid.disk(F.col("x"), F.col("y"), distance)).alias("c")
    return tiles.select(near).select("c.x", "c.y").distinct().withColumn("region_id", grid.tile_id(F.col("x"), F.col("y"), zoom))


def s2_regions(areas: DataFrame, level: int, buffer: bool = True) -> DataFrame:
    """S2 cells that meet (buffer) or lie within the areas: region_id (token), cell, geometry.

    A recursive cover per area from the six faces, in a task; areas are WKB polygons.
    """
    s2.check_level(level)

    def run(batches):
        import numpy as np
        import pandas as pd

        from geoloom.functions import geometry as G

        for batch in batches:
            out = []
            for raw in batch[GEOMETRY]:
                shape = G.from_wkb(bytes(raw))
                todo = [(f << 61) | (1 << 60) for f in range(6)]
                while todo:
                    cell = todo.pop()
                    corners = s2.boundary(cell)
                    own = s2.level_of(cell)
                    if np.ptp(corners[:, 0]) > 180 or own < 3:  # too coarse to draw on a plane
                        todo += _children(cell) if own < level else []
                        continue
                    quad = G.polygon(corners)
                    if not G.intersects(quad, shape):
                        continue
                    if own == level:
                        if buffer or G.within(quad, shape):
                            out.append((s2.token(cell), cell - (1 << 64) if cell >> 63 else cell, G.to_wkb(quad)))
                    else:
                        todo += _children(cell)
            yield pd.DataFrame(out, columns=["region_id", "cell", GEOMETRY])

    cells = explode_parts(areas.select(GEOMETRY)).mapInPandas(run, f"region_id string, cell long, {GEOMETRY} binary")
    return cells.dropDuplicates(["cell"])


def _children(cell: int) -> list[int]:
    low = cell & -cell
    return [cell - low + (2 * k + 1) * (low >> 2) for k in range(4)]


def voronoi_assign(points: DataFrame, seeds: DataFrame, *, seed_id: str = "region_id", cell: float | None = None, rounds: int = 30) -> DataFrame:
    """Each point with its nearest seed by great-circle distance; ties to the smaller id. There are at least four seeds, without duplicates.

    The seeds lie in a grid of cubes around the unit sphere, of ``cell`` degrees at first (unless given, so that no cube holds
    many seeds). A cube's row lists the seeds of the 27 cubes around it, so a point meets one row, by
    equality, and is never repeated; it leaves once no seed beyond those cubes can be nearer. Cubes double in each round; those of the last round
    hold the whole sphere, where a few seeds begin.
    """
    seeds, n = check_seeds(seeds, seed_id)
    seeds = seeds.select(F.col(seed_id).alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    side = math.radians(cell) if cell else voronoi.first_side(seeds.select(*[c.alias(x) for c, x in zip(voronoi.unit(F.col("lon"), F.col("lat")), "xyz", strict=True)]), n)
    left = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("row"), "lon", "lat")
    done = None
    for turn in range(rounds):
        last = side >= 2 or turn == rounds - 1
        side = 2.0 if last else side
        around = seeds
        for c, n in zip(_cube(F.col("lon"), F.col("lat"), side), "ijk", strict=True):
            around = around.withColumn(n, F.explode(F.array(*[c + k for k in (-1, 0, 1)])))
        around = around.groupBy("i", "j", "k").agg(F.collect_list(F.struct("id", "lon", "lat")).alias("seeds"))
        at = [c.alias(n) for c, n in zip(_cube(F.col("lon"), F.col("lat"), side), "ijk", strict=True)]
        d = lambda s: F.struct(F.round(haversine_m(F.col("lon"), F.col("lat"), s["lon"], s["lat"]), 6).alias("d"), s["id"].alias("id"))
        joined = left.select("row", "lon", "lat", *at).join(around, ["i", "j", "k"], "left").select("row", "lon", "lat", F.array_min(F.transform("seeds", d)).alias("near"))
        found = lambda df: df.select("row.*", F.col("near.id").alias(seed_id), F.col("near.d").alias("distance_m"))
        if last:
            return found(joined) if done is None else done.unionByName(found(joined))
        joined = written(joined, "nearest")
        # An unseen seed is at least a side away as the crow flies; the metre is for rounding.
        settled = F.coalesce(F.col("near.d") < 2 * EARTH_RADIUS_M * math.asin(side / 2) - 1.0, F.lit(False))
        part = found(joined.filter(settled))
        done = part if done is None else done.unionByName(part)
        left = joined.filter(~settled).drop("near")
        if left.limit(1).count() == 0:
            return done
        side *= 2
    return done


def _cube(lon: Column, lat: Column, side: float) -> list[Column]:
    """Cell of a place's point in a grid of cubes; no place is at an edge of the map there."""
    return [F.coalesce(c, F.lit(0)) for c in voronoi.cubes(*voronoi.unit(lon, lat), side)]


def check_seeds(seeds: DataFrame, seed_id: str) -> tuple[DataFrame, int]:
    """The seeds and how many they are: at least four, without duplicates, in bounds; ValueError otherwise."""
    need(seeds, seed_id, "lon", "lat", role="seeds table")
    facts = seeds.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("lon", "lat").alias("places"),
        F.coalesce(F.max(~(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))), F.lit(False)).alias("outside"),
    ).first()
    if facts["n"] < 4:
        raise ValueError("at least four seeds are needed")
    if facts["places"] < facts["n"]:
        raise ValueError("seeds share a place")
    if facts["outside"]:
        raise ValueError("seeds lie outside the bounds of the Earth")
    return seeds, facts["n"]


def voronoi_polygons(seeds: DataFrame, *, seed_id: str = "region_id", step_degrees: float = 2.0, mask=None) -> DataFrame:
    """Spherical Voronoi regions of any number of seeds as WKB polygons in longitude and latitude.

    Edges are arcs of great circles with a corner every ``step_degrees`` at least and closer ones next to the seeds; neighbours share them.
    A ``mask`` (polygon) cuts the regions. No seed reaches the driver: see ``voronoi.regions``.
    """
    cells = voronoi.drawn(voronoi.regions(check_seeds(seeds, seed_id)[0], seed_id), seed_id, step_degrees)
    if mask is None:
        return cells
    from geoloom.operators.spatial_join import clip_to

    return clip_to(cells, mask)


def seed_points(shapes: DataFrame, *, seed_id: str = "region_id") -> DataFrame:
    """Seeds (id, lon, lat) of WKB shapes: points as they are, others by their centroid, empty ones dropped."""
    c = st_centroid(F.col(GEOMETRY))
    return shapes.select(seed_id, c.alias("_c")).filter("_c is not null").select(seed_id, "_c.lon", "_c.lat")


def administrative_regions(
    boundaries: DataFrame,
    area: DataFrame,
    *,
    admin_level: int,
    cell: float | None = None,
    prefer_english: bool = True,
    least_share: float = 0.01,
    clip_to_area: bool = False,
    tolerance: float | None = None,
    fill_empty: bool = False,
) -> DataFrame:
    """Boundaries of a level that meet an area, from a table of boundaries.

    ``boundaries``: element_id, admin_level, tags (map) and a box or WKB; ``area``: boxes or
    points. Duplicate elements count once; a region stays if it holds a point of the area or if more than ``least_share`` of it lies
    in the area. Shapes can be simplified within ``tolerance`` degrees, neighbours alike, and cut to the area's boxes. Columns: region_id
    (the chosen name), element_id, the box and geometry if there is one. With ``fill_empty`` what no
    region covers of the area's boxes follows as rows named "EMPTY" with geometry. Finding none is a
    RuntimeWarning and an empty table.
    """
    from geoloom.functions.scalars import region_name
    from geoloom.operators.spatial_join import meeting

    if not 1 <= admin_level <= 11:
        raise ValueError("admin_level must be from 1 to 11")
    exact = GEOMETRY in boundaries.columns
    own = boundaries.filter(F.col("admin_level") == admin_level).dropDuplicates(["element_id"])
    if exact and tolerance:
        own = simplify_shared(own, tolerance)
    own = with_bounds(own)
    pairs = meeting(own.select("element_id", *BOX, *([GEOMETRY] if exact else [])), with_bounds(area).select(*BOX), cell)
    point = (F.col("r_minx") == F.col("r_maxx")) & (F.col("r_miny") == F.col("r_maxy"))
    shared = {"minx": F.greatest("l_minx", "r_minx"), "miny": F.greatest("l_miny", "r_miny"), "maxx": F.least("l_maxx", "r_maxx"), "maxy": F.least("l_maxy", "r_maxy")}
    if exact:
        pairs = pairs.withColumn("piece", st_clip_box(F.col(GEOMETRY), *[F.col(f"r_{c}") for c in BOX]))
        part, whole = F.coalesce(st_area(F.col("piece")), F.lit(0.0)), st_area(F.col(GEOMETRY))
        point = point & st_holds(F.col(GEOMETRY), F.col("r_minx"), F.col("r_miny"))
    else:
        part = (shared["maxx"] - shared["minx"]) * (shared["maxy"] - shared["miny"])
        whole = (F.col("l_maxx") - F.col("l_minx")) * (F.col("l_maxy") - F.col("l_miny"))
    share = F.when(point, 1.0).otherwise(F.coalesce(F.try_divide(part, whole), F.lit(1.0)))
    pairs = pairs.withColumns({"share": share, **shared})
    best = [F.max("share").alias("share"), *[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]]]
    if exact and clip_to_area:
        best.append(F.collect_list("piece").alias("pieces"))  # one a box of the area that the region meets
    kept = written(pairs.groupBy("element_id").agg(*best).filter(F.col("share") > least_share), "boundaries")
    if not kept.limit(1).count():
        warnings.warn(f"no boundary of level {admin_level} meets the area", RuntimeWarning, stacklevel=2)
    named = own.withColumn("region_id", region_name(F.col("tags"), F.col("element_id"), prefer_english))
    keep = ["region_id", "element_id", *BOX] + [GEOMETRY] * exact
    if clip_to_area:
        cut = named.drop(*BOX).join(kept, "element_id")
        done = (cut.withColumn(GEOMETRY, st_merged(F.col("pieces"))) if exact else cut).select(*keep)
    else:
        done = named.join(kept, "element_id", "left_semi").select(*keep)
    if not fill_empty:
        return done
    from geoloom.operators.spatial_join import _box_wkb, remainder

    boxes = with_bounds(area).select(*BOX, _box_wkb("").alias(GEOMETRY)).withColumn("element_id", F.monotonically_increasing_id())
    shapes = done if exact else done.withColumn(GEOMETRY, _box_wkb(""))
    left = with_bounds(remainder(written(boxes, "areas").select("element_id", GEOMETRY), shapes.select(GEOMETRY), cell=cell, id_col="element_id"))
    kinds = dict(done.dtypes)
    empty = left.select(F.lit("EMPTY").alias("region_id"), F.lit(None).cast(kinds["element_id"]).alias("element_id"), *BOX, GEOMETRY)
    return done.unionByName(empty, allowMissingColumns=True)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def h3_regions(areas: DataFrame, resolution: int, buffer: bool = True) -> DataFrame:
    """H3 cells of WKB areas: region_id (text) and cell, each once.

    With ``buffer`` the cells that meet an area, else those whose centre an area holds. A point
    counts as the cell it lies in.
    """
    h3.check_res(resolution)

    def run(batches):
        import numpy as np
        import pandas as pd

        from geoloom.functions import geometry as G

        for batch in batches:
            out = []
            for raw in batch[GEOMETRY]:
                shape = G.from_wkb(bytes(raw))
                if shape[0] == "point":
                    xy = np.vstack([p[0] for p in shape[1]])
                    found = h3.cells_of(xy[:, 0], xy[:, 1], resolution).tolist()
                else:
                    found = list(h3.cover(shape, resolution, buffer))
                out += found
            yield pd.DataFrame([(h3.to_text(c), c) for c in out], columns=["region_id", "cell"])

    cells = explode_parts(areas.select(GEOMETRY)).mapInPandas(run, "region_id string, cell long")
    return cells.dropDuplicates(["cell"])


def h3_ring_buffer(cells: DataFrame, distance: int) -> DataFrame:
    """A set of H3 cells (cell) with all cells within ``distance`` steps: region_id and cell."""
    near = cells.select(F.explode(h3.h3_disk(F.col("cell"), distance)).alias("c")).select("c.cell").distinct()
    return near.select(h3.h3_text(F.col("cell")).alias("region_id"), "cell")


def h3_buffered_geometry(areas: DataFrame, resolution: int, distance: int) -> DataFrame:
    """The cells of WKB areas and those within ``distance`` steps of them."""
    return h3_ring_buffer(h3_regions(areas, resolution), distance)
