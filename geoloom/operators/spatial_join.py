"""Spatial joins as equi-joins on grid cells of several sizes.

Catalyst has no range join: an overlap of intervals alone plans as a nested loop. So every box lies
on the level of a grid whose cells are no smaller than the box, and the join is an equality on the cell
with the exact predicate as residual. Boxes of different levels meet on the larger one's level, where the
smaller one stands for the cells that hold it. The levels are those that the sizes of both tables' boxes
ask for. Each pair is reported only in the cell that holds the lower left corner of the boxes'
intersection, which saves a shuffle for removing duplicates. A cell that holds most of the rows is an
ordinary skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.overlay import st_clip, st_overlay, st_union_all
from geoloom.schema import BOX, FEATURE, GEOMETRY, REGION, need, with_bounds
from geoloom.storage import spread


#: Sizes are told apart by powers of two between these; levels of a grid at most.
_LEAST, _MOST, LEVELS = -20, 9, 5
#: Levels for points, which stand for one cell on each: more of them keep crowds of points from meeting much smaller boxes on large cells.
POINT_LEVELS = 8
#: Rows of a side up to which they may be sent to all tasks once they are multiplied.
FEW = 20_000


@dataclass(frozen=True)
class Ladder:
    """Cell sizes of a grid's levels in ascending order, and the levels that each side's boxes have as their own."""

    sizes: tuple[float, ...]
    left: frozenset[int]
    right: frozenset[int]
    #: Whether a side's rows, which are multiplied before they meet, are known to be few.
    few: tuple[bool, bool] | None = None

    def entries(self, left: bool) -> list[tuple[int, float, Column]]:
        """What a side's rows stand for: a key per level and kind of meeting, the level's size, and which rows (by ``_own``) it goes for.

        Own cells meet own cells, own cells those that hold smaller boxes, and the other way round; two small boxes never meet on a larger level.
        """
        mine, theirs = (self.left, self.right) if left else (self.right, self.left)
        own, out = F.col("_own"), []
        for k, size in enumerate(self.sizes):
            if k in mine and k in theirs:
                out.append((3 * k, size, own == k))
            if k in mine and any(t < k for t in theirs):
                out.append((3 * k + (1 if left else 2), size, own == k))
            if k in theirs and any(m < k for m in mine):
                out.append((3 * k + (2 if left else 1), size, own < k))
        return out


def _side() -> Column:
    return F.greatest(F.col("maxx").cast("double") - F.col("minx").cast("double"), F.col("maxy").cast("double") - F.col("miny").cast("double"))


def ladder(left: DataFrame, right: DataFrame, points: tuple[bool, bool] = (False, False), most: int = LEVELS) -> Ladder:
    """The levels for two tables of boxes, from one pass that notes which powers of two their boxes' sizes have (a bit each); a table that is known to hold ``points`` isn't read.

    From the largest down a size becomes a level if it is at least a step below the last one; a step
    is two powers, or more where over ``most`` levels would come of it. A box takes the least level not smaller than itself.
    """
    power = F.when(_side() <= 2.0**_LEAST, _LEAST).otherwise(F.least(F.lit(_MOST), F.ceil(F.log2(_side())).cast("int")))
    asked = [k for k, known in enumerate(points) if not known and not (k and right is left)]
    masks = {k: 1 for k, known in enumerate(points) if known}
    few: dict[int, bool] = {}
    if asked:
        sizes = [df.filter(F.col("minx").isNotNull()).select(F.lit(k).alias("side"), (power - _LEAST).alias("power")) for k, df in enumerate((left, right)) if k in asked]
        noted = functools.reduce(DataFrame.unionAll, sizes).agg(
            *[F.bit_or(F.when(F.col("side") == k, F.expr("shiftleft(1L, power)"))).alias(f"m{k}") for k in asked], *[F.count_if(F.col("side") == k).alias(f"n{k}") for k in asked]
        ).first()
        masks |= {k: noted[f"m{k}"] or 0 for k in asked}
        few |= {k: noted[f"n{k}"] <= FEW for k in asked}
    masks.setdefault(1, masks[0])  # a table joined with itself
    few = (few.get(0, False), few.get(1, few.get(0, False) if right is left else False))
    found = [(k, p) for k in (0, 1) for p in range(_LEAST, _MOST + 1) if masks[k] >> (p - _LEAST) & 1]
    powers = sorted({p for _, p in found}, reverse=True)
    if not powers:
        return Ladder((1.0,), frozenset({0}), frozenset({0}), few)
    step, levels = max(2, -(-(powers[0] - powers[-1]) // (most - 1))), powers[:1]
    for p in powers:
        if levels[-1] - p >= step:
            levels.append(p)
    levels = levels[::-1]
    own = [frozenset(next(k for k, size in enumerate(levels) if size >= p) for s, p in found if s == side) for side in (0, 1)]
    return Ladder(tuple(2.0**p for p in levels), *own, few)


def _apart(left: DataFrame, grid: Ladder) -> DataFrame:
    """The left side of a join of multiplied rows, which is kept from sending either side through the driver unless one is known to be small.

    The planner goes by the size of the files that rows come from and sees neither how well those are packed nor that rows were multiplied.
    """
    return left if grid.few is None or any(grid.few) else left.hint("merge")


def one_size(cell: float) -> Ladder:
    return Ladder((float(cell),), frozenset({0}), frozenset({0}))


def covered(df: DataFrame, grid: Ladder, prefix: str, *, left: bool, points: bool = False) -> DataFrame:
    """Each row once per grid cell it stands for: columns ``_k`` (level and kind), ``_size``, ``_cx``, ``_cy`` and prefixed boxes."""
    boxes = [F.col(c).cast("double").alias(f"{prefix}{c}") for c in BOX]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in BOX]
    own = F.lit(len(grid.sizes) - 1)
    for k in range(len(grid.sizes) - 2, -1, -1):
        own = F.when(_side() <= grid.sizes[k], k).otherwise(own)
    rows = df.filter(F.col("minx").isNotNull()).select(*rest, *boxes, own.alias("_own"))
    entries = grid.entries(left)
    if len(entries) == 1:
        key, size, which = entries[0]
        rows = rows.filter(which).withColumns({"_k": F.lit(key), "_size": F.lit(size)})
    else:
        own_entries = F.array_compact(F.array(*[F.when(which, F.struct(F.lit(key).alias("_k"), F.lit(size).alias("_size"))) for key, size, which in entries])) if entries else F.array().cast("array<struct<_k:int,_size:double>>")
        rows = rows.withColumn("_e", F.explode(own_entries)).withColumns({"_k": F.col("_e._k"), "_size": F.col("_e._size")}).drop("_e")
    if points:  # one cell each
        return rows.drop("_own").withColumns({f"_c{c}": F.floor(F.col(f"{prefix}min{c}") / F.col("_size")) for c in "xy"})
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("_size")), F.floor(F.col(hi) / F.col("_size")))
    return (
        rows.drop("_own")
        .withColumn("_cx", F.explode(span(f"{prefix}minx", f"{prefix}maxx")))
        .withColumn("_cy", F.explode(span(f"{prefix}miny", f"{prefix}maxy")))
    )


def boxes_meet(a: str = "l_", b: str = "r_") -> Column:
    """Closed boxes share a point."""
    return (
        (F.col(f"{a}minx") <= F.col(f"{b}maxx"))
        & (F.col(f"{b}minx") <= F.col(f"{a}maxx"))
        & (F.col(f"{a}miny") <= F.col(f"{b}maxy"))
        & (F.col(f"{b}miny") <= F.col(f"{a}maxy"))
    )


def only_points(df: DataFrame) -> bool:
    """Whether a table's boxes come from point columns."""
    return {"lon", "lat"} <= set(df.columns) and not all(c in df.columns for c in BOX)


def meeting(left: DataFrame, right: DataFrame, cell: float | None = None, points: tuple[bool, bool] = (False, False), grid: Ladder | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet, once each. ``cell`` asks for a grid of one size instead of one that fits the boxes; ``points`` tells which side is known to hold points."""
    grid = grid or (ladder(left, right, points) if cell is None else one_size(cell))
    l = covered(left, grid, "l_", left=True, points=points[0])
    r = covered(right, grid, "r_", left=False, points=points[1]).drop("_size")
    here = (F.col("_cx") == F.floor(F.greatest("l_minx", "r_minx") / F.col("_size"))) & (F.col("_cy") == F.floor(F.greatest("l_miny", "r_miny") / F.col("_size")))
    return _apart(l, grid).join(r, ["_k", "_cx", "_cy"]).filter(boxes_meet() & here)


def _narrow(df: DataFrame, id_col: str, geometry: str | None) -> DataFrame:
    keep = [id_col, *BOX]
    out = with_bounds(need(df, id_col))
    if geometry and GEOMETRY in df.columns:
        return out.select(*keep, F.col(GEOMETRY).alias(geometry))
    return out.select(*keep)


def intersects_join(
    regions: DataFrame,
    features: DataFrame,
    *,
    cell: float | None = None,
    region_id: str = REGION,
    feature_id: str = FEATURE,
    return_geometry: bool = False,
) -> DataFrame:
    """Pairs (region, feature) that share any point, boundaries included.

    Tables hold boxes (minx..maxy), points (lon, lat) or WKB in ``geometry``; with WKB on a side
    the exact predicate runs on pairs whose boxes meet. ``return_geometry`` adds the
    intersection: its box, and its WKB where a side has WKB (the regions being polygons).
    """
    both = GEOMETRY in regions.columns or GEOMETRY in features.columns
    l, r = _narrow(regions, region_id, "l_geometry"), _narrow(features, feature_id, "r_geometry")
    pairs = meeting(l, r, cell, (only_points(regions), only_points(features)))
    if both:
        side = {}
        for p in ("l_", "r_"):
            side[p] = F.col(f"{p}geometry") if f"{p}geometry" in pairs.columns else _box_wkb(p)
        pairs = spread(pairs).filter(G.st_intersects(side["l_"], side["r_"]))
    if not return_geometry:
        return pairs.select(region_id, feature_id)
    shared = [
        F.greatest("l_minx", "r_minx").alias("minx"), F.greatest("l_miny", "r_miny").alias("miny"),
        F.least("l_maxx", "r_maxx").alias("maxx"), F.least("l_maxy", "r_maxy").alias("maxy"),
    ]
    if not both:
        return pairs.select(region_id, feature_id, *shared)
    if "l_geometry" in pairs.columns:
        return pairs.select(region_id, feature_id, *shared, st_clip(side["r_"], side["l_"]).alias(GEOMETRY))
    return pairs.select(region_id, feature_id, *shared, G.st_clip_box(F.col("r_geometry"), *[F.col(f"l_{c}") for c in BOX]).alias(GEOMETRY))


def _box_wkb(prefix: str) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def make(a, b, c, d):
        import pandas as pd

        return pd.Series(G.boxes_wkb(*[v.to_numpy(float) for v in (a, b, c, d)]), dtype=object)

    make.__annotations__ = {}
    return make(*[F.col(f"{prefix}{c}") for c in BOX])


def within_join(points: DataFrame, regions: DataFrame, *, cell: float | None = None, region_id: str = REGION, how: str = "left") -> DataFrame:
    """Points with the region whose interior holds them; with ``how`` = "left" also the others.

    Regions are boxes or WKB polygons; for polygons the exact test runs on points inside their boxes.
    """
    exact = GEOMETRY in regions.columns
    boxes = with_bounds(regions).select(region_id, *BOX, *([F.col(GEOMETRY).alias("r_geometry")] if exact else []))
    grid = ladder(points, boxes, (True, False), POINT_LEVELS) if cell is None else one_size(cell)
    cells = covered(boxes, grid, "r_", left=False).drop("_size")
    mine = grid.entries(left=True)
    many = len(mine) > 1
    numbered = points.withColumn("_point", F.monotonically_increasing_id()) if how == "left" else points
    sizes = F.array(*[F.struct(F.lit(key).alias("_k"), F.lit(size).alias("_size")) for key, size, _ in mine])
    placed = (spread(numbered) if exact else numbered).withColumn("_e", F.explode(sizes) if many else F.get(sizes, F.lit(0)))
    placed = placed.withColumns({"_k": F.col("_e._k"), "_cx": F.floor(F.col("lon") / F.col("_e._size")), "_cy": F.floor(F.col("lat") / F.col("_e._size"))})
    inside = (F.col("lon") > F.col("r_minx")) & (F.col("lon") < F.col("r_maxx")) & (F.col("lat") > F.col("r_miny")) & (F.col("lat") < F.col("r_maxy"))
    l, r = _apart(placed, grid).alias("p"), cells.alias("c")
    here = (F.col("p._k") == F.col("c._k")) & (F.col("p._cx") == F.col("c._cx")) & (F.col("p._cy") == F.col("c._cy")) & inside
    own = [F.col(f"p.`{c}`") for c in points.columns]
    if not exact and (how != "left" or not many):
        return l.join(r, here, how).select(*own, F.col(f"c.{region_id}"))
    held = l.join(r, here)
    if exact:
        held = held.filter(G.st_holds(F.col("r_geometry"), F.col("lon"), F.col("lat")))
    if how != "left":
        return held.select(*own, F.col(f"c.{region_id}"))
    found = held.select(F.col("p._point").alias("_point"), F.col(f"c.{region_id}"))
    return numbered.join(found, "_point", "left").select(*points.columns, region_id)


def touches_join(regions: DataFrame, *, cell: float | None = None, region_id: str = REGION) -> DataFrame:
    """Adjacent regions: boundaries meet, corners included, and interiors don't."""
    exact = GEOMETRY in regions.columns
    side = _narrow(regions, region_id, "geometry" if exact else None)
    l = side.withColumnsRenamed({region_id: "region_id", "geometry": "l_geometry"})
    r = side.withColumnsRenamed({region_id: "neighbour_id", "geometry": "r_geometry"})
    grid = ladder(side, side) if cell is None else one_size(cell)
    pairs = meeting(l, r, grid=grid).filter("region_id <> neighbour_id")
    if exact:
        return spread(pairs).filter(G.st_touches(F.col("l_geometry"), F.col("r_geometry"))).select("region_id", "neighbour_id")
    edge = (F.greatest("l_minx", "r_minx") == F.least("l_maxx", "r_maxx")) | (F.greatest("l_miny", "r_miny") == F.least("l_maxy", "r_maxy"))
    return pairs.filter(edge).select("region_id", "neighbour_id")


def semi_join(rows: DataFrame, areas: DataFrame, *, cell: float | None = None, id_col: str, contained: bool = False) -> DataFrame:
    """Rows that meet any area (or, with ``contained``, lie within one), each once.

    Either side holds boxes, points or WKB; with WKB on a side the exact predicate runs on pairs whose boxes meet.
    """
    exact = GEOMETRY in rows.columns or GEOMETRY in areas.columns
    l = _narrow(rows, id_col, "l_geometry")
    r = with_bounds(areas).select(*BOX, *([F.col(GEOMETRY).alias("r_geometry")] if GEOMETRY in areas.columns else []))
    pairs = meeting(l, r, cell)
    if contained:
        pairs = pairs.filter("l_minx >= r_minx and l_maxx <= r_maxx and l_miny >= r_miny and l_maxy <= r_maxy")
    if exact:
        side = {p: F.col(f"{p}geometry") if f"{p}geometry" in pairs.columns else _box_wkb(p) for p in ("l_", "r_")}
        pairs = spread(pairs).filter((G.st_within if contained else G.st_intersects)(side["l_"], side["r_"]))
    return rows.join(pairs.select(id_col).distinct(), id_col, "left_semi")


def clip_points(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Points inside a box, boundary included: plain comparisons, which reach the scan."""
    return points.filter(F.col("lon").between(float(minx), float(maxx)) & F.col("lat").between(float(miny), float(maxy)))


def clip(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Geometries cut to a box; rows whose box lies outside are filtered before any decoding."""
    with_box = with_bounds(df)
    near = with_box.filter(f"minx <= {maxx!r} and maxx >= {minx!r} and miny <= {maxy!r} and maxy >= {miny!r}")
    cut = G.st_clip_box(F.col(GEOMETRY), *[F.lit(float(v)) for v in (minx, miny, maxx, maxy)])
    return near.withColumn(GEOMETRY, cut).filter(F.col(GEOMETRY).isNotNull()).select(*df.columns)


def clip_to(df: DataFrame, mask: G.Geometry) -> DataFrame:
    """Geometries cut to a polygon of any shape; rows whose box lies outside its box are filtered before any decoding."""
    minx, miny, maxx, maxy = G.bounds(mask)
    near = with_bounds(df).filter(f"minx <= {maxx!r} and maxx >= {minx!r} and miny <= {maxy!r} and maxy >= {miny!r}")
    cut = st_clip(F.col(GEOMETRY), F.lit(bytearray(G.to_wkb(mask))))
    return near.withColumn(GEOMETRY, cut).filter(F.col(GEOMETRY).isNotNull()).select(*df.columns)


def dissolve(df: DataFrame, key: str, *, parts: int = 64) -> DataFrame:
    """The union of each key's polygons: key and geometry.

    Shares of a key are united first, so one task never holds all shapes of a large key, only their unions.
    """
    share = F.pmod(F.xxhash64(GEOMETRY), F.lit(parts))
    some = df.filter(F.col(GEOMETRY).isNotNull()).groupBy(key, share.alias("_s")).agg(st_union_all(F.collect_list(GEOMETRY)).alias(GEOMETRY))
    return some.groupBy(key).agg(st_union_all(F.collect_list(GEOMETRY)).alias(GEOMETRY))


def remainder(areas: DataFrame, regions: DataFrame, *, cell: float | None = None, id_col: str = REGION) -> DataFrame:
    """What the regions leave of each area (WKB polygons): the areas with their geometry less all regions; nothing left drops the row."""
    pairs = meeting(_narrow(areas, id_col, "l_geometry"), with_bounds(regions).select(*BOX, F.col(GEOMETRY).alias("r_geometry")), cell)
    taken = dissolve(pairs.select(id_col, F.col("r_geometry").alias(GEOMETRY)), id_col).withColumnRenamed(GEOMETRY, "_taken")
    left = F.when(F.col("_taken").isNull(), F.col(GEOMETRY)).otherwise(st_overlay(F.col(GEOMETRY), F.col("_taken"), "difference"))
    done = areas.join(taken, id_col, "left").withColumn(GEOMETRY, left).filter(F.col(GEOMETRY).isNotNull())
    return done.select(*[c for c in areas.columns if c not in BOX])


def duplicate_places(seeds: DataFrame, id_col: str) -> DataFrame:
    """Ids of seeds that share their place with another."""
    places = seeds.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return seeds.join(places, ["lon", "lat"], "left_semi").select(id_col)
