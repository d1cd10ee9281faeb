"""Trajectories: points to trips, trips to cell sequences.

A trip is worked on in order, but not by one task: one of more than ``part_rows`` points is cut into ranges
of its order, which are solved alone; a second pass over a row per range tells each what the others leave at its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import grid
from geoloom.operators.splits import sequence_split
from geoloom.storage import written


#: Points of a trip that one task handles in order.
PART_ROWS = 1_000_000


def parted(points: DataFrame, *, trip: str, order: str, part_rows: int = PART_ROWS, bound: DataFrame | None = None) -> DataFrame | None:
    """The points with ``_part``, ranges of the order within a trip of about ``part_rows`` points each; None if no trip is longer.

    Points are counted first, and by trip if they are more than one part holds (partial sums before the shuffle). Only those that are too long get cuts: quantiles of their
    own order from one sketch per trip. Every trip gets as many cuts as the longest one needs. ``bound`` may be a table
    that is cheaper to read and has no fewer rows of any trip, such as the points that cells were made of.
    """
    bound = points if bound is None else bound
    if bound.count() <= part_rows:
        return None
    counted = bound.groupBy(trip).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_rows)
    most = counted.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    parts = -(-most // part_rows)
    long = bound.join(written(counted.select(trip), "long_trips"), trip, "left_semi")
    cuts = long.groupBy(trip).agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * parts).alias("_cuts"))
    marked = points.join(written(cuts, "cuts"), trip, "left")
    return marked.withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(_below(F.col("_cuts"), F.col(order), parts - 1))).drop("_cuts")


def _below(cuts: Column, value: Column, most: int) -> Column:
    """How many of ascending cuts (``most`` at most) lie below a value: halved step by step, so a row looks at few of them; 0 for a null value."""
    step, steps = 1, []
    while step <= most:
        steps.append(step)
        step *= 2
    sure = lambda at, k: F.coalesce(F.get(cuts, at + k - 1) < value, F.lit(False))
    return F.aggregate(F.array(*[F.lit(k) for k in steps[::-1]]), F.lit(0), lambda at, k: F.when(sure(at, k), at + k).otherwise(at)) if steps else F.lit(0)


def _by_part(parts: DataFrame, trip: str, ends: list[Column], sums: list[Column]) -> DataFrame:
    """One row per trip and part: the given aggregates, made before anything is shuffled, and written."""
    return written(parts.groupBy(trip, "_part").agg(*ends, *sums), "parts")


def build(points: DataFrame, *, trip: str, order: str, columns: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """One row per trip: its points as an array of structs in time order; single points are dropped.

    A trip of more than ``part_rows`` points is sorted by parts, whose arrays are then put together.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    parts = parted(points, trip=trip, order=order, part_rows=part_rows)
    return _together(points if parts is None else parts, trip, rows, parts is not None).filter(F.size("points") > 1)


def _together(rows: DataFrame, trip: str, array: Column, by_part: bool) -> DataFrame:
    if not by_part:
        return rows.groupBy(trip).agg(array.alias("points"))
    parts = rows.groupBy(trip, "_part").agg(array.alias("points"))
    ordered = F.array_sort(F.collect_list(F.struct("_part", "points")))
    return parts.groupBy(trip).agg(F.flatten(F.transform(ordered, lambda p: p["points"])).alias("points"))


def to_cells(points: DataFrame, *, trip: str, order: str, zoom: int, metric: str | None = None, tie: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Points with their tile, consecutive repeats removed: trip, order, x, y (and the metric).

    Parts of a long trip are solved alone; each then learns the last cell of the part before it.
    """
    keep = [trip, order] + ([metric] if metric else []) + ([tie] if tie else [])
    sorts = [order, *([tie] if tie else [])]
    parts = parted(points, trip=trip, order=order, part_rows=part_rows)
    source = points.select(*keep, "lon", "lat") if parts is None else parts.select(*keep, "lon", "lat", "_part")
    placed = source.select(*keep, *(["_part"] if parts is not None else []), grid.tile_x(F.col("lon"), zoom).alias("x"), grid.tile_y(F.col("lat"), zoom).alias("y"))
    w = Window.partitionBy(trip, *(["_part"] if parts is not None else [])).orderBy(*sorts)
    before = placed.withColumn("_x", F.lag("x").over(w)).withColumn("_y", F.lag("y").over(w))
    if parts is not None:
        last = F.max_by(F.struct("x", "y"), F.struct(*sorts)).alias("_last")
        ends = _by_part(placed, trip, [last], [])
        ends = ends.select(trip, "_part", F.lag("_last").over(Window.partitionBy(trip).orderBy("_part")).alias("_end"))
        before = before.join(ends, [trip, "_part"], "left")
        before = before.withColumns({"_x": F.coalesce("_x", "_end.x"), "_y": F.coalesce("_y", "_end.y")})
    return before.filter("_x is null or x <> _x or y <> _y").select(*keep, "x", "y")


def fill_gaps(cells: DataFrame, *, trip: str, order: str, tie: str | None = None, repeat_last: bool = True, part_rows: int = PART_ROWS, points: DataFrame | None = None) -> DataFrame:
    """Cells with the grid path put in between: trip, seq, and the columns of ``cells``.

    Path cells carry the values of their segment's start, the segment's end cell included when
    the path reaches it; then the last cell follows once more with its own values unless
    ``repeat_last`` is off. Parts of a long trip learn from the others what lies next to them and how many cells come before.
    ``points``, if given, are those the cells were made of: they tell sooner than the cells whether a trip is long.
    """
    sorts = [order, *([tie] if tie else [])]
    parts = parted(cells, trip=trip, order=order, part_rows=part_rows, bound=points)
    w = Window.partitionBy(trip, *(["_part"] if parts is not None else [])).orderBy(*sorts)
    seen = (cells if parts is None else parts).withColumns({"_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w), "_after": F.lead("x", 2).over(w), "_px": F.lag("x").over(w)})
    if parts is not None:
        near = _by_part(parts, trip, [F.min_by(F.struct("x", "y"), F.struct(*sorts)).alias("_first"), F.count(F.lit(1)).alias("_rows")], [])
        by_trip = Window.partitionBy(trip).orderBy("_part")
        later = F.coalesce(F.sum("_rows").over(by_trip.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
        near = near.select(trip, "_part", F.lead("_first").over(by_trip).alias("_next"), later.alias("_later"), F.lag("_first.x").over(by_trip).alias("_prior"))
        end = F.col("_nx").isNull()  # of the part
        after = F.when(F.col("_after").isNull() & (F.coalesce("_later", F.lit(0)) >= F.when(end, 2).otherwise(1)), F.col("x")).otherwise(F.col("_after"))  # only whether there is one counts
        seen = seen.join(near, [trip, "_part"], "left").withColumn("_after", after)
        seen = seen.withColumns({"_nx": F.coalesce("_nx", "_next.x"), "_ny": F.coalesce("_ny", "_next.y"), "_px": F.coalesce("_px", "_prior")}).drop("_next", "_later", "_prior")
    last, alone = F.col("_nx").isNull(), F.col("_px").isNull()
    steps = F.when(~last, grid.path(F.col("x"), F.col("y"), F.col("_nx"), F.col("_ny")))
    # A segment's end is the next one's start: every path but the last gives it up.
    own, none = F.array(F.struct("x", "y")), F.array().cast("array<struct<x:bigint,y:bigint>>")
    tail = own if repeat_last else F.when(alone, own).otherwise(none)
    cut = F.when(last, tail).when(F.col("_after").isNull(), steps).otherwise(F.slice(steps, 1, F.size(steps) - 1))
    # All windows share one order, so a part is sorted once; places follow from the paths' sizes.
    before = F.coalesce(F.sum(F.size("_p").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = [c for c in cells.columns if c not in ("x", "y")]
    paths = seen.withColumn("_p", cut)
    out = paths.withColumn("_b", before)
    if parts is not None:
        sizes = _by_part(paths, trip, [], [F.sum(F.size("_p").cast("long")).alias("_cells")])
        start = F.coalesce(F.sum("_cells").over(by_trip.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.join(sizes.select(trip, "_part", start.alias("_start")), [trip, "_part"], "left").withColumn("_b", F.col("_b") + F.coalesce("_start", F.lit(0)))
    out = out.select(*rest, "_b", F.posexplode("_p").alias("_j", "_c"))
    return out.select(*rest, F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), (F.col("_b") + F.col("_j") + 1).cast("int").alias("seq"))


def sequences(filled: DataFrame, *, trip: str, zoom: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Cell sequences per trip, as ids in order; those of long trips are sorted by parts of ``part_rows`` places."""
    part = ((F.col("seq") - 1) / part_rows).cast("int").alias("_part")
    cell = F.struct("seq", grid.tile_id(F.col("x"), F.col("y"), zoom).alias("cell"))
    parts = filled.groupBy(trip, part).agg(F.array_sort(F.collect_list(cell)).alias("points"))
    ordered = F.array_sort(F.collect_list(F.struct("_part", "points")))
    return parts.groupBy(trip).agg(F.transform(F.flatten(F.transform(ordered, lambda p: p["points"])), lambda c: c["cell"]).alias("cells"))


def duration_seconds(times: Column) -> Column:
    """Last minus first of an array of timestamps; 0 for fewer than two."""
    span = F.unix_micros(F.array_max(times).cast("timestamp")) - F.unix_micros(F.array_min(times).cast("timestamp"))
    return F.when(F.size(times) < 2, F.lit(0.0)).otherwise(span / 1e6)


def mobility_task(trips: DataFrame, cells: str = "cells") -> DataFrame:
    """Next-location task: 85 % of the sequence to predict from, the rest to predict; both non-empty."""
    head, tail = sequence_split(F.col(cells))
    return trips.withColumns({"x_cells": head, "y_cells": tail}).filter("size(x_cells) > 0 and size(y_cells) > 0")


def travel_time_task(trips: DataFrame, cells: str = "cells", duration: str = "duration") -> DataFrame:
    """Travel-time task: non-empty sequences of positive duration."""
    return trips.filter((F.size(cells) > 0) & (F.col(duration) > 0))


def line_lengths(points: DataFrame, *, trip: str, order: str, tie: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Planar length in degrees per trip, from consecutive points; the steps between parts of a long trip are added from the parts' ends."""
    sorts = [order, *([tie] if tie else [])]
    parts = parted(points, trip=trip, order=order, part_rows=part_rows)
    far = lambda dx, dy: F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    w = Window.partitionBy(trip, *(["_part"] if parts is not None else [])).orderBy(*sorts)
    step = far(F.col("lon") - F.lag("lon").over(w), F.col("lat") - F.lag("lat").over(w))
    if parts is None:
        return points.withColumn("_d", step).groupBy(trip).agg(F.sum("_d").alias("length"))
    place, at = F.struct("lon", "lat"), F.struct(*sorts)
    own = parts.withColumn("_d", step).groupBy(trip, "_part")
    ends = own.agg(F.sum("_d").alias("_d"), F.min_by(place, at).alias("_first"), F.max_by(place, at).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(trip).orderBy("_part"))
    joined = ends.withColumn("_before", before).withColumn("_d", F.col("_d") + far(F.col("_first.lon") - F.col("_before.lon"), F.col("_first.lat") - F.col("_before.lat")))
    return joined.groupBy(trip).agg(F.sum("_d").alias("length"))
