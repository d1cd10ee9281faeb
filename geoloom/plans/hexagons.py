"""Queries: the H3 grid, against the same arithmetic in SQL for the face that holds the driver's places, and known cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import h3
from geoloom.operators import labels, neighbourhoods, regionalizers, spatial_join
from geoloom.plans.inputs import PTS, REGS, TRACKS, box_regions, points, query, table, track_points
from geoloom.storage import spread, written

#: All places of the input tables lie on this face and in this base cell.
FACE, BASE = 4, 15
RES = 8


def sql_h3(res: int, source: str = PTS) -> str:
    """CTEs over ``pts``: ``hexed`` with a and b (the lattice point on the face's plane) and region_id."""
    g = h3._geometry()
    dot = lambda v: " + ".join(f"p{c} * CAST({float(x)!r} AS DOUBLE)" for c, x in zip("xyz", v, strict=True))
    grow = h3.ROOT7**res / h3.UNIT
    c, s = (math.cos(h3.TURN), -math.sin(h3.TURN)) if res % 2 else (1.0, 0.0)
    num = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    steps = [
        "hp AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM pts)",
        f"hq AS (SELECT *, ({dot(g.x[FACE])}) / ({dot(g.centre[FACE])}) * {num(grow)} AS x, ({dot(g.y[FACE])}) / ({dot(g.centre[FACE])}) * {num(grow)} AS y FROM hp)",
        f"hr AS (SELECT * EXCLUDE (x, y), {num(c)} * x - {num(s)} * y AS x, {num(s)} * x + {num(c)} * y AS y FROM hq)",
        f"hu AS (SELECT *, x - y / {num(h3._SIN60)} / 2 AS u, y / {num(h3._SIN60)} AS v FROM hr)",
        "hw AS (SELECT *, round(u) AS ru, round(v) AS rv, round(-u - v) AS rw, abs(round(u) - u) AS du, abs(round(v) - v) AS dv, abs(round(-u - v) + u + v) AS dw FROM hu)",
        "hv AS (SELECT *, CASE WHEN du > dv AND du > dw THEN -rv - rw ELSE ru END AS fu, CASE WHEN NOT (du > dv AND du > dw) AND dv > dw THEN -ru - rw ELSE rv END AS fv FROM hw)",
        f"h{res} AS (SELECT feature_id, seg, value, lon, lat, CAST(fu + fv AS BIGINT) AS a, CAST(fv AS BIGINT) AS b, CAST(fu + fv AS BIGINT) AS a{res}, CAST(fv AS BIGINT) AS b{res} FROM hv)",
    ]
    table = [7] * 9
    for d, (i, j) in enumerate(h3._STEP.tolist()):
        table[(i + 1) * 3 + j + 1] = d
    for r in range(res, 0, -1):
        x, y = f"a{r}", f"b{r}"
        up = (f"3 * {x} - {y}", f"{x} + 2 * {y}") if r % 2 else (f"2 * {x} + {y}", f"3 * {y} - {x}")
        down = ("2 * {0} + {1}", "3 * {1} - {0}") if r % 2 else ("3 * {0} - {1}", "{0} + 2 * {1}")
        steps.append(f"g{r - 1} AS (SELECT *, CAST(round(CAST({up[0]} AS DOUBLE) / 7) AS BIGINT) AS a{r - 1}, CAST(round(CAST({up[1]} AS DOUBLE) / 7) AS BIGINT) AS b{r - 1} FROM h{r})")
        i, j = (f"{v} - ({d.format(f'a{r - 1}', f'b{r - 1}')})" for v, d in zip((x, y), down, strict=True))
        steps.append(f"h{r - 1} AS (SELECT *, CAST({table}[({i} + 1) * 3 + ({j}) + 2] AS BIGINT) AS d{r} FROM g{r - 1})")
    turn = list(range(8))
    a0, b0 = h3._geometry().home_axial[BASE].tolist() if h3._geometry().home[BASE] == FACE else (0, 0)
    for _ in range(int(g.rots[FACE, a0 + 2, b0 + 2])):
        turn = [int(h3._CCW[t]) for t in turn]
    bits = " + ".join(f"(CAST({turn}[d{r} + 1] AS BIGINT) << {3 * (15 - r)})" for r in range(1, res + 1))
    fixed = (1 << 59) + (res << 52) + (BASE << 45) + (1 << 3 * (15 - res)) - 1
    steps.append(f"hexed AS (SELECT feature_id, seg, value, lon, lat, a, b, format('{{:x}}', CAST({fixed} AS BIGINT) + {bits}) AS region_id FROM h0)")
    return f"{source}, " + ", ".join(steps)


def _hexed(spark, sf_dir, res=RES):
    return spread(points(spark, sf_dir)).withColumn("cell", h3.h3_cell(F.col("lon"), F.col("lat"), res))


def _cells(spark, sf_dir, res=RES):
    return _hexed(spark, sf_dir, res).select("cell").distinct()


_FAR = "greatest(abs(y.a - x.a), abs(y.b - x.b), abs((y.a - x.a) - (y.b - x.b)))"
_DISTINCT = "c AS (SELECT DISTINCT region_id, a, b FROM hexed)"
_EVERYWHERE = (16.79, 51.03, 17.19, 51.22)


@query("j2a_h3_cells", f"WITH {sql_h3(9)} SELECT feature_id, region_id FROM hexed")
def j2a_h3_cells(spark, sf_dir):
    return _hexed(spark, sf_dir, 9).select("feature_id", h3.h3_text(F.col("cell")).alias("region_id"))


@query("j2_h3_regions", f"WITH {sql_h3(RES)} SELECT region_id, count(*) AS n FROM hexed GROUP BY region_id")
def j2_h3_regions(spark, sf_dir):
    area = spark.createDataFrame([(bytearray(G.to_wkb(G.box(*_EVERYWHERE))),)], "geometry binary")
    return regionalizers.h3_regions(area, RES).join(_hexed(spark, sf_dir), "cell").groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


@query("j2_h3_shapes", f"""WITH {PTS}, {REGS} SELECT region_id AS area, count(*) AS points, true AS covered FROM pts JOIN regs ON lon > minx AND lon < maxx AND lat > miny AND lat < maxy GROUP BY region_id""")
def j2_h3_shapes(spark, sf_dir):
    """The cells that cover each area hold all its places; cells by centre are among them."""
    areas = box_regions(spark, sf_dir)
    shapes = areas.select("region_id", spatial_join._box_wkb("").alias("geometry"))
    cover, by_centre = (regionalizers.h3_regions(shapes, RES, b).select("cell", F.lit(True).alias(name)) for b, name in ((True, "meets"), (False, "centred")))
    extra = by_centre.join(cover, "cell", "left_anti").select("cell", F.lit(True).alias("stray"))
    inside = spatial_join.within_join(points(spark, sf_dir).select("feature_id", "lon", "lat"), areas, how="inner").withColumn("cell", h3.h3_cell(F.col("lon"), F.col("lat"), RES))
    met = inside.join(cover, "cell", "left").join(extra, "cell", "left")
    good = F.coalesce("meets", F.lit(False)) & F.col("stray").isNull()
    return met.groupBy(F.col("region_id").alias("area")).agg(F.count(F.lit(1)).alias("points"), F.min(good).alias("covered"))


@query("j2b_h3_polygons", f"WITH {sql_h3(RES)} SELECT region_id, 6 AS corners, count(*) AS points FROM hexed GROUP BY region_id")
def j2b_h3_polygons(spark, sf_dir):
    shapes = written(_cells(spark, sf_dir).select(h3.h3_text(F.col("cell")).alias("region_id"), h3.h3_polygon(F.col("cell")).alias("geometry")), "cells")
    text = G.st_as_wkt(F.col("geometry"))
    corners = shapes.select("region_id", (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).cast("int").alias("corners"))
    held = spatial_join.within_join(points(spark, sf_dir).select("feature_id", "lon", "lat"), shapes, cell=0.02, how="inner")
    return held.groupBy("region_id").agg(F.count(F.lit(1)).alias("points")).join(corners, "region_id")


@query("j2c_local_ij", f"WITH {sql_h3(RES)}, {_DISTINCT} SELECT region_id, '-1:-1,-1:0,0:-1,0:1,1:0,1:1' AS around FROM c")
def j2c_local_ij(spark, sf_dir):
    """The local coordinates of each cell's six neighbours."""
    near = _cells(spark, sf_dir).select("cell", F.explode(h3.h3_disk(F.col("cell"), 1)).alias("n")).filter("n.distance = 1")
    ij = near.withColumn("ij", h3.h3_local_ij(F.col("cell"), F.col("n.cell")))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "ij.i", "ij.j"))), ",")
    return ij.groupBy(h3.h3_text(F.col("cell")).alias("region_id")).agg(text.alias("around"))


@query("j2d_h3_disks", f"WITH {sql_h3(RES)}, {_DISTINCT} SELECT region_id, CAST(d AS INTEGER) AS distance, CASE WHEN d = 0 THEN 1 ELSE 6 * d END AS n FROM c, (SELECT unnest([0, 1, 2, 3]) AS d)")
def j2d_h3_disks(spark, sf_dir):
    near = _cells(spark, sf_dir).select(h3.h3_text(F.col("cell")).alias("region_id"), F.explode(h3.h3_disk(F.col("cell"), 3)).alias("c"))
    return near.groupBy("region_id", "c.distance").agg(F.count(F.lit(1)).alias("n"))


@query("j2d_h3_ring_buffer", f"""WITH {sql_h3(RES)}, {_DISTINCT}, o AS (SELECT a.v AS da, b.v AS db FROM (SELECT unnest([-1, 0, 1]) AS v) a, (SELECT unnest([-1, 0, 1]) AS v) b WHERE abs(a.v - b.v) <= 1)
SELECT count(*) AS cells, min(inside) AS inside FROM (SELECT DISTINCT a + da AS a, b + db AS b, 1 AS inside FROM c, o)""")
def j2d_h3_ring_buffer(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    grown = regionalizers.h3_ring_buffer(cells, 1)
    own = cells.join(grown.select("cell", F.lit(1).alias("one")), "cell", "left")
    return grown.agg(F.count(F.lit(1)).alias("cells")).crossJoin(own.agg(F.min(F.coalesce("one", F.lit(0))).alias("inside")))


@query("j2e_buffered_geometry", "SELECT d AS distance, CAST(count(*) * (3 * d * (d + 1) + 1) AS BIGINT) AS cells FROM nation, (SELECT unnest([0, 1, 4]) AS d) GROUP BY d")
def j2e_buffered_geometry(spark, sf_dir):
    """The rings around a place of each nation, which lie apart."""
    n = F.col("n_nationkey")
    lon, lat = F.lit(16.8) + (n % 5) * 0.07, F.lit(51.05) + F.floor(n / 5) * 0.03
    spots = table(spark, sf_dir, "nation").select(G.st_point(lon, lat).alias("geometry"))
    out = None
    for d in (0, 1, 4):
        part = regionalizers.h3_buffered_geometry(spots, 10, d).agg(F.lit(d).alias("distance"), F.count(F.lit(1)).alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


@query("j2f_h3_parents", f"WITH {sql_h3(5)} SELECT region_id AS parent, count(*) AS n FROM hexed GROUP BY region_id")
def j2f_h3_parents(spark, sf_dir):
    """Parents of each place's own cell at resolution 5, by bits, from the cells' children's centres."""
    cells = _hexed(spark, sf_dir, 5).withColumn("centre", h3.h3_centre(F.col("cell")))
    fine = cells.select(h3.h3_cell(F.col("centre.lon"), F.col("centre.lat"), 9).alias("fine"))
    return fine.groupBy(h3.h3_text(h3.h3_parent(F.col("fine"), 5)).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("j2g_h3_paths", f"""WITH {sql_h3(RES)} SELECT x.feature_id, x.region_id AS start, y.region_id AS stop, {_FAR} + 1 AS cells
FROM hexed x JOIN hexed y ON y.feature_id = x.feature_id + 1""")
def j2g_h3_paths(spark, sf_dir):
    h = _hexed(spark, sf_dir)
    pairs = h.select("feature_id", "cell").join(h.select((F.col("feature_id") - 1).alias("feature_id"), F.col("cell").alias("to")), "feature_id")
    done = pairs.select("feature_id", h3.h3_path(F.col("cell"), F.col("to")).alias("p"))
    return done.select("feature_id", h3.h3_text(F.get("p", F.lit(0))).alias("start"), h3.h3_text(F.element_at("p", -1)).alias("stop"), F.size("p").cast("long").alias("cells"))


@query("d10_h3_counts", f"WITH {sql_h3(RES)} SELECT region_id, CAST(count(*) AS DOUBLE) AS label FROM hexed GROUP BY region_id")
def d10_h3_counts(spark, sf_dir):
    return labels.hex_labels(points(spark, sf_dir), resolution=RES)


@query("l6_h3_neighbours", f"WITH {sql_h3(RES)}, {_DISTINCT} SELECT x.region_id, y.region_id AS neighbour_id, CAST({_FAR} AS INTEGER) AS distance FROM c x JOIN c y ON {_FAR} <= 2")
def l6_h3_neighbours(spark, sf_dir):
    return neighbourhoods.h3_edges(_cells(spark, sf_dir), 2)


_STOPS = f"{TRACKS}, pts AS (SELECT event_id AS feature_id, '' AS seg, value, lon, lat FROM tracks)"


@query("m6_h3_patches", f"""WITH {sql_h3(7, _STOPS)}, c AS (SELECT region_id, a, b, count(*) AS n FROM hexed GROUP BY ALL),
e AS (SELECT x.region_id, y.n, {_FAR} AS d FROM c x JOIN c y ON {_FAR} <= 2)
SELECT region_id, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(CASE WHEN d = 0 THEN n END) AS DOUBLE) AS middle FROM e GROUP BY region_id HAVING count(*) = 19""")
def m6_h3_patches(spark, sf_dir):
    from geoloom.operators.neural import GeoVex

    placed = track_points(spark, sf_dir).select(h3.h3_cell(F.col("lon"), F.col("lat"), 7).alias("cell"))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    patches = GeoVex(radius=2).h3_patches(counts)
    total = F.aggregate("patch", F.lit(0.0), lambda t, x: t + x)
    return patches.select(h3.h3_text(F.col("cell")).alias("region_id"), total.alias("total"), F.get("patch", F.lit(9)).alias("middle"))
