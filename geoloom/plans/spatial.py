"""Queries: tiles, spatial joins, neighbourhoods, embeddings over regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import grid, s2, scalars
from geoloom.operators import embedders, neighbourhoods, regionalizers, spatial_join
from geoloom.plans.inputs import (
    BOXES, PTS, REGS, TAGS, box_features, box_regions, points, query, sql_id, sql_tiled, sql_x, sql_y, table, tagged, tiled,
)

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ZOOM = 12
_COUNTS = ", ".join(f"CAST(coalesce(sum(CASE WHEN seg = '{s}' THEN 1 END), 0) AS INTEGER) AS seg_{s}" for s in SEGMENTS)


def _regions(spark, sf_dir, zoom=ZOOM):
    return tiled(spark, sf_dir, zoom).select("region_id", "x", "y").distinct()


def _joint(spark, sf_dir, zoom=ZOOM):
    return tiled(spark, sf_dir, zoom).select("region_id", "feature_id")


@query("tile_category_counts", f"WITH {sql_tiled(ZOOM)} SELECT region_id, {_COUNTS} FROM tiled GROUP BY region_id")
def tile_category_counts(spark, sf_dir):
    f = tiled(spark, sf_dir, ZOOM)
    counts = f.groupBy("region_id").pivot("seg", SEGMENTS).count().na.fill(0)
    return counts.select("region_id", *[F.col(s).cast("int").alias(f"seg_{s}") for s in SEGMENTS])


@query("j1_slippy_regions", f"""
WITH RECURSIVE {REGS}, a AS (SELECT {sql_x('minx', 12)} AS x0, {sql_x('maxx', 12)} AS x1, {sql_y('maxy', 12)} AS y0, {sql_y('miny', 12)} AS y1 FROM regs),
t AS (SELECT unnest(generate_series(x0, x1)) AS x, y0, y1 FROM a), u AS (SELECT x, unnest(generate_series(y0, y1)) AS y FROM t)
SELECT DISTINCT {sql_id('x', 'y', 12)} AS region_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, 12 AS z,
  round(CAST(x AS DOUBLE) / CAST(4096 AS DOUBLE) * CAST(360 AS DOUBLE) - CAST(180 AS DOUBLE), 6) AS minx FROM u""")
def j1_slippy_regions(spark, sf_dir):
    return regionalizers.slippy_regions(box_regions(spark, sf_dir), 12).select("region_id", "x", "y", "z", F.round("minx", 6).alias("minx"))


@query("j1a_point_tiles", f"WITH {PTS} SELECT feature_id, {sql_x('lon', 14)} AS x, {sql_y('lat', 14)} AS y FROM pts")
def j1a_point_tiles(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("feature_id", grid.tile_x(F.col("lon"), 14).alias("x"), grid.tile_y(F.col("lat"), 14).alias("y"))


@query("j1b_tile_corners", f"""WITH {sql_tiled(10)}
SELECT DISTINCT region_id, round(CAST(x AS DOUBLE) / CAST(1024 AS DOUBLE) * CAST(360 AS DOUBLE) - CAST(180 AS DOUBLE), 6) AS lon,
  round(degrees(atan(sinh(pi() * (CAST(1 AS DOUBLE) - CAST(y AS DOUBLE) * CAST(2 AS DOUBLE) / CAST(1024 AS DOUBLE))))), 6) AS lat FROM tiled""")
def j1b_tile_corners(spark, sf_dir):
    t = tiled(spark, sf_dir, 10)
    return t.select("region_id", F.round(grid.tile_lon(F.col("x"), 10), 6).alias("lon"), F.round(grid.tile_lat(F.col("y"), 10), 6).alias("lat")).distinct()


@query("j2d_ring_buffer", f"""WITH {sql_tiled(ZOOM)}, d AS (SELECT unnest([-1, 0, 1]) AS v), c AS (SELECT DISTINCT x, y FROM tiled)
SELECT DISTINCT CAST(c.x + a.v AS BIGINT) AS x, CAST(c.y + b.v AS BIGINT) AS y, {sql_id('c.x + a.v', 'c.y + b.v', ZOOM)} AS region_id FROM c, d a, d b""")
def j2d_ring_buffer(spark, sf_dir):
    t = tiled(spark, sf_dir, ZOOM).select("x", "y").distinct()
    return regionalizers.ring_buffer(t, 1, ZOOM)


@query("j2f_parent_cells", f"""WITH {sql_tiled(14)} SELECT {sql_id('x >> 4', 'y >> 4', 10)} AS parent, count(*) AS n FROM tiled GROUP BY ALL""")
def j2f_parent_cells(spark, sf_dir):
    t = tiled(spark, sf_dir, 14)
    return t.groupBy(grid.tile_parent(F.col("x"), F.col("y"), 14, 4).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("j2g_grid_path", f"""WITH {sql_tiled(ZOOM)},
p AS (SELECT a.feature_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, greatest(abs(b.x - a.x), abs(b.y - a.y)) AS n
      FROM tiled a JOIN tiled b ON b.feature_id = a.feature_id + 1),
s AS (SELECT *, unnest(generate_series(0, n)) AS i FROM p)
SELECT feature_id, CAST(i AS BIGINT) AS step,
  CAST(x0 + floor(CAST(2 * i * (x1 - x0) + n AS DOUBLE) / CAST(2 * greatest(n, 1) AS DOUBLE)) AS BIGINT) AS x,
  CAST(y0 + floor(CAST(2 * i * (y1 - y0) + n AS DOUBLE) / CAST(2 * greatest(n, 1) AS DOUBLE)) AS BIGINT) AS y FROM s""")
def j2g_grid_path(spark, sf_dir):
    a = tiled(spark, sf_dir, ZOOM).select("feature_id", "x", "y")
    b = a.select((F.col("feature_id") - 1).alias("feature_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    steps = F.posexplode(grid.path(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))).alias("step", "c")
    return a.join(b, "feature_id").select("feature_id", steps).select("feature_id", F.col("step").cast("long").alias("step"), "c.x", "c.y")


@query("j3a_s2_children", """
WITH c AS (SELECT r_regionkey, CAST(1152921504606846976 AS BIGINT) + CAST(r_regionkey AS BIGINT) * 72057594037927936 * 2 AS cell FROM region),
k AS (SELECT *, unnest(generate_series(0, 15)) AS n FROM (SELECT r_regionkey, ((cell >> 57) << 57) | (CAST(1 AS BIGINT) << 56) AS cell FROM c))
SELECT r_regionkey, cell AS parent, cell - ((CAST(1 AS BIGINT) << 56) - (CAST(1 AS BIGINT) << 52)) + n * 2 * (CAST(1 AS BIGINT) << 52) AS child FROM k""")
def j3a_s2_children(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", (F.lit(1 << 60) + F.col("r_regionkey").cast("long") * F.lit(1 << 57)).alias("cell"))
    r = r.select("r_regionkey", s2.s2_parent(F.col("cell"), 2).alias("parent"))
    return r.select("r_regionkey", "parent", F.explode(s2.s2_children(F.col("parent"), 2, 4)).alias("child"))


@query("j4_voronoi_assignment", f"""WITH {PTS}, seeds AS (SELECT n_nationkey AS region_id, CAST(168100 + (n_nationkey * 1511) % 3700 AS DOUBLE) / CAST(10000 AS DOUBLE) AS slon,
  CAST(510450 + (n_nationkey * 677) % 1650 AS DOUBLE) / CAST(10000 AS DOUBLE) AS slat FROM nation),
d AS (SELECT feature_id, region_id, round(2.0 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(slat - lat) / 2) * sin(radians(slat - lat) / 2)
  + cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) * sin(radians(slon - lon) / 2)))), 6) AS d FROM pts, seeds),
r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY d, region_id) AS rn FROM d)
SELECT region_id, count(*) AS n FROM r WHERE rn = 1 GROUP BY region_id""")
def j4_voronoi_assignment(spark, sf_dir):
    n = F.col("n_nationkey")
    seeds = table(spark, sf_dir, "nation").select(n.alias("region_id"), ((F.lit(168100) + (n * 1511) % 3700) / F.lit(10000.0)).alias("lon"), ((F.lit(510450) + (n * 677) % 1650) / F.lit(10000.0)).alias("lat"))
    return regionalizers.voronoi_assign(points(spark, sf_dir), seeds).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


@query("c1_points_in_boxes", f"""WITH {PTS}, {REGS} SELECT region_id, feature_id FROM regs JOIN pts
ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy""")
def c1_points_in_boxes(spark, sf_dir):
    return spatial_join.intersects_join(box_regions(spark, sf_dir), points(spark, sf_dir).select("feature_id", "lon", "lat"))


_MEET = "r.minx <= b.maxx AND b.minx <= r.maxx AND r.miny <= b.maxy AND b.miny <= r.maxy"


@query("c1_boxes_meet_boxes", f"WITH {BOXES}, {REGS} SELECT region_id, feature_id FROM regs r JOIN boxes b ON {_MEET}")
def c1_boxes_meet_boxes(spark, sf_dir):
    return spatial_join.intersects_join(box_regions(spark, sf_dir), box_features(spark, sf_dir))


@query("c2_overlay_boxes", f"""WITH {BOXES}, {REGS} SELECT region_id, feature_id, greatest(r.minx, b.minx) AS minx, greatest(r.miny, b.miny) AS miny,
least(r.maxx, b.maxx) AS maxx, least(r.maxy, b.maxy) AS maxy FROM regs r JOIN boxes b ON {_MEET}""")
def c2_overlay_boxes(spark, sf_dir):
    return spatial_join.intersects_join(box_regions(spark, sf_dir), box_features(spark, sf_dir), return_geometry=True)


@query("c3_cells_in_area", f"""WITH {BOXES}, a AS (SELECT * FROM (VALUES (CAST(16.85 AS DOUBLE), CAST(51.06 AS DOUBLE), CAST(17.0 AS DOUBLE), CAST(51.15 AS DOUBLE))) v(x0, y0, x1, y1))
SELECT feature_id FROM boxes, a WHERE minx >= x0 AND maxx <= x1 AND miny >= y0 AND maxy <= y1""")
def c3_cells_in_area(spark, sf_dir):
    area = spark.createDataFrame([(16.85, 51.06, 17.0, 51.15)], "minx double, miny double, maxx double, maxy double")
    return spatial_join.semi_join(box_features(spark, sf_dir), area, id_col="feature_id", contained=True).select("feature_id")


@query("c5_points_within", f"""WITH {PTS}, {REGS} SELECT feature_id, region_id FROM pts LEFT JOIN regs
ON lon > minx AND lon < maxx AND lat > miny AND lat < maxy""")
def c5_points_within(spark, sf_dir):
    return spatial_join.within_join(points(spark, sf_dir), box_regions(spark, sf_dir)).select("feature_id", "region_id")


@query("c6_clip_points", f"WITH {PTS} SELECT feature_id, lon, lat FROM pts WHERE lon BETWEEN CAST(16.9 AS DOUBLE) AND CAST(17 AS DOUBLE) AND lat BETWEEN CAST(51.1 AS DOUBLE) AND CAST(51.15 AS DOUBLE)")
def c6_clip_points(spark, sf_dir):
    return spatial_join.clip_points(points(spark, sf_dir), 16.9, 51.1, 17.0, 51.15).select("feature_id", "lon", "lat")


@query("c13_duplicate_seeds", """WITH s AS (SELECT o_orderkey AS id, o_custkey % 997 AS lon, o_custkey % 89 AS lat FROM orders)
SELECT id FROM s JOIN (SELECT lon, lat FROM s GROUP BY lon, lat HAVING count(*) > 1) USING (lon, lat)""")
def c13_duplicate_seeds(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 997).alias("lon"), (F.col("o_custkey") % 89).alias("lat"))
    return spatial_join.duplicate_places(s, "id")


_TOUCH = """SELECT a.region_id, b.region_id AS neighbour_id FROM regs a JOIN regs b ON a.region_id <> b.region_id
AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy
AND (greatest(a.minx, b.minx) = least(a.maxx, b.maxx) OR greatest(a.miny, b.miny) = least(a.maxy, b.maxy))"""


@query("c14_touching_regions", f"WITH {REGS} {_TOUCH}")
def c14_touching_regions(spark, sf_dir):
    return spatial_join.touches_join(box_regions(spark, sf_dir))


_EDGES = f"e AS (SELECT a.region_id, b.region_id AS neighbour_id, CAST(greatest(abs(a.x - b.x), abs(a.y - b.y)) AS INTEGER) AS distance FROM r a JOIN r b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2)"
_R = f"{sql_tiled(13)}, r AS (SELECT DISTINCT region_id, x, y FROM tiled)"


def _edges(spark, sf_dir, k=2):
    return neighbourhoods.tile_edges(_regions(spark, sf_dir, 13), k, 13)


@query("l6_tile_neighbours", f"WITH {_R}, {_EDGES} SELECT * FROM e")
def l6_tile_neighbours(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("l1_direct_neighbours", f"WITH {_R}, {_EDGES} SELECT region_id, count(*) AS n FROM e WHERE distance = 1 GROUP BY region_id")
def l1_direct_neighbours(spark, sf_dir):
    return _edges(spark, sf_dir, 1).filter("distance = 1").groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


_BFS = f"""WITH RECURSIVE {REGS}, e AS ({_TOUCH}),
b(region_id, neighbour_id, d) AS (SELECT region_id, region_id, 0 FROM regs UNION SELECT b.region_id, e.neighbour_id, b.d + 1 FROM b JOIN e ON e.region_id = b.neighbour_id WHERE b.d < 3),
m AS (SELECT region_id, neighbour_id, min(d) AS distance FROM b GROUP BY ALL)"""


@query("l2_up_to_distance", f"{_BFS} SELECT region_id, neighbour_id, CAST(distance AS INTEGER) AS distance FROM m WHERE distance > 0")
def l2_up_to_distance(spark, sf_dir):
    return neighbourhoods.up_to_distance(neighbourhoods.adjacency_edges(box_regions(spark, sf_dir)), 3)


@query("l3_at_distance", f"{_BFS} SELECT region_id, neighbour_id, CAST(distance AS INTEGER) AS distance FROM m WHERE distance = 2")
def l3_at_distance(spark, sf_dir):
    return neighbourhoods.at_distance(neighbourhoods.adjacency_edges(box_regions(spark, sf_dir)), 2)


@query("l4_with_center", f"{_BFS} SELECT region_id, count(*) AS n FROM m WHERE distance <= 2 GROUP BY region_id")
def l4_with_center(spark, sf_dir):
    found = neighbourhoods.up_to_distance(neighbourhoods.adjacency_edges(box_regions(spark, sf_dir)), 2, include_center=True)
    return found.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


@query("l5_adjacency", f"WITH {REGS} SELECT *, 1 AS distance FROM ({_TOUCH})")
def l5_adjacency(spark, sf_dir):
    return neighbourhoods.adjacency_edges(box_regions(spark, sf_dir))




@query("m1_count_embedding", f"""WITH {sql_tiled(ZOOM)}, {TAGS}, t AS (SELECT tags.*, {sql_id(sql_x('lon', ZOOM), sql_y('lat', ZOOM), ZOOM)} AS region_id FROM tags),
r AS (SELECT DISTINCT region_id FROM tiled)
SELECT r.region_id, CAST(count(brand) AS INTEGER) AS brand, CAST(count(size) AS INTEGER) AS size FROM r LEFT JOIN t USING (region_id) GROUP BY r.region_id""")
def m1_count_embedding(spark, sf_dir):
    f = tagged(spark, sf_dir)
    joint = f.select(grid.tile_of(F.col("lon"), F.col("lat"), ZOOM).alias("region_id"), "feature_id")
    return embedders.count_embedding(_regions(spark, sf_dir), f.select("feature_id", "brand", "size"), joint, subcategories=False)


@query("d1_one_hot_counts", f"""WITH {sql_tiled(ZOOM)} SELECT r.region_id, {', '.join(f"CAST(coalesce(sum(CASE WHEN seg = '{s}' THEN 1 END), 0) AS INTEGER) AS seg_{s}" for s in SEGMENTS)}
FROM (SELECT DISTINCT region_id FROM tiled) r LEFT JOIN (SELECT * FROM tiled WHERE feature_id % 3 = 0) t USING (region_id) GROUP BY r.region_id""")
def d1_one_hot_counts(spark, sf_dir):
    f = points(spark, sf_dir).filter("feature_id % 3 = 0").select("feature_id", "seg")
    return embedders.count_embedding(_regions(spark, sf_dir), f, _joint(spark, sf_dir), expected=[f"seg_{s}" for s in SEGMENTS])


@query("d2_non_null_counts", f"""WITH {TAGS}, t AS (SELECT *, {sql_id(sql_x('lon', ZOOM), sql_y('lat', ZOOM), ZOOM)} AS region_id FROM tags)
SELECT region_id, CAST(count(brand) AS INTEGER) AS brand, CAST(count(size) AS INTEGER) AS size FROM t GROUP BY region_id""")
def d2_non_null_counts(spark, sf_dir):
    f = tagged(spark, sf_dir)
    joint = f.select(grid.tile_of(F.col("lon"), F.col("lat"), ZOOM).alias("region_id"), "feature_id")
    return embedders.count_embedding(joint.select("region_id").distinct(), f.select("feature_id", "brand", "size"), joint, subcategories=False)


@query("d3_flag_counts", f"""WITH {TAGS}, t AS (SELECT *, {sql_id(sql_x('lon', ZOOM), sql_y('lat', ZOOM), ZOOM)} AS region_id FROM tags)
SELECT region_id, CAST(sum(CAST(dear AS INTEGER)) AS INTEGER) AS dear FROM t GROUP BY region_id""")
def d3_flag_counts(spark, sf_dir):
    f = tagged(spark, sf_dir)
    joint = f.select(grid.tile_of(F.col("lon"), F.col("lat"), ZOOM).alias("region_id"), "feature_id")
    return embedders.count_embedding(joint.select("region_id").distinct(), f.select("feature_id", "dear"), joint, subcategories=False)


def _tile_counts(spark, sf_dir):
    t = tiled(spark, sf_dir, 13)
    return t.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("seg") == "BUILDING").cast("int")).alias("b"))


_TC = f"{_R}, {_EDGES}, c AS (SELECT region_id, count(*) AS n, sum(CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END) AS b FROM tiled GROUP BY region_id)"


def _agg_sql(fn: str) -> str:
    def part(c: str, d: int) -> str:
        return f"coalesce({fn}(CASE WHEN e.distance = {d} THEN CAST(k.{c} AS DOUBLE) END), 0)"

    g = f"g AS (SELECT e.region_id, {', '.join(f'{part(c, d)} AS {c}{d}' for c in 'nb' for d in (1, 2))} FROM e JOIN c k ON k.region_id = e.neighbour_id WHERE e.distance BETWEEN 1 AND 2 GROUP BY e.region_id)"
    return f"WITH {_TC}, {g}"


for _name, _fn in (("average", "avg"), ("median", "median"), ("sum", "sum"), ("min", "min"), ("max", "max")):

    def _make(name=_name):
        def run(spark, sf_dir):
            out = embedders.contextual_embedding(_tile_counts(spark, sf_dir), _edges(spark, sf_dir), 2, aggregation=name)
            return out.select("region_id", F.round("n", 6).alias("n"), F.round("b", 6).alias("b"))

        return run

    query(f"m2_contextual_{_name}", f"""{_agg_sql(_fn)} SELECT c.region_id, round(c.n + coalesce(n1, 0) / 4.0 + coalesce(n2, 0) / 9.0, 6) AS n,
round(c.b + coalesce(b1, 0) / 4.0 + coalesce(b2, 0) / 9.0, 6) AS b FROM c LEFT JOIN g USING (region_id)""")(_make())


@query("d4b_concatenated_levels", f"""{_agg_sql('avg')} SELECT c.region_id, CAST(c.n AS DOUBLE) AS n_0, CAST(c.b AS DOUBLE) AS b_0, round(coalesce(n1, 0), 6) AS n_1,
round(coalesce(b1, 0), 6) AS b_1, round(coalesce(n2, 0), 6) AS n_2, round(coalesce(b2, 0), 6) AS b_2 FROM c LEFT JOIN g USING (region_id)""")
def d4b_concatenated_levels(spark, sf_dir):
    out = embedders.contextual_embedding(_tile_counts(spark, sf_dir), _edges(spark, sf_dir), 2, concatenate=True)
    return out.select("region_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "region_id"])


@query("m5a_neighbour_pairs", f"WITH {_R}, {_EDGES} SELECT region_id AS anchor, neighbour_id AS positive FROM e WHERE distance = 1")
def m5a_neighbour_pairs(spark, sf_dir):
    return embedders.neighbour_pairs(_edges(spark, sf_dir))


_PLACE = "CAST(concat('0x', substr(md5({}), 1, 12)) AS BIGINT) % (SELECT greatest(1, count(*) // 2) FROM r)"


@query("m5a_negative_samples", f"""WITH {_R}, {_EDGES}, p AS (SELECT region_id AS anchor, neighbour_id AS positive, {_PLACE.format("concat(region_id, '|', neighbour_id, '|0')")} AS home FROM e WHERE distance = 1),
ring AS (SELECT region_id AS negative, md5(concat(region_id, '|0')) AS mark, {_PLACE.format("concat(region_id, '|0')")} AS slot FROM r), n AS (SELECT greatest(1, count(*) // 2) AS slots FROM r),
o AS (SELECT anchor, positive, negative, row_number() OVER (PARTITION BY anchor, positive ORDER BY (slot - home + slots) % slots, mark) AS rn FROM p, ring, n
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.region_id = p.anchor AND e.neighbour_id = ring.negative)) SELECT anchor, positive, negative FROM o WHERE rn = 1""")
def m5a_negative_samples(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return embedders.negative_samples(_regions(spark, sf_dir, 13), edges, embedders.neighbour_pairs(edges))


@query("m6a_valid_patches", f"WITH {_R}, {_EDGES} SELECT region_id FROM e GROUP BY region_id HAVING count(*) = 25")
def m6a_valid_patches(spark, sf_dir):
    return embedders.valid_patches(_edges(spark, sf_dir), 2, 25)


@query("m6b_patch_weights", """WITH h AS (SELECT c_custkey, CAST(c_custkey % 7 - 3 AS INTEGER) AS q, CAST(c_custkey // 7 % 7 - 3 AS INTEGER) AS r FROM customer),
d AS (SELECT *, CAST((abs(q) + abs(r) + abs(q + r)) / 2 AS INTEGER) AS distance FROM h)
SELECT c_custkey, q, r, distance, round(CASE WHEN distance <= 3 THEN 1.0 / (distance + 1) ELSE 0 END, 6) AS w_dist,
round(CASE WHEN distance > 3 THEN 0 WHEN distance = 0 THEN 1 ELSE 1.0 / (6 * distance) END, 6) AS w_num FROM d""")
def m6b_patch_weights(spark, sf_dir):
    k = F.col("c_custkey")
    cells = table(spark, sf_dir, "customer").select(k, (k % 7 - 3).cast("int").alias("q"), (F.floor(k / 7) % 7 - 3).cast("int").alias("r"))
    d = cells.withColumn("distance", grid.hex_distance(F.lit(0), F.lit(0), F.col("q"), F.col("r")))
    a, b = scalars.hex_patch_weights(F.col("distance"), 3)
    return d.select("c_custkey", "q", "r", "distance", F.round(a, 6).alias("w_dist"), F.round(b, 6).alias("w_num"))


@query("c16_patches_of_images", f"""WITH {sql_tiled(8)}, i AS (SELECT DISTINCT region_id AS img_id, x, y FROM tiled), s AS (SELECT unnest(generate_series(0, 3)) AS v)
SELECT img_id, {sql_id('x * 4 + a.v', 'y * 4 + b.v', 10)} AS patch_id FROM i, s a, s b""")
def c16_patches_of_images(spark, sf_dir):
    i = tiled(spark, sf_dir, 8).select(F.col("region_id").alias("img_id"), "x", "y").distinct()
    near = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return i.withColumn("s", near).select("img_id", grid.tile_id(F.col("x") * 4 + F.col("s.a"), F.col("y") * 4 + F.col("s.b"), 10).alias("patch_id"))


@query("f2_patch_order", f"""WITH {sql_tiled(10)}, p AS (SELECT DISTINCT {sql_id('x >> 2', 'y >> 2', 8)} AS img_id, region_id, x, y FROM tiled)
SELECT img_id, region_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY y, x) AS INTEGER) AS place FROM p""")
def f2_patch_order(spark, sf_dir):
    from pyspark.sql import Window

    t = tiled(spark, sf_dir, 10)
    p = t.select(grid.tile_parent(F.col("x"), F.col("y"), 10, 2).alias("img_id"), "region_id", "x", "y").distinct()
    p = regionalizers.tile_boxes(p, 10)
    return p.select("img_id", "region_id", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("maxy"), "minx")).alias("place"))


@query("n12_neighbourhood_plot_table", f"""{_BFS} SELECT regs.region_id, CAST(m.distance AS INTEGER) AS distance,
CASE WHEN m.distance = 0 THEN 'selected' WHEN m.distance IS NOT NULL THEN 'neighbour' ELSE 'other' END AS tag
FROM regs LEFT JOIN m ON m.region_id = 12 AND m.neighbour_id = regs.region_id AND m.distance <= 1""")
def n12_neighbourhood_plot_table(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    out = neighbourhoods.plot_table(r, neighbourhoods.adjacency_edges(r), 12, 1)
    return out.select("region_id", "distance", "tag")


@query("n13_map_zoom", f"WITH {REGS} SELECT round(12.5 - ln(greatest(max(maxx) - min(minx), max(maxy) - min(miny)) * 111), 6) AS zoom FROM regs")
def n13_map_zoom(spark, sf_dir):
    e = box_regions(spark, sf_dir).agg(*[f(c).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))])
    return e.select(F.round(scalars.map_zoom(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]), 6).alias("zoom"))


@query("hex_axial_counts")
def hex_axial_counts(spark, sf_dir):
    p = points(spark, sf_dir).select(grid.hex_cell(F.col("lon") * 0.63, F.col("lat"), 0.01).alias("h"))
    return p.groupBy("h.q", "h.r").agg(F.count(F.lit(1)).alias("n"))


@query("c4_edges_in_area", f"WITH {BOXES} SELECT feature_id FROM boxes WHERE maxx >= CAST(16.9 AS DOUBLE) AND minx <= CAST(17.1 AS DOUBLE) AND maxy >= CAST(51.05 AS DOUBLE) AND miny <= CAST(51.1 AS DOUBLE)")
def c4_edges_in_area(spark, sf_dir):
    area = spark.createDataFrame([(16.9, 51.05, 17.1, 51.1)], "minx double, miny double, maxx double, maxy double")
    return spatial_join.semi_join(box_features(spark, sf_dir), area, id_col="feature_id").select("feature_id")


def _double_boxes(spark, sf_dir):
    """Each supplier's box and a copy ten degrees east, as one WKB multipolygon."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def make(a, b, c, d):
        import pandas as pd

        from geoloom.functions import geometry as G

        return pd.Series([G.to_wkb(G.merged([G.box(x, y, z, w), G.box(x + 10, y, z + 10, w)])) for x, y, z, w in zip(a, b, c, d, strict=True)], dtype=object)

    return box_features(spark, sf_dir).select("feature_id", make("minx", "miny", "maxx", "maxy").alias("geometry"))


@query("j6_exploded_multipolygons", f"WITH {BOXES} SELECT feature_id, round((maxx - minx) * (maxy - miny), 9) AS area FROM boxes UNION ALL SELECT feature_id, round((maxx - minx) * (maxy - miny), 9) FROM boxes")
def j6_exploded_multipolygons(spark, sf_dir):
    from geoloom.functions.geometry import st_area

    return regionalizers.explode_parts(_double_boxes(spark, sf_dir)).select("feature_id", F.round(st_area(F.col("geometry")), 9).alias("area"))


@query("k4_merged_polygons", f"WITH {BOXES} SELECT feature_id, round(2 * (maxx - minx) * (maxy - miny), 9) AS area FROM boxes")
def k4_merged_polygons(spark, sf_dir):
    from geoloom.functions.geometry import st_area, st_without_holes

    return _double_boxes(spark, sf_dir).select("feature_id", F.round(st_area(st_without_holes(F.col("geometry"))), 9).alias("area"))


@query("d4_neighbour_sums", f"WITH {_TC} SELECT e.region_id, CAST(sum(k.n) AS BIGINT) AS n FROM e JOIN c k ON k.region_id = e.neighbour_id WHERE e.distance = 1 GROUP BY e.region_id")
def d4_neighbour_sums(spark, sf_dir):
    c = _tile_counts(spark, sf_dir).select(F.col("region_id").alias("neighbour_id"), "n")
    return _edges(spark, sf_dir, 1).filter("distance = 1").join(c, "neighbour_id").groupBy("region_id").agg(F.sum("n").alias("n"))
