"""Queries: filters, joins, aggregations, sets and scalar rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from geoloom.functions import grid, road, scalars
from geoloom.operators import embedders, filters, regionalizers
from geoloom.plans.inputs import PTS, TAGS, points, query, sql_tiled, table, tagged, tiled


@query("a16_multi_scan_quantile_filter", """WITH a AS (SELECT l_orderkey AS k, l_extendedprice AS v FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders),
q AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM a) SELECT k, v FROM a, q WHERE v BETWEEN lo AND hi""")
def a16_multi_scan_quantile_filter(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return filters.within_quantiles(a.unionByName(b), F.col("v"))


@query("a19_popular_tags", """WITH t AS (SELECT p_brand AS key, p_type AS value, count(*) AS n FROM part GROUP BY ALL)
SELECT key, string_agg(value, ',' ORDER BY value) AS vals FROM t WHERE n >= 2 AND n * 1.0 / (SELECT count(*) FROM part) >= 0.0 GROUP BY key""")
def a19_popular_tags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    total = p.count()
    t = p.groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("value")).agg(F.count(F.lit(1)).alias("count_all"))
    t = t.withColumns({"count_all_fraction": F.col("count_all") / total, "in_wiki": F.lit(True)})
    return filters.popular_tags(t, in_wiki_only=True, min_count=2).select("key", F.array_join("values", ",").alias("vals"))


@query("b1_bounds_filter", f"WITH {PTS} SELECT feature_id FROM pts WHERE lon > CAST(16.85 AS DOUBLE) AND lon < CAST(17.05 AS DOUBLE) AND lat > CAST(51.06 AS DOUBLE) AND lat < CAST(51.18 AS DOUBLE)")
def b1_bounds_filter(spark, sf_dir):
    return filters.in_bounds(points(spark, sf_dir), (16.85, 17.05), (51.06, 51.18)).select("feature_id")


@query("b2_quantile_filter", """WITH q AS (SELECT quantile_cont(c_acctbal, 0.1) AS lo, quantile_cont(c_acctbal, 0.9) AS hi FROM customer)
SELECT c_custkey, c_acctbal FROM customer, q WHERE c_acctbal BETWEEN lo AND hi""")
def b2_quantile_filter(spark, sf_dir):
    return filters.within_quantiles(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal"), 0.1, 0.9)


@query("b5_drop_empty_columns", f"WITH {TAGS} SELECT feature_id, brand, size FROM tags")
def b5_drop_empty_columns(spark, sf_dir):
    f = tagged(spark, sf_dir).select("feature_id", "size", "brand", F.lit(None).cast("string").alias("nothing"))
    return filters.drop_empty_columns(f)


@query("b6_tag_mask", f"WITH {TAGS} SELECT feature_id FROM tags WHERE coalesce(brand IN ('Brand#11', 'Brand#12', 'Brand#23'), false) OR coalesce(size = 'size1', false)")
def b6_tag_mask(spark, sf_dir):
    f = tagged(spark, sf_dir)
    return f.filter(filters.tag_mask(f, {"brand": ["Brand#11", "Brand#12", "Brand#23"], "size": "size1", "absent": True})).select("feature_id")


@query("b7_first_tag", f"WITH {TAGS} SELECT feature_id, CASE WHEN size IN ('size1', 'size2') THEN concat('size=', size) WHEN brand IS NOT NULL THEN concat('brand=', brand) END AS tag FROM tags")
def b7_first_tag(spark, sf_dir):
    f = tagged(spark, sf_dir)
    return f.select("feature_id", filters.first_tag(f, {"size": ["size1", "size2"], "brand": True}).alias("tag"))


@query("b8_feature_groups", f"""WITH {TAGS}, g AS (SELECT feature_id, CASE WHEN brand IS NOT NULL THEN concat('brand=', brand) END AS make,
CASE WHEN size IN ('size1', 'size3') THEN concat('size=', size) END AS odd FROM tags) SELECT * FROM g WHERE make IS NOT NULL OR odd IS NOT NULL""")
def b8_feature_groups(spark, sf_dir):
    f = tagged(spark, sf_dir)
    return filters.group_features(f, {"make": {"brand": True}, "odd": {"size": ["size1", "size3"]}, "none": {"brand": "no such"}})


@query("b9_membership", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def b9_membership(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.members(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), ids, "l_orderkey")


@query("b10_fixed_columns", f"WITH {sql_tiled(12)} SELECT region_id, count(*) AS n, 0 AS absent FROM tiled GROUP BY region_id")
def b10_fixed_columns(spark, sf_dir):
    t = tiled(spark, sf_dir, 12).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("extra"))
    return filters.fixed_columns(t, ["n", "absent"], ["region_id"])


@query("b13_non_null", f"WITH {TAGS} SELECT feature_id, brand FROM tags WHERE brand IS NOT NULL")
def b13_non_null(spark, sf_dir):
    return tagged(spark, sf_dir).filter(F.col("brand").isNotNull()).select("feature_id", "brand")


def _encodings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") % 3).cast("int").alias("e"))


@query("c7_joint_with_encodings", """SELECT l_suppkey AS region_id, sum(CAST(p_size % 3 AS BIGINT)) AS e FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def c7_joint_with_encodings(spark, sf_dir):
    joint = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region_id"), F.col("l_partkey").alias("feature_id"))
    return joint.join(_encodings(spark, sf_dir), "feature_id", "left").groupBy("region_id").agg(F.sum("e").alias("e"))


@query("c8_complete_regions", """WITH a AS (SELECT l_suppkey AS region_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY l_suppkey)
SELECT s_suppkey AS region_id, CAST(coalesce(n, 0) AS INTEGER) AS n FROM supplier LEFT JOIN a ON region_id = s_suppkey""")
def c8_complete_regions(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49").groupBy(F.col("l_suppkey").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("region_id"))
    return r.join(a, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


_STOP = "l_suppkey AS stop_id, l_orderkey AS trip_id, concat(CAST((l_linenumber * 5 + l_orderkey) % 27 AS VARCHAR), ':15:00') AS departure"
_HOUR = "(CAST(replace(substr(departure, 1, 2), ':', '') AS INTEGER) % 24)"
_GTFS = f"""st AS (SELECT {_STOP} FROM lineitem), tr AS (SELECT o_orderkey AS trip_id, concat('to ', o_orderpriority) AS headsign FROM orders),
h AS (SELECT stop_id, trip_id, CAST({_HOUR} AS INTEGER) AS hour FROM st)"""


def _stop_times(spark, sf_dir):
    hour = ((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 27).cast("string")
    st = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stop_id"), F.col("l_orderkey").alias("trip_id"), F.concat(hour, F.lit(":15:00")).alias("departure"))
    return st.select("stop_id", "trip_id", scalars.gtfs_hour(F.col("departure")).alias("hour"))


def _trips(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.concat(F.lit("to "), "o_orderpriority").alias("headsign"))


@query("c10_gtfs_star", f"WITH {_GTFS} SELECT h.stop_id, headsign, hour, count(*) AS n FROM h JOIN tr USING (trip_id) JOIN supplier ON s_suppkey = h.stop_id GROUP BY ALL")
def c10_gtfs_star(spark, sf_dir):
    stops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop_id"))
    j = _stop_times(spark, sf_dir).join(_trips(spark, sf_dir), "trip_id").join(stops, "stop_id")
    return j.groupBy("stop_id", "headsign", "hour").agg(F.count(F.lit(1)).alias("n"))


@query("h1_gtfs_hour", f"WITH {_GTFS} SELECT hour, count(*) AS n FROM h GROUP BY hour")
def h1_gtfs_hour(spark, sf_dir):
    return _stop_times(spark, sf_dir).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


_HOURS = [6, 7, 8, 9]


@query("d6_hour_pivots", f"""WITH {_GTFS}, c AS (SELECT stop_id, trip_id, hour, count(*) AS n FROM h GROUP BY ALL)
SELECT stop_id, {', '.join(f"round(coalesce(avg(CASE WHEN hour = {k} THEN n END), 0), 6) AS trips_at_{k}" for k in _HOURS)},
{', '.join(f"string_agg(DISTINCT CASE WHEN hour = {k} THEN headsign END, ',' ORDER BY CASE WHEN hour = {k} THEN headsign END) AS directions_at_{k}" for k in _HOURS)}
FROM c JOIN tr USING (trip_id) GROUP BY stop_id""")
def d6_hour_pivots(spark, sf_dir):
    c = _stop_times(spark, sf_dir).groupBy("stop_id", "trip_id", "hour").agg(F.count(F.lit(1)).alias("n")).join(_trips(spark, sf_dir), "trip_id")
    at = lambda k, v: F.when(F.col("hour") == k, F.col(v))
    sets = {f"directions_at_{k}": F.array_join(F.array_sort(F.collect_set(at(k, "headsign"))), ",") for k in _HOURS}
    return c.groupBy("stop_id").agg(*[F.round(F.coalesce(F.avg(at(k, "n")), F.lit(0.0)), 6).alias(f"trips_at_{k}") for k in _HOURS], *[F.nullif(v, F.lit("")).alias(k) for k, v in sets.items()])


@query("m3_gtfs_features", f"""WITH {_GTFS}, t AS (SELECT s_suppkey AS stop_id, concat('r', CAST(s_nationkey AS VARCHAR)) AS region_id FROM supplier),
j AS (SELECT region_id, hour, headsign FROM h JOIN tr USING (trip_id) JOIN t USING (stop_id)),
a AS (SELECT region_id, {', '.join(f'sum(CASE WHEN hour = {k} THEN 1 ELSE 0 END) AS t{k}, count(DISTINCT CASE WHEN hour = {k} THEN headsign END) AS d{k}' for k in _HOURS)} FROM j GROUP BY region_id),
m AS (SELECT {', '.join(f"min(least({', '.join(f'{v}{k}' for k in _HOURS)})) AS {v}lo, max(greatest({', '.join(f'{v}{k}' for k in _HOURS)})) AS {v}hi" for v in 'td')} FROM a)
SELECT region_id, {', '.join(f"round((CAST({v}{k} AS DOUBLE) - {v}lo) / ({v}hi - {v}lo), 6) AS {n}_at_{k}" for v, n in (('t', 'trips'), ('d', 'directions')) for k in _HOURS)} FROM a, m""")
def m3_gtfs_features(spark, sf_dir):
    hit = _stop_times(spark, sf_dir).join(_trips(spark, sf_dir), "trip_id")
    at = lambda k, v: F.when(F.col("hour") == k, v)
    stops = hit.groupBy("stop_id").agg(
        *[F.sum(F.coalesce(at(k, F.lit(1)), F.lit(0))).alias(f"trips_at_{k}") for k in _HOURS], *[F.collect_set(at(k, F.col("headsign"))).alias(f"directions_at_{k}") for k in _HOURS]
    )
    joint = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), F.col("s_nationkey").cast("string")).alias("region_id"), F.col("s_suppkey").alias("stop_id"))
    served = joint.join(stops.select("stop_id"), "stop_id", "left_semi").select("region_id").distinct()
    out = embedders.gtfs_features(served, stops, joint, feature_id="stop_id")
    return out.select("region_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "region_id"])


@query("d5_gtfs_region_sums", f"""WITH {_GTFS} SELECT CAST(s_nationkey AS BIGINT) AS region_id, count(*) AS trips, count(DISTINCT headsign) AS directions
FROM h JOIN tr USING (trip_id) JOIN supplier ON s_suppkey = stop_id GROUP BY s_nationkey""")
def d5_gtfs_region_sums(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_nationkey").cast("long").alias("region_id"))
    per = _stop_times(spark, sf_dir).join(_trips(spark, sf_dir), "trip_id").groupBy("stop_id", "headsign").agg(F.count(F.lit(1)).alias("trips"))
    ways = per.join(s, "stop_id").groupBy("region_id", "headsign").agg(F.sum("trips").alias("trips"))
    return ways.groupBy("region_id").agg(F.sum("trips").alias("trips"), F.count("headsign").alias("directions"))


@query("d7_first_non_null", f"""WITH {TAGS}, u AS (SELECT 0 AS part, feature_id, brand, size FROM tags WHERE feature_id % 2 = 0 UNION ALL SELECT 1, feature_id, 'late', 'late' FROM tags WHERE feature_id % 4 = 0)
SELECT feature_id, arg_min(brand, part) FILTER (brand IS NOT NULL) AS brand, arg_min(size, part) FILTER (size IS NOT NULL) AS size FROM u GROUP BY feature_id""")
def d7_first_non_null(spark, sf_dir):
    t = tagged(spark, sf_dir).select("feature_id", "brand", "size", F.col("feature_id").alias("no"))
    late = t.filter("feature_id % 4 = 0").withColumns({"brand": F.lit("late"), "size": F.lit("late")})
    return filters.merge_scans([t.filter("feature_id % 2 = 0"), late], ["feature_id"], "no")


_ROAD = """road AS (SELECT o_orderkey AS edge_id, ['2', '3.7', '17', 'a', '', '-1'][1 + CAST(o_orderkey % 6 AS INTEGER)] AS lanes,
['30 mph', '45', '44', '46', 'signals', '4.5 km/h', '250', '6', 'CZ:pedestrian_zone', '3mph'][1 + CAST(o_orderkey % 10 AS INTEGER)] AS maxspeed,
['12m', '4.4', '25.4ft', '130.4''', '31', 'x'][1 + CAST(o_orderkey % 6 AS INTEGER)] AS width FROM orders)"""
_ZONES = {"CZ:pedestrian_zone": 20}


def _roads(spark, sf_dir):
    pick = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("o_orderkey") % len(vs) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge_id"),
        pick(["2", "3.7", "17", "a", "", "-1"]).alias("lanes"),
        pick(["30 mph", "45", "44", "46", "signals", "4.5 km/h", "250", "6", "CZ:pedestrian_zone", "3mph"]).alias("maxspeed"),
        pick(["12m", "4.4", "25.4ft", "130.4'", "31", "x"]).alias("width"),
    )


@query("h5_lanes", f"""WITH {_ROAD}, v AS (SELECT edge_id, CAST(trunc(TRY_CAST(nullif(lanes, '') AS DOUBLE)) AS INTEGER) AS x FROM road)
SELECT edge_id, CASE WHEN x IS NULL THEN 'None' ELSE CAST(least(x, 15) AS VARCHAR) END AS lanes FROM v""")
def h5_lanes(spark, sf_dir):
    return _roads(spark, sf_dir).select("edge_id", road.lanes(F.col("lanes")).alias("lanes"))


@query("h6_maxspeed", f"""WITH {_ROAD}, t AS (SELECT edge_id, CASE WHEN maxspeed IN ('signals', 'variable') THEN NULL WHEN maxspeed = 'CZ:pedestrian_zone' THEN '20' ELSE maxspeed END AS s FROM road),
v AS (SELECT edge_id, TRY_CAST(trim(replace(replace(s, 'km/h', ''), 'mph', '')) AS DOUBLE) * CASE WHEN contains(s, 'mph') THEN CAST(1.609344 AS DOUBLE) ELSE 1 END AS x FROM t)
SELECT edge_id, CASE WHEN x IS NULL THEN 'None' WHEN x <= 0 THEN '0' WHEN x <= 5 THEN '5' WHEN x <= 7 THEN '7' WHEN x <= 10 THEN '10' WHEN x <= 15 THEN '15'
ELSE CAST(CAST(least(round_even(x / 10, 0) * 10, 200) AS INTEGER) AS VARCHAR) END AS maxspeed FROM v""")
def h6_maxspeed(spark, sf_dir):
    return _roads(spark, sf_dir).select("edge_id", road.maxspeed(F.col("maxspeed"), _ZONES).alias("maxspeed"))


@query("h7_width", f"""WITH {_ROAD}, v AS (SELECT edge_id, TRY_CAST(trim(replace(replace(replace(width, 'm', ''), '''', ''), 'ft', '')) AS DOUBLE)
* CASE WHEN contains(width, '''') THEN CAST(0.0254 AS DOUBLE) WHEN contains(width, 'ft') THEN CAST(0.3048 AS DOUBLE) ELSE 1 END AS x FROM road)
SELECT edge_id, CASE WHEN x IS NULL THEN 'None' ELSE CAST(least(round_even(x * 2, 0) / 2, 30) AS VARCHAR) END AS width FROM v""")
def h7_width(spark, sf_dir):
    return _roads(spark, sf_dir).select("edge_id", road.width(F.col("width")).alias("width"))


@query("h8_sanitised", f"WITH {_ROAD} SELECT edge_id, coalesce(nullif(lanes, ''), 'None') AS lanes FROM road")
def h8_sanitised(spark, sf_dir):
    return _roads(spark, sf_dir).select("edge_id", road.normalise("surface", F.col("lanes")).alias("lanes"))


@query("h9_list_explode", """WITH l AS (SELECT o_orderkey AS edge_id, ['a', concat('p', CAST(o_orderkey % 3 AS VARCHAR))] AS kinds, CASE WHEN o_orderkey % 2 = 0 THEN [1, 2] ELSE [3] END AS lanes FROM orders),
a AS (SELECT edge_id, unnest(kinds) AS kind, lanes FROM l) SELECT edge_id, kind, CAST(unnest(lanes) AS INTEGER) AS lane FROM a""")
def h9_list_explode(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(
        k.alias("edge_id"), F.array(F.lit("a"), F.concat(F.lit("p"), (k % 3).cast("string"))).alias("kinds"),
        F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3))).alias("lanes"),
    )
    return t.withColumn("kind", F.explode_outer("kinds")).withColumn("lane", F.explode_outer("lanes")).select("edge_id", "kind", "lane")


@query("d8_wide_road_flags", f"""WITH {_ROAD} SELECT edge_id % 100 AS edge, {', '.join(f"max(CASE WHEN lanes = '{v}' THEN 1 ELSE 0 END) AS lanes_{v.replace('.', '')}" for v in ('2', '3.7', '17'))} FROM road GROUP BY ALL""")
def d8_wide_road_flags(spark, sf_dir):
    r = _roads(spark, sf_dir).withColumn("edge", F.col("edge_id") % 100)
    return r.groupBy("edge").agg(*[F.max(F.when(F.col("lanes") == v, 1).otherwise(0)).alias(f"lanes_{v.replace('.', '')}") for v in ("2", "3.7", "17")])


@query("c9_joint_with_features", """SELECT s_nationkey AS region_id, count(o_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' GROUP BY s_nationkey""")
def c9_joint_with_features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region_id"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(1).alias("hit"))
    return s.join(li, "s_suppkey", "left").join(o, "o_orderkey", "left").groupBy("region_id").agg(F.count("hit").alias("n"))


@query("c11_regions_with_aggregate", """SELECT n_name AS region_id, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def c11_regions_with_aggregate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey").select(F.col("n_name").alias("region_id"), "n")


@query("c15_prediction_alignment", "SELECT l.doc_id, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id % 3 <> 0")
def c15_prediction_alignment(spark, sf_dir):
    from geoloom.operators.evaluate import align

    d = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 3 <> 0")
    return align(table(spark, sf_dir, "labels").select("doc_id", "quality"), d, "doc_id")


@query("c17_available_neighbours", f"WITH {sql_tiled(12)}, c AS (SELECT region_id, count(*) AS n FROM tiled GROUP BY region_id), i AS (SELECT DISTINCT region_id FROM tiled WHERE feature_id % 7 = 0) SELECT region_id, n FROM c JOIN i USING (region_id)")
def c17_available_neighbours(spark, sf_dir):
    t = tiled(spark, sf_dir, 12)
    return t.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).join(t.filter("feature_id % 7 = 0").select("region_id").distinct(), "region_id")


@query("c18_plot_merge", f"WITH {sql_tiled(12)} SELECT region_id, round(avg(value), 6) AS value FROM tiled GROUP BY region_id")
def c18_plot_merge(spark, sf_dir):
    t = tiled(spark, sf_dir, 12)
    r = t.select("region_id").distinct()
    return r.join(t.groupBy("region_id").agg(F.round(F.avg("value"), 6).alias("value")), "region_id")


@query("d9_mean_vectors", """WITH v AS (SELECT vec_id % 25 AS region_id, embedding[1] AS a, embedding[2] AS b, embedding[64] AS c FROM embeddings)
SELECT region_id, round(avg(CAST(a AS DOUBLE)), 6) AS a, round(avg(CAST(b AS DOUBLE)), 6) AS b, round(avg(CAST(c AS DOUBLE)), 6) AS c FROM v GROUP BY region_id""")
def d9_mean_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("feature_id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in ((0, "a"), (1, "b"), (63, "c"))])
    joint = e.select((F.col("vec_id") % 25).alias("region_id"), F.col("vec_id").alias("feature_id"))
    out = embedders.mean_vectors(joint, v, ["a", "b", "c"])
    return out.select("region_id", *[F.round(c, 6).alias(c) for c in "abc"])


@query("d13_cell_union", f"WITH {sql_tiled(13)} SELECT seg, count(DISTINCT region_id) AS cells FROM tiled GROUP BY seg")
def d13_cell_union(spark, sf_dir):
    return tiled(spark, sf_dir, 13).select("seg", "region_id").distinct().groupBy("seg").agg(F.count(F.lit(1)).alias("cells"))


@query("d14_group_min_max", """WITH a AS (SELECT l_suppkey AS region_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY l_suppkey),
m AS (SELECT min(least(r, a)) AS lo, max(greatest(r, a)) AS hi FROM a)
SELECT region_id, round((CAST(r AS DOUBLE) - lo) / (hi - lo), 6) AS r, round((CAST(a AS DOUBLE) - lo) / (hi - lo), 6) AS a FROM a, m""")
def d14_group_min_max(spark, sf_dir):
    one = lambda v: F.sum((F.col("l_returnflag") == v).cast("int"))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("region_id")).agg(one("R").alias("r"), one("A").alias("a"))
    return embedders.min_max(t, ["r", "a"]).select("region_id", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


@query("d15_z_score", """WITH m AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier)
SELECT s_suppkey, round((s_acctbal - m) / s, 6) AS z, CAST(0 AS DOUBLE) AS flat FROM supplier, m""")
def d15_z_score(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("z"), F.lit(3.0).alias("flat"))
    return embedders.z_score(t, ["z", "flat"]).select("s_suppkey", F.round("z", 6).alias("z"), "flat")


@query("d16_clipped_scaler", """WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, round(least(greatest((o_totalprice - lo) / (hi - lo), 0), 1), 6) AS scaled FROM orders, f WHERE o_orderkey % 2 = 1""")
def d16_clipped_scaler(spark, sf_dir):
    from geoloom.operators.labels import scale_fitted

    o = table(spark, sf_dir, "orders")
    out = scale_fitted(o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_totalprice").alias("scaled")), o.filter("o_orderkey % 2 = 0").select(F.col("o_totalprice").alias("scaled")), "scaled")
    return out.select("o_orderkey", F.round("scaled", 6).alias("scaled"))


@query("d18_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def d18_distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()


@query("d19_quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem")
def d19_quantiles(spark, sf_dir):
    from geoloom.operators.quantiles import quantiles

    low, high = quantiles(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), [0.05, 0.95])
    return spark.createDataFrame([(round(low, 6), round(high, 6))], "p5 double, p95 double")


@query("f3_seeded_shuffle", "SELECT c_custkey, md5(concat(CAST(c_custkey AS VARCHAR), '|42')) AS place FROM customer")
def f3_seeded_shuffle(spark, sf_dir):
    from geoloom.operators.splits import shuffle_order

    return table(spark, sf_dir, "customer").select("c_custkey", shuffle_order(F.col("c_custkey"), seed=42).alias("place"))


@query("g1_union_all", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def g1_union_all(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("g2_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def g2_distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("g3_distinct_lists", "SELECT DISTINCT concat(l_returnflag, ',', l_linestatus) AS tags FROM lineitem")
def g3_distinct_lists(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.array("l_returnflag", "l_linestatus").alias("t")).dropDuplicates().select(F.array_join("t", ",").alias("tags"))


@query("g4_cell_set_union", f"WITH {sql_tiled(12)} SELECT region_id FROM tiled WHERE seg = 'BUILDING' UNION SELECT region_id FROM tiled WHERE seg = 'MACHINERY'")
def g4_cell_set_union(spark, sf_dir):
    return tiled(spark, sf_dir, 12).filter("seg in ('BUILDING', 'MACHINERY')").select("region_id").distinct()


@query("g5_set_intersection", f"WITH {sql_tiled(14)} SELECT DISTINCT region_id FROM tiled WHERE seg = 'BUILDING' AND region_id IN (SELECT region_id FROM tiled WHERE seg = 'MACHINERY')")
def g5_set_intersection(spark, sf_dir):
    t = tiled(spark, sf_dir, 14)
    return t.filter("seg = 'BUILDING'").select("region_id").distinct().join(t.filter("seg = 'MACHINERY'").select("region_id"), "region_id", "left_semi")


@query("g6_set_difference", f"WITH {sql_tiled(14)} SELECT DISTINCT region_id FROM tiled WHERE region_id NOT IN (SELECT region_id FROM tiled WHERE seg = 'MACHINERY')")
def g6_set_difference(spark, sf_dir):
    t = tiled(spark, sf_dir, 14)
    return t.select("region_id").distinct().join(t.filter("seg = 'MACHINERY'").select("region_id"), "region_id", "left_anti")


@query("h2_feature_id", "SELECT concat(o_orderstatus, '/', CAST(o_orderkey AS VARCHAR)) AS feature_id FROM orders")
def h2_feature_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(scalars.feature_id(F.col("o_orderstatus"), F.col("o_orderkey")).alias("feature_id"))


@query("h3_tile_id", f"WITH {sql_tiled(15)} SELECT feature_id, region_id FROM tiled")
def h3_tile_id(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("feature_id", grid.tile_of(F.col("lon"), F.col("lat"), 15).alias("region_id"))


@query("h4_geometry_hash", "SELECT c_custkey, sha256(concat('POINT (', CAST(c_custkey AS VARCHAR), ' 51)')) AS h FROM customer")
def h4_geometry_hash(spark, sf_dir):
    wkt = F.concat(F.lit("POINT ("), F.col("c_custkey").cast("string"), F.lit(" 51)"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.geometry_hash(wkt).alias("h"))


@query("h10_time_shift", "SELECT event_id, CAST(floor(epoch(ts + INTERVAL 8 HOUR)) AS BIGINT) AS s FROM events")
def h10_time_shift(spark, sf_dir):
    shifted = scalars.shifted_time(F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(shifted.cast("timestamp")).alias("s"))


@query("h11_epoch_to_time", "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def h11_epoch_to_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.timestamp_seconds("o_orderkey"), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("h12_percentage_errors", """SELECT round(avg(abs((o_totalprice - p) / (o_totalprice + 1e-10)) * 100), 6) AS mape, round(avg(abs(p - o_totalprice) * 2 / (abs(p) + abs(o_totalprice) + 1e-10) * 100), 6) AS smape
FROM (SELECT o_totalprice, o_totalprice + (o_orderkey % 11 - 5) * 100 AS p FROM orders)""")
def h12_percentage_errors(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_totalprice") + (F.col("o_orderkey") % 11 - 5) * 100).alias("p"))
    t, p = F.col("o_totalprice"), F.col("p")
    return o.agg(F.round(F.avg(scalars.mape_term(t, p)), 6).alias("mape"), F.round(F.avg(scalars.smape_term(t, p)), 6).alias("smape"))


@query("h13_great_circle", f"""WITH {PTS} SELECT feature_id, round(2.0 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(51.1 - lat) / 2) * sin(radians(51.1 - lat) / 2)
+ cos(radians(lat)) * cos(radians(51.1)) * sin(radians(17.03 - lon) / 2) * sin(radians(17.03 - lon) / 2)))), 3) AS d FROM pts""")
def h13_great_circle(spark, sf_dir):
    d = scalars.haversine_m(F.col("lon"), F.col("lat"), F.lit(17.03), F.lit(51.1))
    return points(spark, sf_dir).select("feature_id", F.round(d, 3).alias("d"))


@query("h15_region_name", """SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN concat('en ', n_name) END, CASE WHEN n_nationkey % 3 = 1 THEN n_name END, CAST(n_nationkey AS VARCHAR)) AS region_id FROM nation""")
def h15_region_name(spark, sf_dir):
    k = F.col("n_nationkey")
    tags = F.create_map(F.lit("name:en"), F.when(k % 3 == 0, F.concat(F.lit("en "), "n_name")).otherwise(""), F.lit("name"), F.when(k % 3 == 1, F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.region_name(tags, k).alias("region_id"))


@query("h17_sincos_position", "SELECT l_linenumber AS p, round(sin(l_linenumber * 1.0), 6) AS e0, round(sin(l_linenumber * 0.01), 6) AS e1, round(cos(l_linenumber * 1.0), 6) AS e2, round(cos(l_linenumber * 0.01), 6) AS e3 FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def h17_sincos_position(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("p")).distinct()
    return t.select("p", *[F.round(c, 6).alias(f"e{k}") for k, c in enumerate(scalars.sincos_position(F.col("p"), 4))])


@query("e6_first_per_key", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def e6_first_per_key(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return regionalizers.first_per_key(t, ["l_orderkey"], [F.col("l_linenumber")])


@query("b4_non_empty_geometries", f"WITH {PTS} SELECT feature_id FROM pts WHERE feature_id % 4 <> 0")
def b4_non_empty_geometries(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("lon", F.when(F.col("feature_id") % 4 != 0, F.col("lon")))
    return p.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("feature_id")


@query("b14_without_geometry", f"WITH {TAGS} SELECT feature_id, brand, size, dear FROM tags")
def b14_without_geometry(spark, sf_dir):
    from geoloom.schema import drop_geometry, with_bounds

    return drop_geometry(with_bounds(tagged(spark, sf_dir))).drop("lon", "lat")


@query("c12_feature_vectors", """SELECT l_suppkey AS region_id, round(avg(p_retailprice), 6) AS price, round(avg(p_size), 6) AS size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey""")
def c12_feature_vectors(spark, sf_dir):
    joint = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region_id"), F.col("l_partkey").alias("feature_id"))
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return embedders.mean_vectors(joint, v, ["price", "size"]).select("region_id", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query("f1_sorted_lists", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def f1_sorted_lists(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(pairs, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("h14_json_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def h14_json_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
