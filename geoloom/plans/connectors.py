"""Queries: sources and sinks through files in the shared folder, table preconditions, model files.

Files are written from the driver's tables, read back by the source under test, and compared
with what the tables say.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import functions as F

from geoloom import errors, schema
from geoloom.functions import geometry as G
from geoloom.functions import scalars
from geoloom.operators import embedders, filters, regionalizers, spatial_join
from geoloom.optional import optional_import
from geoloom.plans.inputs import BOXES, PTS, REGS, TAGS, box_features, box_regions, points, query, sql_lon, sql_tiled, table, tagged
from geoloom.sources import datasets, files, gtfs, osm, pbf
from geoloom.storage import committed, new_path, written

AREA = (16.90005, 51.06005, 17.10005, 51.15005)
_IN_AREA = "lon BETWEEN CAST(16.90005 AS DOUBLE) AND CAST(17.10005 AS DOUBLE) AND lat BETWEEN CAST(51.06005 AS DOUBLE) AND CAST(51.15005 AS DOUBLE)"


def _place(k):
    return ((F.lit(168000) + (k * 7919) % 3800) / F.lit(10000.0)).alias("lon"), ((F.lit(510400) + (k * 104729) % 1700) / F.lit(10000.0)).alias("lat")


@query("a1_geoparquet_scan", f"WITH {PTS} SELECT feature_id, value, lon FROM pts WHERE {_IN_AREA}")
def a1_geoparquet_scan(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("feature_id").alias("own_id"), "seg", "value", G.st_point(F.col("lon"), F.col("lat")).alias("geometry"))
    path = files.write_geoparquet(p, new_path(spark, "geoparquet"))
    got = files.read_geoparquet(spark, path, index_column="own_id", columns=["value"], area=AREA)
    return got.select("feature_id", "value", "minx").withColumnRenamed("minx", "lon")


def _extract(spark, sf_dir) -> str:
    """The tagged features as an extract: element, id, tags (map), lon, lat."""
    path = new_path(spark, "extract")
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("brand", "size")]), lambda e: e["v"].isNotNull())
    rows = tagged(spark, sf_dir).select(F.lit("node").alias("element"), F.col("feature_id").alias("id"), F.map_from_entries(pairs).alias("tags"), "lon", "lat")
    rows.write.parquet(path)
    return path


_WANTED = {"brand": ["Brand#11", "Brand#12", "Brand#23"], "size": True}
_EXTRACT = f"""WITH {TAGS} SELECT concat('node/', CAST(feature_id AS VARCHAR)) AS feature_id, brand, size FROM tags
WHERE (coalesce(brand IN ('Brand#11', 'Brand#12', 'Brand#23'), false) OR size IS NOT NULL) AND {_IN_AREA}"""


@query("a2_extract_scan", _EXTRACT)
def a2_extract_scan(spark, sf_dir):
    return osm.read_extract(spark, _extract(spark, sf_dir), _WANTED, area=AREA).select("feature_id", "brand", "size")


@query("a2_pbf_scan", f"WITH {TAGS} SELECT concat('node/', CAST(feature_id AS VARCHAR)) AS feature_id, brand, size, lon, lat FROM tags WHERE coalesce(brand IN ('Brand#11', 'Brand#12', 'Brand#23'), false) OR size IS NOT NULL")
def a2_pbf_scan(spark, sf_dir):
    rows = spark.read.parquet(_extract(spark, sf_dir)).withColumn("refs", F.expr("cast(null as array<long>)"))
    folder = pbf.write_pbf(rows, new_path(spark, "pbf"))
    path = new_path(spark, "elements")
    pbf.read_pbf(spark, f"{folder}/*.pbf").write.parquet(path)
    return osm.read_extract(spark, path, _WANTED).select("feature_id", "brand", "size", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("a3_extract_to_geoparquet", _EXTRACT)
def a3_extract_to_geoparquet(spark, sf_dir):
    found = osm.read_extract(spark, _extract(spark, sf_dir), _WANTED, area=AREA)
    path = files.write_geoparquet(found.withColumn("geometry", G.st_point(F.col("lon"), F.col("lat"))), new_path(spark, "geoparquet"))
    return files.read_geoparquet(spark, path, index_column="feature_id", columns=["brand", "size"]).select("feature_id", "brand", "size")


@query("a4_online_features", """SELECT concat('way/', CAST(n_nationkey AS VARCHAR)) AS feature_id, concat('k', CAST(n_nationkey % 4 AS VARCHAR)) AS kind, n_name AS name
FROM nation WHERE n_nationkey % 4 IN (0, 2) OR n_regionkey = 1""")
def a4_online_features(spark, sf_dir):
    nations = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in table(spark, sf_dir, "nation").collect()]

    def fetch(area, key, value):
        for k, name, region in nations:
            row = {"element": "way", "id": k, "kind": f"k{k % 4}", "name": name if area == "west" else None, "side": "one" if region == 1 else None}
            if row[key] is not None and value in (True, row[key]):
                yield row

    found = osm.fetch_features(spark, ["east", "west"], {"kind": ["k0", "k2"], "side": True}, fetch, "element string, id long, kind string, name string, side string")
    return found.select("feature_id", "kind", "name")


_ROADS = """l AS (SELECT l_orderkey AS way, l_linenumber AS no, o_orderpriority AS prio,
  CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE 100000000 + l_orderkey * 10 + l_linenumber END AS node
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
w AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY no, node) AS pos FROM l),
c AS (SELECT node, count(*) AS n FROM w GROUP BY node),
e AS (SELECT w.*, n > 1 OR pos = min(pos) OVER (PARTITION BY way) OR pos = max(pos) OVER (PARTITION BY way) AS j FROM w JOIN c USING (node)),
s AS (SELECT way, prio, pos, node AS u, lead(node) OVER (PARTITION BY way ORDER BY pos) AS v, lead(pos) OVER (PARTITION BY way ORDER BY pos) AS next FROM e WHERE j)"""
_CLASS = "CASE WHEN {0} = '1-URGENT' THEN 'primary' WHEN {0} = '2-HIGH' THEN 'residential' ELSE 'footway' END"


def _network(spark, sf_dir):
    node = F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey").cast("long")).otherwise(F.lit(100000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), node.cast("long").alias("node"))
    refs = steps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("refs"))
    kind = F.expr(_CLASS.format("o_orderpriority"))
    ways = refs.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("highway"), kind).alias("tags")), "id")
    nodes = steps.select(F.col("node").alias("id")).distinct().select("id", *_place(F.col("id")))
    return osm.road_network(nodes, ways, "drive")


@query("a5_road_edges", f"""WITH {_ROADS} SELECT way, u, v, CAST(next - pos AS INTEGER) AS steps, {_CLASS.format('prio')} AS highway FROM s WHERE v IS NOT NULL""")
def a5_road_edges(spark, sf_dir):
    _, edges = _network(spark, sf_dir)
    return edges.select("way", "u", "v", (F.size("path") - 1).alias("steps"), "highway")


@query("a5_road_nodes", f"""WITH {_ROADS} SELECT node, round({sql_lon('node')}, 6) AS lon, count(*) AS street_count
FROM (SELECT u AS node FROM s WHERE v IS NOT NULL UNION ALL SELECT v FROM s WHERE v IS NOT NULL) GROUP BY ALL""")
def a5_road_nodes(spark, sf_dir):
    nodes, _ = _network(spark, sf_dir)
    return nodes.select(F.col("id").alias("node"), F.round("lon", 6).alias("lon"), "street_count")


_HIGHWAYS = ["motorway", "residential", "service", "footway", "cycleway", "construction", "track"]
# Which of these roads each network holds.
_HELD = {
    "all": "residential motorway service footway cycleway track",
    "all_private": "residential motorway service footway cycleway track",
    "bike": "residential service cycleway track",
    "drive": "motorway residential",
    "drive_service": "motorway residential service",
    "walk": "residential service footway track",
}


@query("a6_network_types", "WITH w AS (SELECT p_partkey AS way, [" + ", ".join(f"'{h}'" for h in _HIGHWAYS) + f"][CAST(p_partkey % {len(_HIGHWAYS)} AS INTEGER) + 1] AS highway FROM part) SELECT network, highway, count(*) AS ways FROM w JOIN (VALUES "
       + ", ".join(f"('{n}', '{h}')" for n, hs in _HELD.items() for h in hs.split()) + ") t(network, highway) USING (highway) GROUP BY network, highway")
def a6_network_types(spark, sf_dir):
    kind_of = F.element_at(F.array(*[F.lit(h) for h in _HIGHWAYS]), (F.col("p_partkey") % len(_HIGHWAYS)).cast("int") + 1)
    ways = table(spark, sf_dir, "part").select(kind_of.alias("highway")).withColumn("tags", F.create_map(F.lit("highway"), "highway"))
    kinds = F.array_compact(F.array(*[F.when(osm.network_mask(F.col("tags"), kind), F.lit(kind.value)) for kind in osm.NetworkType]))
    return ways.select(F.explode(kinds).alias("network"), "highway").groupBy("network", "highway").agg(F.count(F.lit(1)).alias("ways"))


_DEPARTS = "concat(lpad(CAST((l_linenumber * 5 + l_orderkey) % 27 AS VARCHAR), 2, '0'), ':15:00')"


def _feed(spark, sf_dir) -> str:
    folder = new_path(spark, "feed")
    s, l, o = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "orders"))
    k = F.col("s_suppkey")
    lon, lat = _place(k)
    departs = F.concat(F.lpad(((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 27).cast("string"), 2, "0"), F.lit(":15:00"))
    parts = {
        "stops": s.select(k.alias("stop_id"), lon.alias("stop_lon"), lat.alias("stop_lat")),
        "stop_times": l.select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), departs.alias("departure_time")),
        "trips": o.select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("trip_headsign")),
    }
    for name, df in parts.items():
        df.write.option("header", True).csv(f"{folder}/{name}.txt")
    return folder


_STOPS = f"""h AS (SELECT CAST(l_suppkey AS VARCHAR) AS stop_id, l_orderkey AS trip_id, CAST(substr({_DEPARTS}, 1, 2) AS INTEGER) % 24 AS hour, o_orderpriority AS sign
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query("a7_gtfs_feed", f"""WITH {_STOPS} SELECT stop_id AS feature_id, CAST(count(DISTINCT CASE WHEN hour = 8 THEN trip_id END) AS DOUBLE) AS trips_at_8,
  CAST(count(DISTINCT CASE WHEN hour = 17 THEN trip_id END) AS DOUBLE) AS trips_at_17,
  string_agg(DISTINCT CASE WHEN hour = 8 THEN sign END, ',' ORDER BY CASE WHEN hour = 8 THEN sign END) AS directions_at_8 FROM h GROUP BY stop_id""")
def a7_gtfs_feed(spark, sf_dir):
    got = gtfs.stop_features(gtfs.read_feed(spark, _feed(spark, sf_dir)))
    return got.select("feature_id", "trips_at_8", "trips_at_17", F.array_join("directions_at_8", ",").alias("directions_at_8"))


@query("a8_gtfs_validation", """SELECT n_name AS feed, n_nationkey % 5 = 3 AS failed, CASE WHEN n_nationkey % 5 = 3 THEN 1 ELSE 5 END AS messages FROM nation""")
def a8_gtfs_validation(spark, sf_dir):
    out = []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        broken = r["n_nationkey"] % 5 == 3
        report = [("warning", f"w{k}") for k in range(5)] + [("error", "stop without place")] * broken
        try:
            messages, failed = gtfs.validate(spark.createDataFrame(report, "type string, message string")), False
        except ValueError as error:
            messages, failed = str(error).split(": ", 1)[1].split("; "), True
        out.append((r["n_name"], failed, len(messages)))
    return spark.createDataFrame(out, "feed string, failed boolean, messages int")


@query("a9_overture_scan", f"""WITH {BOXES}, a AS (SELECT 'b' || feature_id AS feature_id, minx, maxx, miny, maxy, feature_id % 2 = 0 AS building, NULL AS road FROM boxes
UNION ALL SELECT 'r' || feature_id, minx, maxx, miny, maxy, NULL, feature_id % 3 = 0 FROM boxes)
SELECT feature_id, coalesce(CAST(building AS VARCHAR), 'none') AS building, coalesce(CAST(road AS VARCHAR), 'none') AS road FROM a WHERE minx <= 17.10005 AND maxx >= 16.90005 AND miny <= 51.15005 AND maxy >= 51.06005""")
def a9_overture_scan(spark, sf_dir):
    k, boxes, paths = F.col("feature_id"), box_features(spark, sf_dir), []
    for letter, name, n in (("b", "building", 2), ("r", "road", 3)):
        paths.append(new_path(spark, "theme"))
        boxes.select(F.concat(F.lit(letter), k.cast("string")).alias("feature_id"), "minx", "miny", "maxx", "maxy", (k % n == 0).alias(name)).write.parquet(paths[-1])
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
    return osm.read_overture(spark, paths, area=AREA).select("feature_id", shown("building"), shown("road"))


_TILES = f"""WITH {REGS}, c AS (SELECT DISTINCT region_id FROM regs),
{sql_tiled(12)[len(PTS) + 2:].replace('FROM pts', 'FROM (SELECT region_id AS rid, (minx + maxx) / 2 AS lon, (miny + maxy) / 2 AS lat FROM regs)')}"""


def _centres(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    return r.select(((F.col("minx") + F.col("maxx")) / 2).alias("lon"), ((F.col("miny") + F.col("maxy")) / 2).alias("lat"))


@query("a10_tile_scan", f"{_TILES} SELECT DISTINCT region_id, concat('12/', CAST(x AS VARCHAR), '/', CAST(y AS VARCHAR)) AS tile FROM tiled")
def a10_tile_scan(spark, sf_dir):
    got = osm.load_tiles(_centres(spark, sf_dir), 12, lambda x, y, z: f"{z}/{x}/{y}".encode())
    return got.select("region_id", F.col("tile").cast("string").alias("tile"))


@query("a11_tile_sinks", f"{_TILES} SELECT DISTINCT region_id, concat(region_id, '.png') AS saved, CAST(length(concat('12/', CAST(x AS VARCHAR), '/', CAST(y AS VARCHAR))) AS INTEGER) AS bytes FROM tiled")
def a11_tile_sinks(spark, sf_dir):
    fetch = lambda x, y, z: f"{z}/{x}/{y}".encode()
    saved = osm.load_tiles(_centres(spark, sf_dir), 12, fetch, save_to=new_path(spark, "tiles"))
    sized = osm.load_tiles(_centres(spark, sf_dir), 12, fetch, collector=lambda name, data: len(data), kind="int")
    return saved.select("region_id", F.element_at(F.split("tile", "/"), -1).alias("saved")).join(sized.select("region_id", F.col("tile").alias("bytes")), "region_id")


@query("a12_download", "SELECT n_nationkey, n_name FROM nation")
def a12_download(spark, sf_dir):
    import io

    folder = new_path(spark, "download").removeprefix("file:")
    text = "\n".join(f"{r['n_nationkey']},{r['n_name']}" for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect())
    path = files.download_file("https://example.org/nations.csv", f"{folder}/nations.csv", chunk_bytes=64, opener=lambda url: io.BytesIO(text.encode()))
    files.download_file("https://example.org/nations.csv", path, force=False, opener=lambda url: io.BytesIO(b"other"))
    return spark.read.schema("n_nationkey int, n_name string").csv(path)


@query("a13_split_folders", """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders""")
def a13_split_folders(spark, sf_dir):
    folder, o = new_path(spark, "dataset"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    o.filter("o_orderkey % 5 <> 0").write.parquet(f"{folder}/train")
    o.filter("o_orderkey % 5 = 0").write.parquet(f"{folder}/test")
    return datasets.read_splits(spark, folder)


@query("a14_csv_to_parquet", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def a14_csv_to_parquet(spark, sf_dir):
    source, target = new_path(spark, "csv"), new_path(spark, "parquet")
    table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(source)
    names = {f.name: f.dataType.simpleString() for f in table(spark, sf_dir, "customer").schema}
    kinds = ", ".join(f"{c} {names[c]}" for c in ("c_custkey", "c_acctbal", "c_mktsegment"))
    files.csv_to_parquet(spark, source, target, schema=kinds, where="c_acctbal > 0")
    return files.csv_to_parquet(spark, source, target, schema=kinds)  # the second call reads the Parquet


@query("a15_plt_logs", """SELECT CAST(user_id AS VARCHAR) AS user_id, concat(CAST(user_id AS VARCHAR), '_t', CAST(event_id % 3 AS VARCHAR)) AS trip_id, count(*) AS n,
round(max(CAST(168000 + (event_id * 389) % 1200 AS DOUBLE) / 10000), 6) AS lon, min(date_trunc('second', ts)) AS first FROM events GROUP BY ALL""")
def a15_plt_logs(spark, sf_dir):
    root = new_path(spark, "plt")
    k = F.col("event_id")
    line = F.concat_ws(
        ",", ((F.lit(510400) + (k * 211) % 900) / F.lit(10000.0)).cast("string"), ((F.lit(168000) + (k * 389) % 1200) / F.lit(10000.0)).cast("string"),
        F.lit("0"), F.lit("100"), F.lit("39000.5"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"),
    )
    head = F.array(*[F.lit(v) for v in ("a log", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,track,0,0,2,8421376", "0")])
    trips = table(spark, sf_dir, "events").select("user_id", (k % 3).alias("t"), k, line.alias("line")).groupBy("user_id", "t").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    rows = trips.select("user_id", "t", F.array_join(F.concat(head, "lines"), "\n").alias("body"))

    def save(batches):
        import pandas as pd

        for b in batches:
            for user, t, body in b.itertuples(index=False):
                with committed(f"{root}/{user}/Trajectory/t{t}.plt") as out:
                    out.write(body.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows.mapInPandas(save, "n long").agg(F.sum("n")).collect()
    got = files.read_plt(spark, root)
    return got.groupBy("user_id", "trip_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("lon"), 6).alias("lon"), F.min("ts").alias("first"))


@query("a17_geocoder", "SELECT concat(n_name, ', Earth') AS region_id, CAST(n_nationkey AS DOUBLE) AS minx, CAST(n_nationkey + 1 AS DOUBLE) AS maxx FROM nation")
def a17_geocoder(spark, sf_dir):
    known = {r["n_name"]: r["n_nationkey"] for r in table(spark, sf_dir, "nation").collect()}

    def search(name):
        k = float(known[name])
        return [{"display_name": f"{name}, Earth", "minx": k, "miny": 0.0, "maxx": k + 1, "maxy": 1.0}, {"display_name": "elsewhere", "minx": 0, "miny": 0, "maxx": 1, "maxy": 1}]

    return osm.geocode(spark, sorted(known), search).select("region_id", "minx", "maxx")


@query("a18_cached_query", "SELECT r_name AS name, 1 AS asked, 2 AS read FROM region")
def a18_cached_query(spark, sf_dir):
    folder, out = new_path(spark, "answers").removeprefix("file:"), []
    for r in table(spark, sf_dir, "region").collect():
        asked: list[str] = []

        def run(q, asked=asked):
            asked.append(q)
            return {"name": q}

        answers = [osm.cached_query(r["r_name"], folder, run, wait=0) for _ in range(2)]
        out.append((answers[1]["name"], len(asked), len(answers)))
    return spark.createDataFrame(out, "name string, asked int, read int")


@query("a20_geometry_tables", f"WITH {REGS} SELECT region_id, minx, maxy FROM regs")
def a20_geometry_tables(spark, sf_dir):
    r = box_regions(spark, sf_dir).withColumnRenamed("region_id", "own")
    return schema.to_regions(r, "own").select("region_id", "minx", "maxy")


@query("a21_area_bounds", f"WITH {REGS}, {PTS} SELECT 'r' || region_id AS id, minx, miny, maxx, maxy FROM regs UNION ALL SELECT 'f' || feature_id, lon, lat, lon, lat FROM pts")
def a21_area_bounds(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    shapes = r.select(F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("id"), spatial_join._box_wkb("").alias("geometry"))
    p = points(spark, sf_dir).select(F.concat(F.lit("f"), F.col("feature_id").cast("string")).alias("id"), "lon", "lat")
    keep = ("id", *schema.BOX)
    return schema.with_bounds(shapes).select(*keep).unionByName(schema.with_bounds(p).select(*keep))


@query("a21_area_systems", f"WITH {PTS} SELECT feature_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(lon, 5) AS utm_lon FROM pts")
def a21_area_systems(spark, sf_dir):
    """Places written in web map metres and read back; in UTM zone 33 by the forward series."""
    import math

    from geoloom.functions import crs

    p = points(spark, sf_dir)
    web = p.select("feature_id", (F.radians("lon") * crs.AXIS).alias("lon"), (F.log(F.tan(F.radians("lat") / 2 + math.pi / 4)) * crs.AXIS).alias("lat"))
    n = crs.FLATTENING / (2 - crs.FLATTENING)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    radius, e = crs.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians("lat"))
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    turn = F.radians("lon") - math.radians(15)
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, c in enumerate(alpha, 1):
        x = x + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * c
        y = y + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * c
    utm = p.select("feature_id", (x * radius * crs.SCALE + crs.EAST).alias("lon"), (y * radius * crs.SCALE).alias("lat"))
    back = schema.to_wgs84(utm, 32633).select("feature_id", F.round("lon", 5).alias("utm_lon"))
    own = schema.to_wgs84(web, 3857).select("feature_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    return own.join(back, "feature_id")


@query("a22_model_store", "SELECT c_nationkey AS region_id, round(avg(c_acctbal), 6) AS weight, 25 AS width FROM customer GROUP BY c_nationkey")
def a22_model_store(spark, sf_dir):
    """Means per nation as a model's weights, through the store and back."""
    import numpy as np

    from geoloom.operators.autograd import Tensor
    from geoloom.operators.neural import Model

    class Stored(Model):
        def extra(self):
            return {}

        def restore(self, config):
            self.config = config

    means = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("w")).orderBy("c_nationkey").collect()  # a row a nation
    model = Stored(width=25, seed=7)
    model.params = {"region": Tensor(np.array([float(r["c_nationkey"]) for r in means])), "w": Tensor(np.array([r["w"] for r in means]))}
    folder = new_path(spark, "model").removeprefix("file:")
    model.save(folder)
    got = Stored.load(folder)
    rows = zip(got.params["region"].data.tolist(), got.params["w"].data.tolist(), strict=True)
    return spark.createDataFrame([(int(k), w, got.config["width"]) for k, w in rows], "region_id int, weight double, width int").withColumn("weight", F.round("weight", 6))


_SHARE = "greatest(0, least(r.maxx, 17.0) - greatest(r.minx, 16.87)) * greatest(0, least(r.maxy, 51.15) - greatest(r.miny, 51.07)) / ((r.maxx - r.minx) * (r.maxy - r.miny))"


def _boundaries(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    k = F.col("region_id")
    tags = F.when(k % 2 == 0, F.create_map(F.lit("name"), F.concat(F.lit("n"), k.cast("string")), F.lit("name:en"), F.concat(F.lit("e"), k.cast("string")))).otherwise(F.create_map(F.lit("name"), F.concat(F.lit("n"), k.cast("string"))))
    return r.select(k.cast("long").alias("element_id"), F.lit(4).alias("admin_level"), tags.alias("tags"), *schema.BOX)


@query("b11_artefact_filter", f"WITH {REGS} SELECT region_id FROM regs r WHERE {_SHARE} > 0.3")
def b11_artefact_filter(spark, sf_dir):
    area = spark.createDataFrame([(16.87, 51.07, 17.0, 51.15)], "minx double, miny double, maxx double, maxy double")
    got = regionalizers.administrative_regions(_boundaries(spark, sf_dir), area, admin_level=4, cell=0.05, least_share=0.3)
    return got.select(F.col("element_id").cast("int").alias("region_id"))


@query("j5_administrative_regions", f"""WITH {REGS} SELECT CASE WHEN region_id % 2 = 0 THEN 'e' ELSE 'n' END || region_id AS region_id,
  round(greatest(minx, 16.87), 9) AS minx, round(least(maxx, 17.0), 9) AS maxx FROM regs r WHERE {_SHARE} > 0.01""")
def j5_administrative_regions(spark, sf_dir):
    area = spark.createDataFrame([(16.87, 51.07, 17.0, 51.15)], "minx double, miny double, maxx double, maxy double")
    doubled = _boundaries(spark, sf_dir).unionByName(_boundaries(spark, sf_dir))
    got = regionalizers.administrative_regions(doubled, area, admin_level=4, cell=0.05, clip_to_area=True)
    return got.select("region_id", F.round("minx", 9).alias("minx"), F.round("maxx", 9).alias("maxx"))


@query("b15_preconditions", "SELECT * FROM (VALUES ('no columns', 'ValueError'), ('no region_id', 'ValueError'), ('no rows', 'EmptyDataError'), ('empty', 'ValueError'), ('fine', 'none')) t(what, raised)")
def b15_preconditions(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    tries = {
        "no columns": lambda: spatial_join.intersects_join(r.select("region_id"), r.withColumnRenamed("region_id", "feature_id"), cell=1.0),
        "no region_id": lambda: schema.check_tables(r.drop("region_id"), r, r),
        "no rows": lambda: files.require_rows(r.filter("region_id < 0"), "the table"),
        "empty": lambda: schema.not_empty(r.filter("region_id < 0"), "the table"),
        "fine": lambda: schema.not_empty(r, "the table"),
    }
    return spark.createDataFrame([(what, _raised(run)) for what, run in tries.items()], "what string, raised string")


def _raised(run) -> str:
    try:
        run()
    except Exception as error:  # noqa: BLE001  (the type is what is asked for)
        return type(error).__name__
    return "none"


@query("b16_filter_merge", f"""WITH {TAGS} SELECT feature_id FROM tags WHERE brand IN (SELECT p_brand FROM part WHERE p_size % 4 = 1) OR brand IN (SELECT p_brand FROM part WHERE p_size % 4 = 3)
OR size IS NOT NULL""")
def b16_filter_merge(spark, sf_dir):
    """Several filters, one of them of groups, two of them from a table, merged into one."""
    brands = table(spark, sf_dir, "part").filter("p_size % 2 = 1").select(F.concat(F.lit("g"), F.col("p_size") % 4).alias("grp"), F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    groups = filters.filter_from_table(brands, group="grp")
    merged = filters.merge_filters([groups, {"size": ["size0"], "brand": []}, {"again": {"size": True, "dear": False}}])
    features = tagged(spark, sf_dir)
    return features.filter(filters.tag_mask(features, merged)).select("feature_id")


@query("b17_filter_from_table", f"""WITH {TAGS} SELECT feature_id, CASE WHEN size IN ('size0', 'size2') THEN concat('size=', size) END AS g0,
CASE WHEN size IN ('size1', 'size3') THEN concat('size=', size) WHEN brand IS NOT NULL THEN concat('brand=', brand) END AS g1 FROM tags WHERE size IS NOT NULL OR brand IS NOT NULL""")
def b17_filter_from_table(spark, sf_dir):
    """Predefined groups kept as a table: group, key, value, null for any value."""
    part = table(spark, sf_dir, "part")
    sizes = part.select(F.concat(F.lit("g"), F.col("p_size") % 2).alias("grp"), F.lit("size").alias("key"), F.concat(F.lit("size"), F.col("p_size") % 4).alias("value"))
    every = part.select(F.lit("g1").alias("grp"), F.lit("brand").alias("key"), F.lit(None).cast("string").alias("value"))
    groups = filters.filter_from_table(sizes.union(every), group="grp")
    groups["g1"] = {k: groups["g1"][k] for k in ("size", "brand")}
    return filters.group_features(tagged(spark, sf_dir), groups)


@query("f5_sorted_columns", "SELECT * FROM (VALUES (0, 'feature_id'), (1, 'brand'), (2, 'dear'), (3, 'lat'), (4, 'lon'), (5, 'size')) t(place, name)")
def f5_sorted_columns(spark, sf_dir):
    wide = tagged(spark, sf_dir).select("size", "lon", "feature_id", "lat", "dear", "brand", F.lit(None).cast("string").alias("none"))
    return spark.createDataFrame(list(enumerate(filters.drop_empty_columns(wide).columns)), "place int, name string")


@query("h16_expected_features", """WITH f AS (SELECT DISTINCT p_brand AS grp, concat('s', p_size % 4) AS value FROM part)
SELECT name, CAST(row_number() OVER (PARTITION BY what ORDER BY name) AS INTEGER) AS place, what FROM (
SELECT DISTINCT 'flat' AS what, concat('size_', value) AS name FROM f UNION ALL SELECT DISTINCT 'groups', grp FROM f UNION ALL SELECT 'grouped', concat(grp, '_size=', value) FROM f)""")
def h16_expected_features(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.lit("size").alias("key"), F.concat(F.lit("s"), F.col("p_size") % 4).alias("value"))
    groups, flat = filters.filter_from_table(rows, group="grp"), filters.filter_from_table(rows)
    wanted = {"flat": (flat, True), "groups": (groups, False), "grouped": (groups, True)}
    names = [(n, k, what) for what, (tags, sub) in wanted.items() for k, n in enumerate(embedders.expected_features(tags, sub), 1)]
    return spark.createDataFrame(names, "name string, place int, what string")


@query("i2_own_functions", f"""WITH {REGS} SELECT region_id, CAST((region_id + 1) % 25 AS INTEGER) AS neighbour_id, 1 AS distance FROM regs
UNION ALL SELECT region_id, CAST((region_id + 5) % 25 AS INTEGER), 1 FROM regs""")
def i2_own_functions(spark, sf_dir):
    from geoloom.operators.neighbourhoods import edges_from_function

    return edges_from_function(box_regions(spark, sf_dir), lambda r: [(r + 1) % 25, (r + 5) % 25], "int")


@query("i3_optional_packages", "SELECT * FROM (VALUES ('raise', 'ImportError'), ('warn', 'None'), ('ignore', 'None'), ('present', 'json'), ('other', 'ValueError')) t(mode, outcome)")
def i3_optional_packages(spark, sf_dir):
    def outcome(mode):
        try:
            found = optional_import("maps", "json" if mode == "present" else "no_such_package", missing="raise" if mode == "present" else mode)
        except (ImportError, ValueError) as error:
            return type(error).__name__
        return getattr(found, "__name__", "None")

    logging.getLogger("geoloom.optional").addHandler(logging.NullHandler())
    return spark.createDataFrame([(m, outcome(m)) for m in ("raise", "warn", "ignore", "present", "other")], "mode string, outcome string")


@query("i4_errors", "SELECT * FROM (VALUES ('EmptyDataError', 'GeoloomError'), ('NotFittedError', 'GeoloomError')) t(raised, base)")
def i4_errors(spark, sf_dir):
    from geoloom.operators.neural import Model

    runs = [lambda: files.require_rows(box_regions(spark, sf_dir).limit(0), "regions"), lambda: Model(width=1).save("unused")]
    names = [_raised(r) for r in runs]
    return spark.createDataFrame([(n, getattr(errors, n).__mro__[1].__name__) for n in names], "raised string, base string")


@query("j2b_cell_polygons", f"""WITH {sql_tiled(12)} SELECT DISTINCT region_id, round(CAST(x AS DOUBLE) / 4096 * 360 - 180, 6) AS minx,
  round(CAST(x + 1 AS DOUBLE) / 4096 * 360 - 180, 6) AS maxx, 5 AS corners FROM tiled""")
def j2b_cell_polygons(spark, sf_dir):
    from geoloom.plans.inputs import tiled

    cells = regionalizers.tile_boxes(tiled(spark, sf_dir, 12).select("region_id", "x", "y").distinct(), 12)
    shapes = cells.select("region_id", spatial_join._box_wkb("").alias("geometry"))
    text = G.st_as_wkt(F.col("geometry"))
    placed = schema.with_bounds(shapes.withColumn("corners", (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))) + 1))
    return placed.select("region_id", F.round("minx", 6).alias("minx"), F.round("maxx", 6).alias("maxx"), F.col("corners").cast("int").alias("corners"))


@query("j4a_voronoi_polygons", "SELECT n_nationkey AS region_id, true AS holds_own, 0 AS holds_others FROM nation")
def j4a_voronoi_polygons(spark, sf_dir):
    n = F.col("n_nationkey")
    seeds = table(spark, sf_dir, "nation").select(n.alias("region_id"), ((n * 1511) % 340 - 170 + 0.37).alias("lon"), ((n * 677) % 150 - 75 + 0.41).alias("lat"))
    cells = regionalizers.voronoi_polygons(seeds, step_degrees=10.0)
    hit = spatial_join.within_join(seeds.withColumnRenamed("region_id", "seed"), cells, cell=30.0, how="inner")
    own = F.max(F.col("seed") == F.col("region_id"))
    others = F.sum((F.col("seed") != F.col("region_id")).cast("int")).cast("int")
    return hit.groupBy("region_id").agg(own.alias("holds_own"), others.alias("holds_others"))


@query("j4b_seed_parsing", f"WITH {BOXES} SELECT feature_id AS region_id, round((minx + maxx) / 2, 7) AS lon, round((miny + maxy) / 2, 7) AS lat FROM boxes")
def j4b_seed_parsing(spark, sf_dir):
    shapes = box_features(spark, sf_dir).select(F.col("feature_id").alias("region_id"), spatial_join._box_wkb("").alias("geometry"))
    empty = shapes.limit(1).select(F.lit(-1).cast("int").alias("region_id"), F.lit(bytearray(b"\x01\x06\x00\x00\x00\x00\x00\x00\x00")).alias("geometry"))
    seeds = regionalizers.seed_points(shapes.unionByName(empty.withColumn("region_id", F.col("region_id").cast(dict(shapes.dtypes)["region_id"]))))
    return seeds.select("region_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("k2_holes_removed", f"WITH {BOXES} SELECT feature_id, round((maxx - minx) * (maxy - miny) * 0.75, 9) AS before, round((maxx - minx) * (maxy - miny), 9) AS after FROM boxes")
def k2_holes_removed(spark, sf_dir):
    def ring(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k, x0, y0, x1, y1 in b[["feature_id", "minx", "miny", "maxx", "maxy"]].itertuples(index=False):
                dx, dy = (x1 - x0) / 4, (y1 - y0) / 4
                hole = [(x0 + dx, y0 + dy), (x1 - dx, y0 + dy), (x1 - dx, y1 - dy), (x0 + dx, y1 - dy)]
                out.append((k, G.to_wkb(G.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], hole))))
            yield pd.DataFrame(out, columns=["feature_id", "geometry"])

    kind = dict(box_features(spark, sf_dir).dtypes)["feature_id"]
    shapes = box_features(spark, sf_dir).mapInPandas(ring, f"feature_id {kind}, geometry binary")
    return shapes.select("feature_id", F.round(G.st_area(F.col("geometry")), 9).alias("before"), F.round(G.st_area(G.st_without_holes(F.col("geometry"))), 9).alias("after"))


@query("k3_buffer_metres", f"WITH {PTS} SELECT feature_id, 500 AS reach_m FROM pts")
def k3_buffer_metres(spark, sf_dir):
    p = points(spark, sf_dir).select("feature_id", "lon", "lat", G.st_buffer_metres(G.st_point(F.col("lon"), F.col("lat")), 500.0).alias("geometry"))
    edge = schema.with_bounds(p.select("feature_id", F.col("lon").alias("x"), F.col("lat").alias("y"), "geometry"))
    north = scalars.haversine_m(F.col("x"), F.col("y"), F.col("x"), F.col("maxy"))
    east = scalars.haversine_m(F.col("x"), F.col("y"), F.col("maxx"), F.col("y"))
    return edge.select("feature_id", F.when(F.round(north) == F.round(east), F.round(north).cast("int")).alias("reach_m"))


@query("m8_index_checks", "SELECT * FROM (VALUES ('regions', 'the regions table lacks region_id'), ('features', 'the features table lacks feature_id'), ('joint', 'the joint table lacks feature_id'), ('fine', '')) t(part, message)")
def m8_index_checks(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    f, j = r.withColumnRenamed("region_id", "feature_id"), r.withColumn("feature_id", F.col("region_id"))

    def message(*tables):
        try:
            schema.check_tables(*tables)
        except ValueError as error:
            return str(error)
        return ""

    rows = [("regions", message(f, f, j)), ("features", message(r, r, j)), ("joint", message(r, f, r)), ("fine", message(r, f, j))]
    return spark.createDataFrame(rows, "part string, message string")


# --- Polygons of any shape -------------------------------------------------------------------


def _shapes(df):
    """Boxes as WKB polygons, under their own columns."""
    return df.withColumn("geometry", spatial_join._box_wkb(""))


def _triangles(spark, sf_dir):
    """The lower left half of each box region."""

    def cut(batches):
        import pandas as pd

        for b in batches:
            rows = b[["region_id", "minx", "miny", "maxx", "maxy"]].itertuples(index=False)
            yield pd.DataFrame([(k, G.to_wkb(G.polygon([(x0, y0), (x1, y0), (x0, y1)]))) for k, x0, y0, x1, y1 in rows], columns=["region_id", "geometry"])

    r = box_regions(spark, sf_dir)
    return r.mapInPandas(cut, f"region_id {dict(r.dtypes)['region_id']}, geometry binary")


_W, _H = "greatest(0, least(r.maxx, b.maxx) - greatest(r.minx, b.minx))", "greatest(0, least(r.maxy, b.maxy) - greatest(r.miny, b.miny))"
_MEET = "r.minx <= b.maxx AND b.minx <= r.maxx AND r.miny <= b.maxy AND b.miny <= r.maxy"


@query("c2_overlay_polygons", f"WITH {REGS}, {BOXES} SELECT region_id, feature_id, round({_W} * {_H}, 10) AS area FROM regs r JOIN boxes b ON {_MEET} WHERE {_W} * {_H} > 1e-12")
def c2_overlay_polygons(spark, sf_dir):
    r, b = (_shapes(x) for x in (box_regions(spark, sf_dir), box_features(spark, sf_dir)))
    got = spatial_join.intersects_join(r, b, cell=0.05, return_geometry=True).filter("geometry is not null")
    return got.select("region_id", "feature_id", F.round(G.st_area(F.col("geometry")), 10).alias("area")).filter("area > 1e-12")


_IN_TRIANGLE = "lon > minx AND lat > miny AND (lon - minx) / (maxx - minx) + (lat - miny) / (maxy - miny) < 1 - 1e-9"


@query("c5_points_within_triangles", f"WITH {PTS}, {REGS} SELECT feature_id, region_id FROM pts JOIN regs ON {_IN_TRIANGLE}")
def c5_points_within_triangles(spark, sf_dir):
    near = spatial_join.within_join(points(spark, sf_dir).select("feature_id", "lon", "lat"), _triangles(spark, sf_dir), cell=0.05, how="inner")
    edge = box_regions(spark, sf_dir).select("region_id", "minx", "miny", "maxx", "maxy")
    off = near.join(edge, "region_id").filter("(lon - minx) / (maxx - minx) + (lat - miny) / (maxy - miny) < 1 - 1e-9")
    return off.select("feature_id", "region_id")


@query("c3_c4_features_in_triangles", f"""WITH {BOXES}, {REGS} SELECT DISTINCT feature_id FROM boxes b JOIN regs r ON {_MEET}
AND (greatest(b.minx, r.minx) - r.minx) / (r.maxx - r.minx) + (greatest(b.miny, r.miny) - r.miny) / (r.maxy - r.miny) <= 1 WHERE region_id % 3 = 0""")
def c3_c4_features_in_triangles(spark, sf_dir):
    areas = _triangles(spark, sf_dir).filter("region_id % 3 = 0")
    return spatial_join.semi_join(box_features(spark, sf_dir), areas, cell=0.05, id_col="feature_id").select("feature_id")


_BENT = [(16.85, 51.06), (17.1, 51.06), (17.1, 51.1), (16.95, 51.1), (16.95, 51.18), (16.85, 51.18)]
_PART = "greatest(0, least(maxx, {2}) - greatest(minx, {0})) * greatest(0, least(maxy, {3}) - greatest(miny, {1}))"
_BENT_AREA = f"({_PART.format(16.85, 51.06, 17.1, 51.1)} + {_PART.format(16.85, 51.1, 16.95, 51.18)})"


@query("c6_clip_bent_polygon", f"WITH {BOXES} SELECT feature_id, round({_BENT_AREA}, 10) AS area FROM boxes WHERE {_BENT_AREA} > 1e-12")
def c6_clip_bent_polygon(spark, sf_dir):
    got = spatial_join.clip_to(_shapes(box_features(spark, sf_dir)).select("feature_id", "geometry"), G.polygon(_BENT))
    return got.select("feature_id", F.round(G.st_area(F.col("geometry")), 10).alias("area")).filter("area > 1e-12")


@query("d13_polygon_union", f"WITH {REGS} SELECT CAST(region_id % 5 AS INTEGER) AS col, 1 AS parts, round(1.5 * sum((maxx - minx) * (maxy - miny)), 9) AS area FROM regs GROUP BY ALL")
def d13_polygon_union(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    half = (F.col("maxx") - F.col("minx")) / 2
    both = r.unionByName(r.withColumns({"minx": F.col("minx") + half, "maxx": F.col("maxx") + half}))
    done = spatial_join.dissolve(_shapes(both).select((F.col("region_id") % 5).cast("int").alias("col"), "geometry"), "col", parts=4)
    return done.select("col", F.size(G.st_parts(F.col("geometry"))).alias("parts"), F.round(G.st_area(F.col("geometry")), 9).alias("area"))


@query("g6_geometry_remainder", f"WITH {REGS} SELECT region_id, round((maxx - minx) * (maxy - miny) * CASE WHEN region_id % 2 = 0 THEN 0.5 ELSE 1 END, 9) AS area FROM regs WHERE region_id % 4 <> 1")
def g6_geometry_remainder(spark, sf_dir):
    r = box_regions(spark, sf_dir)
    k, half = F.col("region_id"), (F.col("maxx") + F.col("minx")) / 2
    # Even ones lose their left half, every fourth all; a hair keeps neighbours apart.
    taken = r.filter((k % 2 == 0) | (k % 4 == 1)).withColumn("maxx", F.when(k % 2 == 0, half).otherwise(F.col("maxx")))
    left = spatial_join.remainder(_shapes(r).select("region_id", "geometry"), _shapes(taken).select("geometry"), cell=0.05)
    return left.select("region_id", F.round(G.st_area(F.col("geometry")), 9).alias("area"))


@query("j4_voronoi_masked", "SELECT round((17.1 - 16.85) * 0.04 + 0.1 * 0.08, 6) AS area, count(*) AS cells FROM nation")
def j4_voronoi_masked(spark, sf_dir):
    k = F.col("n_nationkey")
    seeds = table(spark, sf_dir, "nation").select(k.alias("region_id"), (F.lit(16.856) + k * 0.0098).alias("lon"), (F.lit(51.07) + (k % 3) * 0.005).alias("lat"))
    cells = regionalizers.voronoi_polygons(seeds, step_degrees=5.0, mask=G.polygon(_BENT))
    return cells.agg(F.round(F.sum(G.st_area(F.col("geometry"))), 6).alias("area"), F.countDistinct("region_id").alias("cells"))


@query("j4a_many_regions", """SELECT c_custkey AS region_id, true AS holds_own, 0 AS holds_others, 64800.0 AS area_of_all FROM customer""")
def j4a_many_regions(spark, sf_dir):
    """Every customer a seed, most of them crowded in one corner of the map."""
    k = F.col("c_custkey")
    spread = lambda p, n: F.pmod(k * p, F.lit(n)) / F.lit(float(n))
    crowd = k % 4 > 0
    lon = F.when(crowd, spread(7919, 100_003) * 3 + 16).otherwise(spread(104_729, 1_000_003) * 359.9 - 179.95)
    lat = F.when(crowd, spread(15_485, 99_991) * 2 + 50).otherwise(spread(1_299_709, 999_983) * 178 - 89)
    seeds = table(spark, sf_dir, "customer").select(k.alias("region_id"), lon.alias("lon"), lat.alias("lat"))
    cells = written(regionalizers.voronoi_polygons(seeds, step_degrees=5.0), "cells")
    # a region across the antimeridian has a box around the map, its parts don't
    hit = spatial_join.within_join(seeds.withColumnRenamed("region_id", "seed"), regionalizers.explode_parts(cells), how="inner")
    own = F.max(F.col("seed") == F.col("region_id"))
    others = F.sum((F.col("seed") != F.col("region_id")).cast("int")).cast("int")
    area = cells.agg(F.round(F.sum(G.st_area(F.col("geometry"))), 4).alias("area_of_all"))
    return hit.groupBy("region_id").agg(own.alias("holds_own"), others.alias("holds_others")).join(F.broadcast(area))


@query("j5_empty_remainder", f"WITH {REGS} SELECT CASE WHEN region_id % 3 = 0 THEN 'EMPTY' ELSE 'kept' END AS kind, round(sum({_PART.format(16.87, 51.07, 17.0, 51.15)}), 9) AS area FROM regs GROUP BY ALL")
def j5_empty_remainder(spark, sf_dir):
    area = spark.createDataFrame([(16.87, 51.07, 17.0, 51.15)], "minx double, miny double, maxx double, maxy double")
    some = _shapes(_boundaries(spark, sf_dir).filter("element_id % 3 <> 0"))
    got = regionalizers.administrative_regions(some, area, admin_level=4, cell=0.05, clip_to_area=True, fill_empty=True, least_share=0.0)
    kind = F.when(F.col("region_id") == "EMPTY", "EMPTY").otherwise("kept")
    return got.groupBy(kind.alias("kind")).agg(F.round(F.sum(G.st_area(F.col("geometry"))), 9).alias("area"))


_BUFFERS = (400.0, 1000.0, 2500.0)
_EDGES_SQL = ", ".join(f"(CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for a, b in zip(_BENT, [*_BENT[1:], _BENT[0]], strict=True))
_METRES = (math.cos(math.radians(51.12)) * math.radians(1) * 6371008.8, math.radians(1) * 6371008.8)


@query("j5_shared_borders", """SELECT count(*) AS regions, round(0.38 * 0.17, 9) AS area, CAST(0 AS DOUBLE) AS overlap, true AS thinner FROM nation""")
def j5_shared_borders(spark, sf_dir):
    """A country of winding inner borders, simplified: nothing is lost between neighbours and nothing counts twice."""
    from geoloom.operators.borders import simplify_shared

    def winding(batches):
        import numpy as np
        import pandas as pd

        def side(a, b, inner):  # the same corners from either side
            t = np.linspace(0, 1, 61)[:, None]
            lo, hi = min(a, b), max(a, b)
            line = np.array(lo) + t * (np.array(hi) - np.array(lo))
            if inner:
                across = np.array([hi[1] - lo[1], lo[0] - hi[0]])
                line += np.sin(np.pi * t) * (0.06 * np.sin(19 * t + 900 * lo[0]) + 0.01 * np.sin(97 * t + 500 * lo[1])) * across
            line[0], line[-1] = lo, hi
            return line if a <= b else line[::-1]

        for b in batches:
            out = []
            for r in b.itertuples():
                x0, y0, x1, y1 = r.minx, r.miny, r.maxx, r.maxy
                sides = [((x0, y0), (x1, y0), y0 > 51.0401), ((x1, y0), (x1, y1), x1 < 17.1799), ((x1, y1), (x0, y1), y1 < 51.2099), ((x0, y1), (x0, y0), x0 > 16.8001)]
                out.append((r.region_id, G.to_wkb(G.polygon(np.vstack([side(*s)[:-1] for s in sides])))))
            yield pd.DataFrame(out, columns=["region_id", "geometry"])

    shapes = written(box_regions(spark, sf_dir).mapInPandas(winding, "region_id int, geometry binary"), "winding")
    thin = written(simplify_shared(shapes, 0.002), "thin")
    fewer = shapes.agg(F.sum(F.length("geometry")).alias("before")).crossJoin(thin.agg(F.sum(F.length("geometry")).alias("after"))).select((F.col("after") * 3 < F.col("before")).alias("thinner"))
    other = thin.withColumnRenamed("region_id", "feature_id")
    shared = spatial_join.intersects_join(thin, other, return_geometry=True).filter("region_id < feature_id and geometry is not null")
    overlap = shared.agg(F.round(F.coalesce(F.sum(G.st_area(F.col("geometry"))), F.lit(0.0)), 9).alias("overlap"))
    whole = thin.agg(F.countDistinct("region_id").alias("regions"), F.round(F.sum(G.st_area(F.col("geometry"))), 9).alias("area"))
    return whole.crossJoin(F.broadcast(overlap)).crossJoin(F.broadcast(fewer))


@query("k3_buffer_bent_shape", f"""WITH {PTS}, e AS (SELECT * FROM (VALUES {_EDGES_SQL}) t(x0, y0, x1, y1)),
s AS (SELECT feature_id, lon, lat, (lon - x0) * {_METRES[0]!r} AS px, (lat - y0) * {_METRES[1]!r} AS py, (x1 - x0) * {_METRES[0]!r} AS dx, (y1 - y0) * {_METRES[1]!r} AS dy FROM pts, e),
t AS (SELECT *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM s),
o AS (SELECT feature_id, CASE WHEN lon BETWEEN 16.85 AND 17.1 AND lat BETWEEN 51.06 AND 51.1 OR lon BETWEEN 16.85 AND 16.95 AND lat BETWEEN 51.1 AND 51.18 THEN 0
  ELSE min(sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))) END AS off FROM t GROUP BY feature_id, lon, lat)
SELECT feature_id, CAST(far AS DOUBLE) AS far, off <= far AS inside FROM o, (VALUES {", ".join(f"({x})" for x in _BUFFERS)}) b(far) WHERE abs(off - far) > 0.01 * far + 60""")
def k3_buffer_bent_shape(spark, sf_dir):
    """Places around a bent polygon: those within a distance of its edges, or inside it, and no others lie in its buffer; those next to the buffer's edge aren't asked."""
    p = points(spark, sf_dir).select("feature_id", "lon", "lat")
    sx, sy = _METRES
    away = None
    for a, b in zip(_BENT, [*_BENT[1:], _BENT[0]], strict=True):
        px, py, dx, dy = (F.col("lon") - a[0]) * sx, (F.col("lat") - a[1]) * sy, (b[0] - a[0]) * sx, (b[1] - a[1]) * sy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
        d = F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
        away = d if away is None else F.least(away, d)
    whole = F.lit(bytearray(G.to_wkb(G.polygon(_BENT))))
    off = F.when(G.st_holds(whole, F.col("lon"), F.col("lat")), 0.0).otherwise(F.col("_away"))
    p = p.withColumn("_away", away).withColumn("_off", off)
    out = None
    for far in _BUFFERS:
        grown = F.lit(bytearray(G.to_wkb(G.buffer_metres(G.polygon(_BENT), far, arcs=64))))
        part = p.filter(F.abs(F.col("_off") - far) > 0.01 * far + 60).select("feature_id", F.lit(far).alias("far"), G.st_holds(grown, F.col("lon"), F.col("lat")).alias("inside"))
        out = part if out is None else out.unionByName(part)
    return out
