import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from geoloom import optional, schema
from geoloom.errors import EmptyDataError
from geoloom.functions import geometry as G
from geoloom.sources import datasets, files, gtfs, osm


def test_geoparquet_round_trip(spark, tmp_path):
    shapes = [("a", G.box(0, 0, 1, 1)), ("b", G.point(5, 5)), ("c", G.box(0.5, 0.5, 3, 3))]
    df = spark.createDataFrame([(k, bytearray(G.to_wkb(g)), len(k)) for k, g in shapes], "name string, geometry binary, extra int")
    path = files.write_geoparquet(df, str(tmp_path / "g"))
    got = files.read_geoparquet(spark, path, index_column="name", columns=["extra"], area=(0.0, 0.0, 2.0, 2.0))
    assert rows(got, "feature_id") == [("a",), ("c",)] and set(got.columns) >= {"feature_id", "extra", "geometry"}
    assert {r["feature_id"]: G.area(G.from_wkb(bytes(r["geometry"]))) for r in got.collect()} == {"a": 1, "c": 2.25}
    with pytest.raises(ValueError):
        files.read_geoparquet(spark, path, index_column="none")
    with pytest.raises(EmptyDataError):
        files.require_rows(got.filter("false"), "area")


def test_csv_becomes_parquet_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,year\n1,2020\n2,2021\n")
    target = str(tmp_path / "p")
    assert files.csv_to_parquet(spark, str(tmp_path / "a.csv"), target, where="year > 2020").count() == 1
    (tmp_path / "a.csv").write_text("id,year\n")
    assert files.csv_to_parquet(spark, str(tmp_path / "a.csv"), target).count() == 1


def test_plt_logs(spark, tmp_path):
    folder = tmp_path / "000" / "Trajectory"
    folder.mkdir(parents=True)
    head = "Trajectory log\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"
    (folder / "t1.plt").write_text(head + "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04\n39.8,116.2,0,490,39744.2,2008-10-23,02:53:10\n")
    got = files.read_plt(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["user_id"], r["trip_id"], r["lon"], r["altitude"]) for r in got] == [("000", "000_t1", 116.3, 492.0), ("000", "000_t1", 116.2, 490.0)]


def test_download_keeps_and_replaces(tmp_path):
    import io

    calls = []

    def opener(url):
        calls.append(url)
        return io.BytesIO(b"x" * 10)

    path = str(tmp_path / "d" / "f")
    files.download_file("u", path, opener=opener)
    files.download_file("u", path, force=False, opener=opener)
    assert len(calls) == 1
    files.download_file("u", path, chunk_bytes=3, opener=opener)
    assert len(calls) == 2 and (tmp_path / "d" / "f").read_bytes() == b"x" * 10


def test_gtfs(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_text("trip_id,departure_time,stop_id\n1,12:00:00,42\n1,12:10:00,76\n2,13:00:00,42\n2,13:10:00,76\n2,,76\n")
    (tmp_path / "trips.txt").write_text("trip_id,trip_headsign\n1,A\n2,B\n")
    (tmp_path / "stops.txt").write_text("stop_id,stop_lat,stop_lon\n42,51.1,17.0\n76,51.2,17.1\n")
    feed = gtfs.read_feed(spark, str(tmp_path))
    series = spark.createDataFrame([("42", 12, 0), ("42", 13, 2), ("76", 12, 12), ("76", 13, 12)], "stop_id string, hour int, num_trips int")
    got = gtfs.stop_features(feed, series=series)
    assert set(got.columns) == {"feature_id", "lon", "lat", "trips_at_12", "trips_at_13", "directions_at_12", "directions_at_13"}
    by = {r["feature_id"]: r for r in got.collect()}
    assert by["42"]["trips_at_12"] == 0 and by["76"]["trips_at_13"] == 12 and by["42"]["directions_at_13"] == ["B"]
    assert gtfs.stop_features(feed).count() == 2
    report = spark.createDataFrame([("warning", "w"), ("error", "e")], "type string, message string")
    with pytest.raises(ValueError):
        gtfs.validate(report)
    assert len(gtfs.validate(report, fail=False)) == 2


def test_osm_extract(spark, tmp_path):
    df = spark.createDataFrame(
        [("node", 1, {"amenity": "pub", "name": "x"}, 17.0, 51.0), ("node", 2, {"amenity": "bank"}, 17.1, 51.0), ("way", 3, {"building": "yes"}, 40.0, 10.0), ("way", 4, {"other": "1"}, 17.0, 51.0)],
        "element string, id long, tags map<string,string>, lon double, lat double",
    )
    schema.with_bounds(df).write.parquet(str(tmp_path / "e"))
    path, tags = str(tmp_path / "e"), {"amenity": ["pub", "bank"], "building": True, "leisure": True}
    wide = osm.read_extract(spark, path, tags)
    assert "leisure" not in wide.columns and rows(wide, "feature_id") == [("node/1",), ("node/2",), ("way/3",)]
    assert rows(osm.read_extract(spark, path, tags, area=(16.0, 50.0, 18.0, 52.0)), "feature_id") == [("node/1",), ("node/2",)]
    assert "name" in osm.read_extract(spark, path, tags, keep_all_tags=True).columns
    assert osm.read_extract(spark, path, tags, explode_tags=False).first()["tags"]
    groups = osm.read_extract(spark, path, {"food": {"amenity": "pub"}, "house": {"building": True}}, grouped=True)
    assert rows(groups.select("feature_id", F.coalesce("food", "house").alias("t")), "feature_id", "t") == [("node/1", "amenity=pub"), ("way/3", "building=yes")]


def test_online_features_merge_first_values(spark):
    def fetch(area, key, value):
        if key == "amenity":
            return [{"element": "node", "id": 1, "amenity": value, "building": None}]
        return [{"element": "node", "id": 1, "amenity": None, "building": "yes"}, {"element": "way", "id": 2, "amenity": None, "building": "yes"}]

    got = osm.fetch_features(spark, ["here"], {"amenity": ["pub", "bar"], "building": True}, fetch, "element string, id long, amenity string, building string")
    assert rows(got, "feature_id", "amenity", "building") == [("node/1", "pub", "yes"), ("way/2", None, "yes")]


def test_cached_query(tmp_path):
    calls = []

    def run(q):
        calls.append(q)
        if len(calls) == 1:
            raise TimeoutError
        return {"a": 1}

    assert osm.cached_query("q", str(tmp_path), run, wait=0) == {"a": 1}
    assert osm.cached_query("q", str(tmp_path), run) == {"a": 1} and len(calls) == 2
    assert json.loads(next(tmp_path.iterdir()).read_text()) == {"a": 1}


def test_roads(spark):
    e = spark.createDataFrame([(1, ["2", "3.7"], "30 mph"), (2, ["17"], "signals")], "feature_id int, lanes array<string>, maxspeed string")
    long = osm.road_features(e, ["lanes", "maxspeed"])
    assert rows(long, "feature_id", "lanes", "maxspeed") == [(1, "2", "50"), (1, "3", "50"), (2, "15", "None")]
    wide = osm.road_features(e, ["lanes", "maxspeed"], wide={"lanes": ["2", "15", "9"], "maxspeed": ["50"]})
    assert rows(wide, "feature_id", "lanes-2", "lanes-15", "lanes-9", "maxspeed-50") == [(1, 1, 0, 0, 1), (2, 0, 1, 0, 0)]
    assert {t.value for t in osm.NetworkType} == {"all_private", "all", "bike", "drive", "drive_service", "walk"}


def test_tiles(spark, tmp_path):
    def tile_bytes(x, y, z):
        return f"{x}/{y}/{z}".encode()

    area = spark.createDataFrame([(16.9, 51.08, 16.95, 51.1)], "minx double, miny double, maxx double, maxy double")
    got = osm.load_tiles(area, 11, tile_bytes).collect()
    assert all(bytes(r["tile"]) == tile_bytes(r["x"], r["y"], 11) for r in got)
    saved = osm.load_tiles(area, 11, tile_bytes, save_to=str(tmp_path / "t")).first()
    assert open(saved["tile"], "rb").read() == tile_bytes(saved["x"], saved["y"], 11)


def test_geocoder(spark):
    hit = {"display_name": "Town", "minx": 1, "miny": 2, "maxx": 3, "maxy": 4}
    assert osm.geocode(spark, ["t"], lambda q: [hit]).first()["region_id"] == "Town"
    with pytest.raises(ValueError):
        osm.geocode(spark, ["t"], lambda q: [])


def test_overture(spark, tmp_path):
    a = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, True, None)], "feature_id string, minx double, miny double, maxx double, maxy double, x boolean, y boolean")
    b = spark.createDataFrame([("b", 0.0, 0.0, 1.0, 1.0, True)], "feature_id string, minx double, miny double, maxx double, maxy double, z boolean")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    got = osm.read_overture(spark, [str(tmp_path / "a"), str(tmp_path / "b")], keep_empty=False)
    assert got.count() == 2 and got.columns[-2:] == ["x", "z"]


def test_datasets(spark, tmp_path):
    pts = spark.createDataFrame([(k, 17.0 + (k % 40) / 100, 51.0 + (k // 40) / 100, float(k)) for k in range(800)], "id int, longitude double, latitude double, price double")
    ready = datasets.prepare_points(pts, datasets.AIRBNB)
    assert ready.count() == 720
    ds = datasets.PointDataset(ready, datasets.AIRBNB, version="9")
    with pytest.raises(ValueError):
        ds.train_test_split(zoom=5)
    done = ds.train_test_split()
    with pytest.raises(ValueError):
        ds.train_test_split()
    assert done.count() == 720 and ds.labels().filter("split = 'test'").count() > 0
    counted = datasets.PointDataset(ready.drop("price"), datasets.CHICAGO, version="8")
    counted.train_test_split()
    lab = [r["label"] for r in counted.labels().collect()]
    assert min(lab) >= 0 and max(lab) <= 1
    with pytest.raises(ValueError):
        datasets.PointDataset(ready, datasets.AIRBNB, version="7")
    done.filter("split = 'train'").drop("split").write.parquet(str(tmp_path / "d/train"))
    done.filter("split = 'test'").drop("split").write.parquet(str(tmp_path / "d/test"))
    assert datasets.read_splits(spark, str(tmp_path / "d")).count() == 720
    trips = spark.createDataFrame([(t, k, 17.0 + 0.01 * ((t * k) % 17), 51.0 + 0.01 * (k % 5)) for t in range(1, 31) for k in range(20)], "trip_id int, s int, lon double, lat double").withColumn("ts", F.timestamp_seconds("s"))
    for version in ("TTE", "HMP"):
        d = datasets.TrajectoryDataset(trips, version, zoom=14)
        seqs = d.sequences()
        split = d.train_test_split(seqs)
        assert 0 < seqs.count() <= 30 and split.count() == seqs.count() and split.filter("split = 'test'").count() > 0


def test_optional_import():
    assert optional.optional_import("std", "json") is json
    assert optional.optional_import("x", "no_such_module_here", missing="ignore") is None
    with pytest.raises(ImportError):
        optional.optional_import("x", "no_such_module_here")


def test_roles(spark):
    df = spark.createDataFrame([(1, "a")], "k int, n string")
    assert schema.to_regions(df, "n").columns == ["k", "region_id"]
    assert "feature_id" in schema.to_features(df).columns
    with pytest.raises(ValueError):
        schema.to_regions(df, "none")
    with pytest.raises(ValueError):
        schema.not_empty(df.filter("false"), "regions table")


def test_pbf_blocks_round_trip(spark, tmp_path):
    from geoloom.sources import pbf

    nodes = [("node", k * (-1) ** k * 10**9, {"a": f"v{k}"} if k % 2 else {}, 17 + k / 1e4, -51 - k / 1e4, None) for k in range(1, 20)]
    ways = [("way", 7, {"highway": "residential", "name": "Żółta"}, None, None, [5, 3, 2**40, 4])]
    got = list(pbf.decode_block(pbf.encode_block(nodes + ways)))
    assert [r[:3] for r in got] == [r[:3] for r in nodes + ways] and got[-1][5] == ways[0][5]
    assert all(abs(a[3] - b[3]) < 1e-7 and abs(a[4] - b[4]) < 1e-7 for a, b in zip(got, nodes, strict=False))
    relation = pbf._message((1, pbf._message((1, b""), (1, b"outer"), (1, b"type"), (1, b"site"))), (2, pbf._message((4, pbf._message((1, 9), (2, b"\x02"), (3, b"\x03"), (8, b"\x01\x00"), (9, pbf._zigzag([5, -2])), (10, b"\x01\x00"))))))
    assert list(pbf.decode_block(relation)) == [("relation", 9, {"type": "site"}, None, None, None, [{"type": "way", "ref": 5, "role": "outer"}, {"type": "node", "ref": 3, "role": ""}])]
    df = spark.createDataFrame(nodes + ways, "element string, id long, tags map<string,string>, lon double, lat double, refs array<long>").repartition(3)
    folder = pbf.write_pbf(df, str(tmp_path / "pbf"))
    back = pbf.read_pbf(spark, f"{folder}/*.pbf")
    assert rows(back, "element", "id") == sorted((r[0], r[1]) for r in nodes + ways)


def test_geoparquet_keeps_neighbours_together(spark, tmp_path):
    import pyarrow.parquet as pq
    from geoloom.functions import grid

    xy = [(float(x), float(y)) for x in range(8) for y in range(8)]
    cells = spark.createDataFrame(xy, "x double, y double").select("x", "y", grid.hilbert((F.col("x") + 0.5) * 45 - 180, (F.col("y") + 0.5) * 22.5 - 90, 3).alias("d")).orderBy("d").collect()
    assert [r["d"] for r in cells] == list(range(64))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(cells, cells[1:], strict=False))
    k = F.col("id")
    points = spark.range(40_000).select(k, (17 + (k * 7919) % 40_009 / 400_090.0).alias("lon"), (51 + (k * 104_729) % 39_989 / 399_890.0).alias("lat"))
    path = files.write_geoparquet(points.repartition(40), f"{tmp_path}/ordered", row_group_bytes=4_096)
    area = (17.03, 51.03, 17.04, 51.04)  # 1 % of the places
    parts = [pq.ParquetFile(f).metadata for f in (tmp_path / "ordered").glob("*.parquet")]
    groups = [m.row_group(g) for m in parts for g in range(m.num_row_groups)]

    def meets(g):
        least = {c.path_in_schema: c.statistics for c in map(g.column, range(g.num_columns))}
        return least["minx"].min <= area[2] and least["maxx"].max >= area[0] and least["miny"].min <= area[3] and least["maxy"].max >= area[1]

    assert len(groups) > 100 and sum(map(meets, groups)) <= 0.05 * len(groups)
    got = spark.read.parquet(path).filter(f"lon between {area[0]} and {area[2]} and lat between {area[1]} and {area[3]}")
    want = points.filter(f"lon between {area[0]} and {area[2]} and lat between {area[1]} and {area[3]}")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()) and want.count() > 200


def test_logs_are_listed_and_read_by_tasks(spark, tmp_path):
    """No job of the driver lists each file; lines may end either way, other files are passed over."""
    for user in range(40):
        folder = tmp_path / str(user) / "Trajectory"
        folder.mkdir(parents=True)
        end = "\r\n" if user % 2 else "\n"
        for trip in ("a", "b"):
            lines = ["a log", "0,2,255,track,0,0,2,8421376", *[f"51.{k},17.{user},0,100,39000.5,2024-01-0{k + 1},00:00:0{k}" for k in range(3)]]
            (folder / f"{trip}.plt").write_text(end.join(lines), newline="")
        (folder / "_c.plt.part").write_text("51.0,17.0,0,100,39000.5,2024-01-01,00:00:00")
    (tmp_path / "labels.txt").write_text("none")
    got = files.read_plt(spark, str(tmp_path))
    counts = {(r["user_id"], r["trip_id"]): r["count"] for r in got.groupBy("user_id", "trip_id").count().collect()}
    assert counts == {(str(u), f"{u}_{t}"): 3 for u in range(40) for t in "ab"}
    assert got.filter("ts is null or lon is null").count() == 0 and "Scan text" not in got._jdf.queryExecution().executedPlan().toString()
