"""Queries: trajectories, splits, labels, evaluators, learned embedders, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import grid
from geoloom.operators import evaluate, labels, splits, trajectories
from geoloom.plans.inputs import PTS, TRACKS, points, query, sql_id, sql_tiled, sql_x, sql_y, table, tiled, track_points

Z = 13
_CELLS = f"""{TRACKS}, xy AS (SELECT *, {sql_x('lon', Z)} AS x, {sql_y('lat', Z)} AS y FROM tracks),
lg AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM xy WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id)),
cells AS (SELECT trip_id, ts, event_id, value, x, y FROM lg WHERE px IS NULL OR x <> px OR y <> py)"""


def _cells(spark, sf_dir):
    return trajectories.to_cells(track_points(spark, sf_dir), trip="trip_id", order="ts", zoom=Z, metric="value", tie="event_id")


@query("d11_build_trajectories", "SELECT user_id AS trip_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events GROUP BY user_id HAVING count(*) > 1")
def d11_build_trajectories(spark, sf_dir):
    t = trajectories.build(track_points(spark, sf_dir), trip="trip_id", order="ts", columns=["lon", "lat"])
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.select("trip_id", F.size("points").cast("long").alias("n"), us(F.col("points")[0]["ts"]).alias("first"), us(F.element_at("points", -1)["ts"]).alias("last"))


@query("e1_consecutive_cells", f"WITH {_CELLS} SELECT trip_id, event_id, x, y FROM cells")
def e1_consecutive_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("trip_id", "event_id", "x", "y")


#: All events as one trip, in parts.
_ONE = _CELLS.replace("PARTITION BY trip_id ORDER BY", "ORDER BY")
_ONE_TRIP = {"trip": "trip_id", "order": "ts", "tie": "event_id", "part_rows": 5_000}


def _one_trip(spark, sf_dir):
    return track_points(spark, sf_dir).withColumn("trip_id", F.lit(0))


@query("e1_one_long_trip", f"WITH {_ONE} SELECT event_id, x, y FROM cells")
def e1_one_long_trip(spark, sf_dir):
    return trajectories.to_cells(_one_trip(spark, sf_dir), zoom=Z, **_ONE_TRIP).select("event_id", "x", "y")


@query("b3_one_long_trip", f"""WITH {TRACKS}, d AS (SELECT lon - lag(lon) OVER w AS dx, lat - lag(lat) OVER w AS dy FROM tracks WINDOW w AS (ORDER BY ts, event_id))
SELECT round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)), 5) AS length FROM d""")
def b3_one_long_trip(spark, sf_dir):
    return trajectories.line_lengths(_one_trip(spark, sf_dir), **_ONE_TRIP).select(F.round("length", 5).alias("length"))


_FILL = f"""{_CELLS}, nx AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS k, count(*) OVER (PARTITION BY trip_id) AS m FROM cells WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id)),
st AS (SELECT *, CASE WHEN nx IS NULL THEN 0 ELSE greatest(abs(nx - x), abs(ny - y)) END AS n FROM nx),
ex AS (SELECT *, unnest(generate_series(0, CASE WHEN nx IS NULL THEN 0 WHEN k = m - 1 THEN n ELSE n - 1 END)) AS j FROM st),
fill AS (SELECT trip_id, event_id, k, j, CASE WHEN nx IS NULL THEN x ELSE CAST(x + floor(CAST(2 * j * (nx - x) + n AS DOUBLE) / CAST(2 * greatest(n, 1) AS DOUBLE)) AS BIGINT) END AS x,
  CASE WHEN nx IS NULL THEN y ELSE CAST(y + floor(CAST(2 * j * (ny - y) + n AS DOUBLE) / CAST(2 * greatest(n, 1) AS DOUBLE)) AS BIGINT) END AS y FROM ex),
seq AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY k, j) AS seq FROM fill)"""


def _filled(spark, sf_dir):
    return trajectories.fill_gaps(_cells(spark, sf_dir), trip="trip_id", order="ts", tie="event_id", points=track_points(spark, sf_dir))


@query("e2_gap_interpolation", f"WITH {_FILL} SELECT trip_id, event_id, x, y, CAST(seq AS INTEGER) AS seq FROM seq")
def e2_gap_interpolation(spark, sf_dir):
    return _filled(spark, sf_dir).select("trip_id", "event_id", "x", "y", "seq")


_FILL_ONE = _FILL.replace(_CELLS, _ONE).replace("PARTITION BY trip_id ORDER BY", "ORDER BY").replace("PARTITION BY trip_id", "")


@query("e2_one_long_trip", f"WITH {_FILL_ONE} SELECT event_id, x, y, CAST(seq AS INTEGER) AS seq FROM seq")
def e2_one_long_trip(spark, sf_dir):
    cells = trajectories.to_cells(_one_trip(spark, sf_dir), zoom=Z, **_ONE_TRIP)
    return trajectories.fill_gaps(cells, points=_one_trip(spark, sf_dir), **_ONE_TRIP).select("event_id", "x", "y", "seq")


@query("n6_one_long_trip", f"WITH {_FILL_ONE}, s AS (SELECT list({sql_id('x', 'y', Z)} ORDER BY seq) AS cells FROM seq) SELECT md5(array_to_string(cells, ',')) AS h, CAST(len(cells) AS INTEGER) AS n FROM s")
def n6_one_long_trip(spark, sf_dir):
    cells = trajectories.to_cells(_one_trip(spark, sf_dir), zoom=Z, **_ONE_TRIP)
    filled = trajectories.fill_gaps(cells, points=_one_trip(spark, sf_dir), **_ONE_TRIP)
    return trajectories.sequences(filled, trip="trip_id", zoom=Z, part_rows=5_000).select(F.md5(F.array_join("cells", ",")).alias("h"), F.size("cells").alias("n"))


_SEQ = f"{_FILL}, s AS (SELECT trip_id, list({sql_id('x', 'y', Z)} ORDER BY seq) AS cells FROM seq GROUP BY trip_id)"


def _sequences(spark, sf_dir):
    return trajectories.sequences(_filled(spark, sf_dir), trip="trip_id", zoom=Z)


@query("n6_cell_sequences", f"WITH {_SEQ} SELECT trip_id, md5(array_to_string(cells, ',')) AS h, CAST(len(cells) AS INTEGER) AS n FROM s")
def n6_cell_sequences(spark, sf_dir):
    return _sequences(spark, sf_dir).select("trip_id", F.md5(F.array_join("cells", ",")).alias("h"), F.size("cells").alias("n"))


@query("d17_distinct_in_sequence", f"WITH {_SEQ} SELECT trip_id, CAST(len(list_distinct(cells)) AS INTEGER) AS n FROM s")
def d17_distinct_in_sequence(spark, sf_dir):
    return _sequences(spark, sf_dir).select("trip_id", F.size(F.array_distinct("cells")).alias("n"))


@query("e5_sequence_split", f"""WITH {_SEQ}, k AS (SELECT *, CAST(floor(len(cells) * CAST(0.85 AS DOUBLE)) AS INTEGER) AS a, len(cells) AS n FROM s),
c AS (SELECT *, CASE WHEN a = n THEN n - 1 ELSE a END AS b FROM k)
SELECT trip_id, CAST(b AS INTEGER) AS head, CAST(n - b AS INTEGER) AS tail, cells[b + 1] AS target FROM c WHERE b > 0 AND n - b > 0""")
def e5_sequence_split(spark, sf_dir):
    t = trajectories.mobility_task(_sequences(spark, sf_dir))
    return t.select("trip_id", F.size("x_cells").alias("head"), F.size("y_cells").alias("tail"), F.col("y_cells")[0].alias("target"))


@query("e7_durations", "SELECT user_id AS trip_id, CASE WHEN count(*) < 2 THEN 0 ELSE (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) END AS seconds FROM events GROUP BY user_id")
def e7_durations(spark, sf_dir):
    t = track_points(spark, sf_dir).groupBy("trip_id").agg(F.collect_list("ts").alias("times"))
    return t.select("trip_id", trajectories.duration_seconds(F.col("times")).alias("seconds"))


@query("b12_valid_sequences", f"""WITH {_SEQ}, d AS (SELECT user_id AS trip_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id) SELECT trip_id FROM s JOIN d USING (trip_id) WHERE us > 0 AND len(cells) > 0""")
def b12_valid_sequences(spark, sf_dir):
    t = track_points(spark, sf_dir).groupBy("trip_id").agg(F.collect_list("ts").alias("times"))
    timed = _sequences(spark, sf_dir).join(t.select("trip_id", trajectories.duration_seconds(F.col("times")).alias("duration")), "trip_id")
    return trajectories.travel_time_task(timed).select("trip_id")


_LEN = f"""{TRACKS}, d AS (SELECT trip_id, lon - lag(lon) OVER w AS dx, lat - lag(lat) OVER w AS dy FROM tracks WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id)),
l AS (SELECT trip_id, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) AS length FROM d GROUP BY trip_id)"""


@query("b3_line_length_filter", f"WITH {_LEN}, q AS (SELECT quantile_cont(length, 0.05) AS lo, quantile_cont(length, 0.95) AS hi FROM l) SELECT trip_id, round(length, 6) AS length FROM l, q WHERE length BETWEEN lo AND hi")
def b3_line_length_filter(spark, sf_dir):
    from geoloom.operators.filters import within_quantiles

    lengths = trajectories.line_lengths(track_points(spark, sf_dir), trip="trip_id", order="ts", tie="event_id")
    return within_quantiles(lengths, F.col("length")).select("trip_id", F.round("length", 6).alias("length"))


@query("f4_truncated_sequences", f"WITH {_SEQ} SELECT trip_id, array_to_string(cells[1:5], ',') AS head FROM s")
def f4_truncated_sequences(spark, sf_dir):
    return _sequences(spark, sf_dir).select("trip_id", F.array_join(F.slice("cells", 1, 5), ",").alias("head"))


@query("d12_cell_bucket_histogram", f"""WITH {sql_tiled(12)}, q AS (SELECT list_sort(list_distinct([quantile_cont(value, 0.0), quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 1.0)])) AS e FROM pts),
b AS (SELECT region_id AS cell, greatest(len(list_filter(e, lambda v: v < value)) - 1, 0) AS bucket FROM tiled, q) SELECT cell, CAST(bucket AS VARCHAR) AS bucket, count(*) AS points FROM b GROUP BY ALL""")
def d12_cell_bucket_histogram(spark, sf_dir):
    return splits.cell_statistics(points(spark, sf_dir), zoom=12, target="value", bins=4)


@query("e3_quantile_bins", """WITH q AS (SELECT list_sort(list_distinct([quantile_cont(c_acctbal, 0.0), quantile_cont(c_acctbal, 0.2), quantile_cont(c_acctbal, 0.4), quantile_cont(c_acctbal, 0.6), quantile_cont(c_acctbal, 0.8), quantile_cont(c_acctbal, 1.0)])) AS e FROM customer)
SELECT c_custkey, CAST(greatest(len(list_filter(e, lambda v: v < c_acctbal)) - 1, 0) AS INTEGER) AS bucket FROM customer, q""")
def e3_quantile_bins(spark, sf_dir):
    return splits.quantile_bins(table(spark, sf_dir, "customer"), "c_acctbal", 5).select("c_custkey", "bucket")


@query("e4_width_bins", """WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, CAST((CASE WHEN c_acctbal > lo + (hi - lo) * 1 / 4.0 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal > lo + (hi - lo) * 2 / 4.0 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal > lo + (hi - lo) * 3 / 4.0 THEN 1 ELSE 0 END) AS INTEGER) AS bucket FROM customer, m""")
def e4_width_bins(spark, sf_dir):
    return splits.width_bins(table(spark, sf_dir, "customer"), "c_acctbal", 4).select("c_custkey", "bucket")


@query("n1a_split_report", """WITH s AS (SELECT c_mktsegment AS seg, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer),
p AS (SELECT seg, split, count(*) AS points FROM s GROUP BY ALL), r AS (SELECT *, round(points / CAST(sum(points) OVER (PARTITION BY seg) AS DOUBLE), 5) AS ratio FROM p)
SELECT *, round(ratio - CASE WHEN split = 'test' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END, 5) AS difference FROM r""")
def n1a_split_report(spark, sf_dir):
    s = points(spark, sf_dir).withColumn("split", F.when(F.col("feature_id") % 5 == 0, "test").otherwise("train"))
    return splits.split_report(s, "seg", {"train": 0.8, "test": 0.2})


@query("n3_hex_labels", f"WITH {sql_tiled(12)} SELECT region_id, round(avg(value), 6) AS label FROM tiled GROUP BY region_id")
def n3_hex_labels(spark, sf_dir):
    return labels.hex_labels(points(spark, sf_dir), zoom=12, target="value").select("region_id", F.round("label", 6).alias("label"))


@query("d10_hex_counts", f"WITH {sql_tiled(12)} SELECT region_id, CAST(count(*) AS DOUBLE) AS label FROM tiled GROUP BY region_id")
def d10_hex_counts(spark, sf_dir):
    return labels.hex_labels(points(spark, sf_dir), zoom=12)


@query("n4_stratified_split", """WITH o AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), '|7')), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM o""")
def n4_stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", test=0.2, seed=7).select("c_custkey", "split")


@query("n5_point_dataset", f"""WITH {PTS}, q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM pts) SELECT feature_id, lon, lat, value FROM pts, q WHERE value BETWEEN lo AND hi""")
def n5_point_dataset(spark, sf_dir):
    from geoloom.sources.datasets import AIRBNB, prepare_points

    return prepare_points(points(spark, sf_dir).withColumnRenamed("value", AIRBNB.target), AIRBNB, lon="lon", lat="lat").select("feature_id", "lon", "lat", F.col(AIRBNB.target).alias("value"))


_METRICS = "round(avg((p - t) * (p - t)), 6) AS mse, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(avg(abs((t - p) / (t + 1e-10)) * 100), 6) AS mape, round(avg(abs(p - t) * 2 / (abs(p) + abs(t) + 1e-10) * 100), 6) AS smape"


@query("n7_hex_regression", f"""WITH {sql_tiled(12)}, v AS (SELECT region_id, CAST(count(*) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) + (min(feature_id) % 5 - 2) AS p FROM tiled GROUP BY region_id)
SELECT {_METRICS}, round(1 - sum((p - t) * (p - t)) / (var_pop(t) * count(t)), 6) AS r2 FROM v""")
def n7_hex_regression(spark, sf_dir):
    t = tiled(spark, sf_dir, 12).groupBy("region_id").agg(F.count(F.lit(1)).cast("double").alias("label"), F.min("feature_id").alias("k"))
    p = t.select("region_id", (F.col("label") + (F.col("k") % 5 - 2)).alias("prediction"))
    out = evaluate.hex_regression(t.select("region_id", "label"), p)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("n8_trajectory_regression", f"""WITH d AS (SELECT user_id AS trip_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS t FROM events GROUP BY user_id),
v AS (SELECT t, t + (trip_id % 9 - 4) * 60 AS p FROM d WHERE trip_id % 10 <> 0) SELECT {_METRICS} FROM v""")
def n8_trajectory_regression(spark, sf_dir):
    t = track_points(spark, sf_dir).groupBy("trip_id").agg(F.collect_list("ts").alias("times")).select("trip_id", trajectories.duration_seconds(F.col("times")).alias("label"))
    p = t.filter("trip_id % 10 <> 0").select("trip_id", (F.col("label") + (F.col("trip_id") % 9 - 4) * 60).alias("prediction"))
    out = evaluate.trajectory_regression(t, p)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("n9_mobility_accuracy", f"""WITH {_SEQ}, z AS (SELECT trip_id, cells, list_transform(cells, lambda c, i: CASE WHEN i % 3 = 0 THEN 'x' ELSE c END) AS guess FROM s),
a AS (SELECT CASE WHEN len(cells) >= 10 THEN cells[1:10] ELSE cells END AS t, CASE WHEN len(cells) >= 10 THEN guess[1:10] ELSE guess END AS p FROM z)
SELECT round(avg(len(list_filter(list_zip(t, p), lambda v: v[1] = v[2])) / CAST(least(len(t), len(p)) AS DOUBLE)), 6) AS accuracy FROM a""")
def n9_mobility_accuracy(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    guess = F.transform("cells", lambda c, i: F.when((i + 1) % 3 == 0, "x").otherwise(c))
    out = evaluate.mobility_metrics(s.select(F.col("cells").alias("true_cells"), guess.alias("predicted_cells")), k=10)
    return out.select(F.round("accuracy", 6).alias("accuracy"))


@query("n11_sequence_accuracy", f"WITH {_SEQ} SELECT trip_id, round(CASE WHEN cells[1] = cells[-1] THEN 1.0 ELSE 0.0 END, 6) AS accuracy FROM s")
def n11_sequence_accuracy(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return s.select("trip_id", F.round(evaluate.sequence_accuracy(F.slice("cells", 1, 1), F.slice("cells", -1, 1)), 6).alias("accuracy"))


@query("n9_mobility_haversine", f"""WITH {TRACKS} SELECT trip_id, round(avg(2.0 * 6371008.8 * asin(sqrt(least(1.0, sin(radians(CAST(0.001 AS DOUBLE)) / 2) * sin(radians(CAST(0.001 AS DOUBLE)) / 2))))), 2) AS d FROM tracks GROUP BY trip_id HAVING count(*) > 1""")
def n9_mobility_haversine(spark, sf_dir):
    t = trajectories.build(track_points(spark, sf_dir), trip="trip_id", order="ts", columns=["lon", "lat"])
    p = F.transform("points", lambda c: F.struct(c["lon"].alias("lon"), (c["lat"] + 0.001).alias("lat")))
    return t.select("trip_id", F.round(evaluate.sequence_haversine(F.col("points"), p), 2).alias("d"))


def _counts(spark, sf_dir):
    from geoloom.plans.spatial import SEGMENTS

    t = tiled(spark, sf_dir, Z)
    return t.groupBy("region_id", "x", "y").pivot("seg", SEGMENTS).count().na.fill(0)


@query("m3_gtfs2vec_embedding")
def m3_gtfs2vec_embedding(spark, sf_dir):
    from geoloom.operators.neural import AutoEncoder
    from geoloom.plans.relational import m3_gtfs_features

    f = m3_gtfs_features(spark, sf_dir)
    model = AutoEncoder(hidden=48, embedding=8, batch=24, epochs=3).fit(f, "region_id")
    return model.transform(f, "region_id")


@query("m4_highway2vec_embedding")
def m4_highway2vec_embedding(spark, sf_dir):
    from geoloom.operators.neural import Highway2Vec
    from geoloom.plans.relational import d8_wide_road_flags

    flags = d8_wide_road_flags(spark, sf_dir).withColumnRenamed("edge", "feature_id")
    joint = flags.select((F.col("feature_id") % 7).alias("region_id"), "feature_id")
    return Highway2Vec(hidden=16, embedding=6, epochs=3).fit_transform(flags, joint)


@query("m5_hex2vec_embedding")
def m5_hex2vec_embedding(spark, sf_dir):
    from geoloom.operators.neighbourhoods import tile_edges
    from geoloom.operators.neural import Hex2Vec

    c = _counts(spark, sf_dir)
    edges = tile_edges(c.select("region_id", "x", "y"), 2, Z)
    return Hex2Vec(sizes=(15, 10), epochs=1).fit_transform(c.drop("x", "y"), edges, "region_id")


@query("m6_geovex_embedding")
def m6_geovex_embedding(spark, sf_dir):
    from geoloom.operators.neural import GeoVex

    from geoloom.functions import h3
    from geoloom.plans.inputs import track_points

    p = track_points(spark, sf_dir).select(h3.h3_cell(F.col("lon"), F.col("lat"), 7).alias("cell"), (F.col("event_id") % 4).alias("kind"))
    return GeoVex(radius=2, embedding=6, hidden=12, epochs=2).fit_transform(p.groupBy("cell").pivot("kind", [0, 1, 2, 3]).count().na.fill(0))


@query("m7_s2vec_embedding")
def m7_s2vec_embedding(spark, sf_dir):
    from geoloom.operators.neural import S2Vec
    from geoloom.plans.spatial import SEGMENTS

    c = _counts(spark, sf_dir).select(
        grid.tile_parent(F.col("x"), F.col("y"), Z, 2).alias("img_id"), F.col("region_id").alias("patch_id"), ((F.col("y") % 4) * 4 + F.col("x") % 4).cast("int").alias("place"), *SEGMENTS
    )
    return S2Vec(grid=4, dim=16, epochs=1).fit_transform(c, SEGMENTS)


@query("stream_cell_counts", f"WITH {TRACKS} SELECT {sql_id(sql_x('lon', 12), sql_y('lat', 12), 12)} AS region_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM tracks GROUP BY ALL")
def stream_cell_counts(spark, sf_dir):
    from geoloom.streaming.cells import daily_cell_counts, run_once

    return run_once(spark, f"{sf_dir}/events.parquet", daily_cell_counts)


@query("stream_consecutive_cells", f"WITH {_CELLS} SELECT trip_id, event_id, x, y FROM cells")
def stream_consecutive_cells(spark, sf_dir):
    """The same rows as `e1_consecutive_cells`, from micro-batches of the events in no order of time, with a last one that moves the watermark on."""
    from geoloom.streaming.trips import replayed_cells

    return replayed_cells(spark, track_points(spark, sf_dir), trip="trip_id", order="ts", tie="event_id", zoom=Z).select("trip_id", "event_id", "x", "y")
