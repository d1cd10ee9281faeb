"""Queries that pin down what otherwise rests on a fit: fixed weights, the greedy split, warping, S2 cells, in SQL too."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import s2
from geoloom.operators import evaluate, splits, trajectories
from geoloom.operators.autograd import Tensor
from geoloom.operators.neural import AutoEncoder, Hex2Vec, Highway2Vec
from geoloom.plans.inputs import PTS, QUERIES, SQL, TRACKS, points, query, sql_tiled, tiled, track_points
from geoloom.plans.relational import d8_wide_road_flags, m3_gtfs_features
from geoloom.plans.spatial import SEGMENTS


# --- Encoders with given weights -------------------------------------------------------------


def _weight(i: int, j: int) -> float:
    return ((i * 7 + j * 3) % 5 - 2) / 4


def _given(model, columns: list[str], sizes: list[int]):
    """The model with a rule in place of fitted weights."""
    import numpy as np

    model.columns, n = columns, [len(columns), *sizes]
    for k, (a, b) in enumerate(zip(n, n[1:], strict=False)):
        model.params[f"ew{k}"] = Tensor(np.array([[_weight(i + k, j) for j in range(b)] for i in range(a)]))
        model.params[f"eb{k}"] = Tensor(np.array([(j % 3) / 8 for j in range(b)]))
    return model


def sql_encoded(columns: list[str], sizes: list[int], key: str, source: str) -> str:
    """CTEs from a table of features to ``enc``: key and e0, e1, ..."""
    names, out = [f"(CASE WHEN isfinite({c}) THEN {c} ELSE 0 END)" for c in columns], []
    for k, width in enumerate(sizes):
        terms = [" + ".join([f"CAST({(j % 3) / 8} AS DOUBLE)"] + [f"{c} * CAST({_weight(i + k, j)} AS DOUBLE)" for i, c in enumerate(names)]) for j in range(width)]
        last = k == len(sizes) - 1
        new = [f"{'e' if last else f'l{k}_'}{j}" for j in range(width)]
        out.append(f"{'enc' if last else f'enc{k}'} AS (SELECT {key}, {', '.join(f'{t if last else f'greatest(0, {t})'} AS {n}' for t, n in zip(terms, new, strict=True))} FROM {source if k == 0 else f'enc{k - 1}'})")
        names = new
    return ", ".join(out)


def _shown(df, key: str, width: int):
    return df.select(key, *[F.round(F.col("embedding")[j].cast("double"), 3).alias(f"e{j}") for j in range(width)])


def _rounded(width: int, value: str = "e{}") -> str:
    return ", ".join(f"round(CAST(CAST({value.format(j)} AS FLOAT) AS DOUBLE), 3) AS e{j}" for j in range(width))


_M3 = [f"{n}_at_{k}" for n in ("trips", "directions") for k in (6, 7, 8, 9)]


@query("m3_gtfs2vec_encoder", f"WITH f AS ({SQL['m3_gtfs_features']}), {sql_encoded(_M3, [6, 4], 'region_id', 'f')} SELECT region_id, {_rounded(4)} FROM enc")
def m3_gtfs2vec_encoder(spark, sf_dir):
    f = m3_gtfs_features(spark, sf_dir).select("region_id", *_M3)
    return _shown(_given(AutoEncoder(hidden=6, embedding=4), _M3, [6, 4]).transform(f, "region_id"), "region_id", 4)


_M4 = ["lanes_2", "lanes_37", "lanes_17"]


@query("m4_highway2vec_encoder", f"WITH f AS ({SQL['d8_wide_road_flags']}), {sql_encoded(_M4, [5, 3], 'edge', 'f')} SELECT edge % 7 AS region_id, {_rounded(3, 'avg(e{})')} FROM enc GROUP BY edge % 7")
def m4_highway2vec_encoder(spark, sf_dir):
    flags = d8_wide_road_flags(spark, sf_dir).withColumnRenamed("edge", "feature_id").select("feature_id", *_M4)
    joint = flags.select((F.col("feature_id") % 7).alias("region_id"), "feature_id")
    return _shown(_given(Highway2Vec(hidden=5, embedding=3), _M4, [5, 3]).embed_regions(flags, joint), "region_id", 3)


_M5 = ", ".join(f"CAST(sum(CASE WHEN seg = '{s}' THEN 1 ELSE 0 END) AS DOUBLE) AS {s.lower()}" for s in SEGMENTS)


@query("m5_hex2vec_encoder", f"WITH {sql_tiled(13)}, f AS (SELECT region_id, {_M5} FROM tiled GROUP BY region_id), {sql_encoded([s.lower() for s in SEGMENTS], [6, 5, 3], 'region_id', 'f')} SELECT region_id, {_rounded(3)} FROM enc")
def m5_hex2vec_encoder(spark, sf_dir):
    counts = tiled(spark, sf_dir, 13).groupBy("region_id").pivot("seg", SEGMENTS).count().na.fill(0)
    counts = counts.select("region_id", *[F.col(s).alias(s.lower()) for s in SEGMENTS])
    return _shown(_given(Hex2Vec(sizes=(6, 5, 3)), [s.lower() for s in SEGMENTS], [6, 5, 3]).transform(counts), "region_id", 3)


# --- The greedy split ------------------------------------------------------------------------


def _sql_split(keyed: str, fractions: list[tuple[str, str]], seed: str) -> str:
    """A recursion over cells in their fixed order, from ``keyed`` (feature_id, cell, bucket): the points' splits."""
    n, names = len(fractions), [f for f, _ in fractions]
    share = "[" + ", ".join(f"CAST({v} AS DOUBLE)" for _, v in fractions) + "]"
    have = f"sums[(x.b - 1) * {n} + s]"
    total = " + ".join(f"sums[(x.b - 1) * {n} + {s}]" for s in range(1, n + 1))
    splits_of = "[" + ", ".join(map(str, range(1, n + 1))) + "]"
    cost = f"list_sum(list_transform(bs, lambda x: list_sum(list_transform({splits_of}, lambda s: abs({share}[s] - ({have} + CASE WHEN s = c THEN x.n ELSE 0 END) / CAST({total} + x.n AS DOUBLE))))))"
    return f"""{keyed},
st AS (SELECT cell, bucket, count(*) AS n FROM keyed GROUP BY ALL),
bk AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS b FROM (SELECT DISTINCT bucket FROM st)),
ce AS (SELECT cell, list({{'b': b, 'n': n}} ORDER BY bucket) AS bs, row_number() OVER (ORDER BY md5(concat(cell, '|{seed}'))) AS rn FROM st JOIN bk USING (bucket) GROUP BY cell),
walk(rn, cell, pick, sums) AS (
  SELECT CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), list_transform(range(0, (SELECT count(*) FROM bk) * {n}), lambda z: CAST(0 AS BIGINT))
  UNION ALL
  SELECT rn, cell, pick, list_transform(sums, lambda v, i: v + coalesce(list_sum(list_transform(bs, lambda x: CASE WHEN (x.b - 1) * {n} + pick = i THEN x.n ELSE 0 END)), 0))
  FROM (SELECT rn, cell, bs, sums, list_position(costs, list_min(costs)) AS pick
        FROM (SELECT ce.rn, ce.cell, ce.bs, walk.sums, list_transform({splits_of}, lambda c: {cost.replace('bs,', 'ce.bs,').replace('sums[', 'walk.sums[')}) AS costs FROM walk JOIN ce ON ce.rn = walk.rn + 1)))
SELECT feature_id, {names!r}[pick] AS split FROM keyed JOIN walk USING (cell)"""


_VALUE_BINS = "q AS (SELECT list_sort(list_distinct([" + ", ".join(f"quantile_cont(value, {k / 7!r})" for k in range(8)) + "])) AS e FROM pts)"
_BY_VALUE = f"{sql_tiled(13)}, {_VALUE_BINS}, keyed AS (SELECT feature_id, region_id AS cell, CAST(greatest(len(list_filter(e, lambda v: v < value)) - 1, 0) AS VARCHAR) AS bucket FROM tiled, q)"
_BY_SEG = f"{sql_tiled(13)}, keyed AS (SELECT feature_id, region_id AS cell, seg AS bucket FROM tiled)"

SQL["n1_spatial_split"] = "WITH RECURSIVE " + _sql_split(_BY_VALUE, [("train", "0.7"), ("validation", "0.1"), ("test", "0.2")], "0")
SQL["n2_two_way_split"] = "WITH RECURSIVE " + _sql_split(_BY_SEG, [("train", "0.8"), ("test", "0.2")], "0")


@query("n1_spatial_split", SQL["n1_spatial_split"])
def n1_spatial_split(spark, sf_dir):
    return splits.spatial_split(points(spark, sf_dir), zoom=13, target="value", test=0.2, validation=0.1).select("feature_id", "split")


@query("n2_two_way_split", SQL["n2_two_way_split"])
def n2_two_way_split(spark, sf_dir):
    train, test = splits.train_test_spatial_split(points(spark, sf_dir), zoom=13, target="seg", categorical=True)
    return train.select("feature_id", F.lit("train").alias("split")).unionByName(test.select("feature_id", F.lit("test").alias("split")))


# --- Warping ---------------------------------------------------------------------------------

_H = "sin((radians(q.lat + CAST(0.001 AS DOUBLE)) - radians(p.lat)) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(q.lat + CAST(0.001 AS DOUBLE))) * sin((radians(q.lon) - radians(p.lon)) / 2) ** 2"
_INF = "CAST('infinity' AS DOUBLE)"


@query("n10_dtw_distance", f"""WITH {TRACKS}, o AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts, lon, lat) AS k, count(*) OVER (PARTITION BY trip_id) AS n FROM tracks),
d AS (SELECT p.trip_id, p.k AS i, list(CAST(2 * 6371008.8 * asin(sqrt(least(1, {_H}))) AS DOUBLE) ORDER BY q.k) AS line FROM o p JOIN o q ON q.trip_id = p.trip_id WHERE p.n > 1 GROUP BY ALL),
t AS (SELECT trip_id, list(line ORDER BY i) AS lines FROM d GROUP BY trip_id),
r AS (SELECT trip_id, list_reduce(lines, lambda above, line: list_reduce(list_transform(line, lambda c, j: [c, CASE WHEN len(above) = 0 THEN CASE WHEN j = 1 THEN 0 ELSE {_INF} END
  ELSE least(above[j], CASE WHEN j = 1 THEN {_INF} ELSE above[j - 1] END) END]), lambda done, e: list_append(done, e[1] + least(e[2], coalesce(done[-1], {_INF}))), CAST([] AS DOUBLE[])), CAST([] AS DOUBLE[])) AS last FROM t)
SELECT trip_id, round(last[-1], 3) AS dtw FROM r""")
def n10_dtw_distance(spark, sf_dir):
    t = trajectories.build(track_points(spark, sf_dir), trip="trip_id", order="ts", columns=["lon", "lat"])
    p = F.transform("points", lambda c: F.struct(c["lon"].alias("lon"), (c["lat"] + 0.001).alias("lat")))
    return t.select("trip_id", F.round(evaluate.dtw_metres(F.col("points"), p), 3).alias("dtw"))


@query("n10_fast_dtw", "SELECT user_id AS trip_id, true AS close FROM events GROUP BY user_id HAVING count(*) > 1")
def n10_fast_dtw(spark, sf_dir):
    """Warping near the best path of the halved trips, against the exact one: never below it and within a percent."""
    t = trajectories.build(track_points(spark, sf_dir), trip="trip_id", order="ts", columns=["lon", "lat"])
    p = F.transform("points", lambda c: F.struct(c["lon"].alias("lon"), (c["lat"] + 0.001).alias("lat")))
    both = t.select("trip_id", evaluate.dtw_metres(F.col("points"), p).alias("exact"), evaluate.dtw_metres(F.col("points"), p, radius=10).alias("fast"))
    return both.select("trip_id", ((F.col("fast") >= F.col("exact") - 1e-6) & (F.col("fast") <= 1.01 * F.col("exact") + 1e-6)).alias("close"))


# --- S2 --------------------------------------------------------------------------------------


def _sql_s2(level: int) -> str:
    """All places lie on face 2, where u = -x / z and v = -y / z."""
    st = "CASE WHEN {0} >= 0 THEN 0.5 * sqrt(1 + 3 * {0}) ELSE 1 - 0.5 * sqrt(1 - 3 * {0}) END"
    order = [[int(x) for x in row] for row in s2.IJ_TO_POS]
    turns = [int(x) for x in s2.POS_TO_ORIENTATION]
    steps = [
        "su AS (SELECT feature_id, -cos(radians(lat)) * cos(radians(lon)) / sin(radians(lat)) AS u, -cos(radians(lat)) * sin(radians(lon)) / sin(radians(lat)) AS v FROM pts)",
        f"s0 AS (SELECT feature_id, CAST(floor(CAST(1073741824 AS DOUBLE) * ({st.format('u')})) AS BIGINT) AS i, CAST(floor(CAST(1073741824 AS DOUBLE) * ({st.format('v')})) AS BIGINT) AS j, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS pos FROM su)",
    ]
    for k in range(level):
        at = f"CAST({order}[turn + 1][((i >> {29 - k}) & 1) * 2 + ((j >> {29 - k}) & 1) + 1] AS BIGINT)"
        steps.append(f"t{k} AS (SELECT *, {at} AS p FROM s{k})")
        steps.append(f"s{k + 1} AS (SELECT feature_id, i, j, xor(turn, CAST({turns}[p + 1] AS BIGINT)) AS turn, pos * 4 + p AS pos FROM t{k})")
    cell = f"(CAST(2 AS BIGINT) << 61) + (pos << {61 - 2 * level}) + (CAST(1 AS BIGINT) << {60 - 2 * level})"
    return f"WITH {PTS}, {', '.join(steps)} SELECT feature_id, rtrim(format('{{:x}}', {cell}), '0') AS region_id FROM s{level}"


@query("j3_s2_point_cells", _sql_s2(12))
def j3_s2_point_cells(spark, sf_dir):
    return points(spark, sf_dir).select("feature_id", s2.s2_token(s2.s2_cell(F.col("lon"), F.col("lat"), 12)).alias("region_id"))


__all__ = ["QUERIES", "SQL"]
