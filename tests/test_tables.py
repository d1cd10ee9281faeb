import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from geoloom.errors import NotFittedError
from geoloom.functions import road
from geoloom.operators import embedders as E
from geoloom.operators import evaluate, filters, labels, splits, trajectories

R1, R2, R3 = "891e2040897ffff", "891e2040d4bffff", "891e2040d5bffff"


@pytest.fixture(scope="module")
def tables(spark):
    regions = spark.createDataFrame([(R1,), (R2,), (R3,)], "region_id string")
    features = spark.createDataFrame(
        [("way/312457804", "playground", None), ("way/1533817161", None, "pub"), ("way/312457812", "adult_gaming_centre", "pub"), ("way/312457834", None, None)],
        "feature_id string, leisure string, amenity string",
    )
    joint = spark.createDataFrame([(R2, "way/312457804"), (R1, "way/1533817161"), (R1, "way/312457834"), (R3, "way/312457812")], "region_id string, feature_id string")
    return regions, features, joint


def table_of(df, columns):
    return {r["region_id"]: [r[c] for c in columns] for r in df.collect()}


# Names and counts that the contract of a count table asks for.
@pytest.mark.parametrize(
    ("options", "columns", "want"),
    [
        ({"subcategories": False}, ["leisure", "amenity"], [[0, 1], [1, 0], [1, 1]]),
        ({}, ["leisure_adult_gaming_centre", "leisure_playground", "amenity_pub"], [[0, 0, 1], [0, 1, 0], [1, 0, 1]]),
        ({"subcategories": False, "expected": ["amenity_parking", "leisure_park", "amenity_pub"]}, ["amenity_parking", "leisure_park", "amenity_pub"], [[0, 0, 0]] * 3),
        ({"expected": ["amenity_parking", "leisure_park", "amenity_pub"]}, ["amenity_parking", "leisure_park", "amenity_pub"], [[0, 0, 1], [0, 0, 0], [0, 0, 1]]),
    ],
)
def test_count_embedding(tables, options, columns, want):
    got = E.count_embedding(*tables, **options)
    assert set(got.columns) == {"region_id", *columns}
    assert table_of(got, columns) == dict(zip((R1, R2, R3), want, strict=True))


def test_count_embedding_rules(spark, tables):
    regions, features, joint = tables
    flags = features.select("feature_id", F.col("leisure").isNotNull().alias("leisure"))
    with pytest.raises(ValueError):
        E.count_embedding(regions, flags, joint)
    assert table_of(E.count_embedding(regions, flags, joint, subcategories=False), ["leisure"]) == {R1: [0], R2: [1], R3: [1]}
    with pytest.raises(ValueError):
        E.count_embedding(regions, features.select("feature_id"), joint)
    assert table_of(E.count_embedding(regions, features.select("feature_id"), joint, expected=["a_b"]), ["a_b"]) == {R1: [0], R2: [0], R3: [0]}
    with pytest.raises(ValueError):
        E.count_embedding(regions, features, joint.select("region_id"))
    nulls = features.withColumn("leisure", F.lit("null"))
    assert "leisure_null" not in E.count_embedding(regions, nulls, joint).columns


# Names of expected columns.
@pytest.mark.parametrize(
    ("tags", "sub", "want"),
    [
        ({"amenity": "pub", "leisure": ["a", "b"]}, True, ["amenity_pub", "leisure_a", "leisure_b"]),
        ({"g": {"amenity": ["pub"]}}, True, ["g_amenity=pub"]),
        ({"amenity": "pub"}, False, ["amenity"]),
        ({"g": {"amenity": ["pub"]}}, False, ["g"]),
    ],
)
def test_expected_names(tags, sub, want):
    assert E.expected_features(tags, sub) == want


def test_expected_true_is_an_error():
    with pytest.raises(ValueError):
        E.expected_features({"amenity": True}, True)


def mutual(spark):
    ids = (R1, R2, R3)
    return spark.createDataFrame([(a, b, int(a != b)) for a in ids for b in ids], "region_id string, neighbour_id string, distance int")


@pytest.mark.parametrize(
    ("distance", "concatenate", "columns", "want"),
    [
        (0, False, ["leisure", "amenity"], [[0, 1], [1, 0], [1, 1]]),
        (1, False, ["leisure", "amenity"], [[0.25, 1.125], [1.125, 0.25], [1.125, 1.125]]),
        (3, False, ["leisure", "amenity"], [[0.25, 1.125], [1.125, 0.25], [1.125, 1.125]]),
        (2, True, ["leisure_1", "amenity_1", "leisure_2", "amenity_2"], [[1, 0.5, 0, 0], [0.5, 1, 0, 0], [0.5, 0.5, 0, 0]]),
    ],
)
def test_contextual_embedding(spark, tables, distance, concatenate, columns, want):
    counts = E.count_embedding(*tables, subcategories=False)
    got = E.contextual_embedding(counts, mutual(spark), distance, concatenate=concatenate)
    assert table_of(got, columns) == dict(zip((R1, R2, R3), want, strict=True))


def test_contextual_rules(spark, tables):
    counts = E.count_embedding(*tables, subcategories=False)
    with pytest.raises(ValueError):
        E.contextual_embedding(counts, mutual(spark), -1)
    with pytest.raises(ValueError):
        E.contextual_embedding(counts, mutual(spark), 1, aggregation="mode")


def test_gtfs_features(spark):
    f = spark.createDataFrame([(1, 1, 1, 0, ["A", "A1"]), (2, 0, 1, 0, ["B", "B1"]), (3, 0, 0, 1, ["C"])], "stop_id int, trips_at_6 int, trips_at_7 int, trips_at_8 int, directions_at_6 array<string>")
    r = spark.createDataFrame([("ff1",), ("ff2",), ("ff3",)], "region_id string")
    j = spark.createDataFrame([("ff1", 1), ("ff1", 2), ("ff2", 3)], "region_id string, stop_id int")
    got = table_of(E.gtfs_features(r, f, j, feature_id="stop_id"), ["trips_at_6", "trips_at_7", "trips_at_8", "directions_at_6"])
    assert got == {"ff1": [0.5, 1, 0, 1], "ff2": [0, 0, 0.5, 0.25], "ff3": [0, 0, 0, 0]}


LANES = [("-1", "-1"), ("0", "0"), ("1", "1"), ("14", "14"), ("15", "15"), ("16", "15"), ("17", "15"), ("100", "15"), ("3.7", "3"), ("a", "None"), ("2", "2"), (None, "None"), ("", "None"), ("nan", "None")]
SPEEDS = [
    ("-1", "0"), ("0", "0"), ("1", "5"), ("4", "5"), ("5", "5"), ("6", "7"), ("7", "7"), ("8", "10"), ("10", "10"), ("11", "15"), ("15", "15"), ("16", "20"), ("17", "20"), ("44", "40"), ("45", "40"), ("46", "50"),
    ("199", "200"), ("300", "200"), ("6.7", "7"), ("4.5 km/h", "5"), ("3mph", "5"), ("4 mph", "7"), ("signals", "None"), ("variable", "None"), ("CZ:pedestrian_zone", "20"), ("walk", "None"),
]
WIDTHS = [("-1.3", "-1.5"), ("4.4", "4.5"), ("4.5", "4.5"), ("4.6", "4.5"), ("30", "30.0"), ("31", "30.0"), ("12m", "12.0"), ("12 m", "12.0"), ("12meter", "12.0"), ("130.4'", "3.5"), ("25.4ft", "7.5"), ("wide", "None")]


@pytest.mark.parametrize(("column", "cases"), [("lanes", LANES), ("maxspeed", SPEEDS), ("width", WIDTHS)])
def test_road_attributes(spark, column, cases):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v string")
    got = {r["k"]: r["n"] for r in df.select("k", road.normalise(column, F.col("v"), {"CZ:pedestrian_zone": 20}).alias("n")).collect()}
    assert {cases[k][0]: v for k, v in got.items()} == dict(cases)


@pytest.mark.parametrize(
    ("tags", "want"),
    [
        ({"g": {"a": "A"}}, {"a": ["A"]}),
        ({"g": {"a": ["A", "B"]}, "h": {"a": ["B", "C"]}}, {"a": ["A", "B", "C"]}),
        ({"g": {"a": True}, "h": {"a": ["B"]}}, {"a": True}),
        ({"g": {"a": ["B"]}, "h": {"a": True}}, {"a": True}),
        ({"g": {"a": False}, "h": {"a": ["B"]}}, {"a": ["B"]}),
        ({"a": False}, {}),
        ({"a": True, "b": ["x", "y"]}, {"a": True, "b": ["x", "y"]}),
        ([{"a": "x"}, {"g": {"a": "y", "b": True}}], {"a": ["x", "y"], "b": True}),
    ],
)
def test_merge_filters(tags, want):
    assert filters.merge_filters(tags) == want


def test_bins_follow_the_pandas_rules(spark):
    import pandas as pd

    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(0, 20, 200).astype(float), rng.normal(0, 5, 51)])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double")
    for n in (3, 8):
        got = [r["bucket"] for r in splits.quantile_bins(df, "v", n).orderBy("k").collect()]
        assert got == pd.qcut(values, n, labels=False, duplicates="drop").tolist()
        got = [r["bucket"] for r in splits.width_bins(df, "v", n).orderBy("k").collect()]
        assert got == pd.cut(values, n, labels=False).tolist()


def test_spatial_split_holds_its_ratios(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, float(x), float(y), float(v), "ABCD"[k % 4]) for k, (x, y, v) in enumerate(rng.uniform([-1, -1, 0], [1, 1, 1], (20_000, 3)))], "k int, lon double, lat double, target double, kind string")
    for options in ({"target": "target"}, {"target": "kind", "categorical": True}, {}):
        done = splits.spatial_split(df, zoom=13, test=0.2, validation=0.1, seed=3, **options)
        n = {r["split"]: r["count"] for r in done.groupBy("split").count().collect()}
        assert sum(n.values()) == 20_000 and done.columns == [*df.columns, "split"]
        assert abs(n["test"] / 20_000 - 0.2) < 0.01 and abs(n["validation"] / 20_000 - 0.1) < 0.01
    train, test = splits.train_test_spatial_split(df, zoom=13, test=5000)
    assert abs(test.count() - 5000) < 200 and train.columns == df.columns
    with pytest.raises(ValueError):
        splits.spatial_split(df, zoom=13, test=0.7, validation=0.5)
    with pytest.raises(ValueError):
        splits.spatial_split(df, zoom=13, categorical=True)
    with pytest.raises(ValueError):
        splits.train_test_spatial_split(df, zoom=13, test=0)
    cells = done.select("split", F.concat_ws("_", F.floor((F.col("lon") + 180) / 360 * 2**13), F.col("split")).alias("c"))
    assert cells.count() == 20_000


def test_trajectories(spark):
    pts = [(1, k, 16.80 + 0.05 * (k // 2), 51.1) for k in range(6)] + [(2, 0, 17.0, 51.0)]
    df = spark.createDataFrame(pts, "trip_id int, ts int, lon double, lat double")
    assert rows(trajectories.build(df, trip="trip_id", order="ts", columns=["lon", "lat"]), "trip_id") == [(1,)]
    cells = trajectories.to_cells(df, trip="trip_id", order="ts", zoom=14)
    assert cells.filter("trip_id = 1").count() == 3
    filled = trajectories.fill_gaps(cells, trip="trip_id", order="ts").filter("trip_id = 1").orderBy("seq").collect()
    xs = [r["x"] for r in filled]
    assert xs[-1] == xs[-2] and all(b - a == 1 for a, b in zip(xs[:-1], xs[1:-1], strict=False))
    assert filled[-1]["ts"] == 4 and filled[-2]["ts"] == 2
    plain = trajectories.fill_gaps(cells, trip="trip_id", order="ts", repeat_last=False)
    assert plain.filter("trip_id = 1").count() == len(xs) - 1 and plain.filter("trip_id = 2").count() == 1
    seqs = trajectories.sequences(trajectories.fill_gaps(cells, trip="trip_id", order="ts"), trip="trip_id", zoom=14)
    task = {r["trip_id"]: (len(r["x_cells"]), len(r["y_cells"])) for r in trajectories.mobility_task(seqs).collect()}
    assert set(task) == {1} and sum(task[1]) == len(xs) and task[1][0] == int(len(xs) * 0.85)


@pytest.mark.parametrize("part_rows", [3, 7])
@pytest.mark.parametrize("repeat_last", [True, False])
def test_long_trips_in_parts_equal_whole_ones(spark, part_rows, repeat_last):
    rng = np.random.default_rng(part_rows)
    pts, k = [], 0
    for trip, n in ((1, 40), (2, 1), (3, 2), (4, 7), (5, 25), (None, 9)):
        at = np.array([16.8, 51.1])
        for t in np.sort(rng.integers(0, 30, n)).tolist():
            at = at + (rng.random() < 0.6) * rng.uniform(-0.06, 0.06, 2)
            pts.append((trip, t, k, *map(float, at)))
            k += 1
    df = spark.createDataFrame(pts, "trip_id int, ts int, k int, lon double, lat double").repartition(3)
    how = {"trip": "trip_id", "order": "ts", "tie": "k"}
    parts = trajectories.parted(df, trip="trip_id", order="ts", part_rows=part_rows)
    assert parts.groupBy("trip_id").agg(F.countDistinct("_part").alias("n")).filter("trip_id = 1").first()["n"] > 3
    assert trajectories.parted(df, trip="trip_id", order="ts") is None
    every = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    cells = trajectories.to_cells(df, zoom=14, **how)
    assert every(trajectories.to_cells(df, zoom=14, part_rows=part_rows, **how)) == every(cells)
    filled = trajectories.fill_gaps(cells, repeat_last=repeat_last, **how)
    assert every(trajectories.fill_gaps(cells, repeat_last=repeat_last, part_rows=part_rows, **how)) == every(filled)
    assert every(trajectories.fill_gaps(cells, repeat_last=repeat_last, part_rows=part_rows, points=df, **how)) == every(filled)
    assert every(trajectories.sequences(filled, trip="trip_id", zoom=14, part_rows=part_rows)) == every(trajectories.sequences(filled, trip="trip_id", zoom=14))
    lengths = [{r["trip_id"]: r["length"] for r in trajectories.line_lengths(df, part_rows=p, **how).collect()} for p in (part_rows, 10**6)]
    assert lengths[0] == pytest.approx(lengths[1])
    built = lambda p: every(trajectories.build(df, trip="trip_id", order="ts", columns=["k"], part_rows=p))
    assert built(part_rows) == built(10**6)


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "region_id string, label double")
    p = spark.createDataFrame([("a", 1.5), ("b", 2.0), ("c", 3.0), ("z", 9.0)], "region_id string, prediction double")
    m = evaluate.hex_regression(df, p).first()
    assert m["mse"] == pytest.approx(1.25 / 3) and m["rmse"] == pytest.approx(math.sqrt(1.25 / 3)) and m["mae"] == pytest.approx(0.5)
    assert m["mape"] == pytest.approx(25) and m["r2"] == pytest.approx(1 - 1.25 / (14 / 3))
    assert evaluate.unmatched(df, p.filter("region_id <> 'b'"), "region_id").first()["region_id"] == "b"
    with pytest.raises(ValueError):
        evaluate.trajectory_regression(df, p, "region_id", version="HMP")
    seq = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "true_cells array<string>, predicted_cells array<string>")
    assert evaluate.mobility_metrics(seq).first()["accuracy"] == pytest.approx(2 / 3)
    assert evaluate.mobility_metrics(seq, k=1).first()["accuracy"] == 1
    line = "array<struct<lon:double,lat:double>>"
    d = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)])], f"a {line}, b {line}")
    assert d.select(evaluate.dtw_metres(F.col("a"), F.col("b")).alias("d")).first()["d"] == 0
    assert d.select(evaluate.sequence_haversine(F.col("a"), F.col("b")).alias("d")).first()["d"] == pytest.approx(111_195 / 2, rel=1e-4)


def test_dtw_query_equals_brute_force_on_all_points(spark, sf_dir):
    from geoloom.plans.inputs import track_points
    from geoloom.plans.models import n10_dtw_distance

    def metres(a, b):
        (x, y), (u, v) = (tuple(map(math.radians, c)) for c in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))

    def dtw(a, b):
        best = {(-1, -1): 0.0}
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                best[i, j] = metres(p, q) + min(best.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        return best[len(a) - 1, len(b) - 1]

    trips = {}
    for r in sorted(track_points(spark, sf_dir).collect(), key=lambda r: (r["ts"], r["lon"], r["lat"])):
        trips.setdefault(r["trip_id"], []).append((r["lon"], r["lat"]))
    want = {k: dtw(v, [(x, y + 0.001) for x, y in v]) for k, v in trips.items() if len(v) > 1}
    got = {r["trip_id"]: r["dtw"] for r in n10_dtw_distance(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-3) for k in want)


def test_fast_warping_is_close_and_linear():
    import time

    rng = np.random.default_rng(8)

    def walk(n):
        steps = rng.normal(0, 1e-4, (n, 2)) + 1e-4 * np.stack([np.cos(np.arange(n) / 40), np.sin(np.arange(n) / 55)], 1)
        return np.radians([17.0, 51.1]) + np.cumsum(steps, 0)

    for n, m in ((1, 1), (1, 9), (2, 3), (40, 57), (301, 300), (500, 731)):
        a = walk(n)
        b = a[np.sort(rng.integers(0, n, m))] + rng.normal(0, 2e-5, (m, 2))
        exact = evaluate.warped(a, b, None)
        plain = np.full((n + 1, m + 1), np.inf)
        plain[0, 0] = 0
        cost = evaluate._metres(a[:, None], b[None])
        for i in range(n):
            for j in range(m):
                plain[i + 1, j + 1] = cost[i, j] + min(plain[i, j], plain[i, j + 1], plain[i + 1, j])
        assert exact == pytest.approx(plain[n, m], rel=1e-9)
        for radius in (1, 10, 30):
            assert exact - 1e-6 <= evaluate.warped(a, b, radius)
        assert evaluate.warped(a, b, 30) <= 1.01 * exact
    took = []
    for n in (4_000, 16_000):
        a = walk(n)
        start = time.process_time()
        assert evaluate.warped(a, a + 1e-6, 5) <= 6371008.8 * 2e-6 * n
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0]


def test_labels_scale_by_the_training_range(spark):
    t = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    v = spark.createDataFrame([(-5.0,), (5.0,), (20.0,)], "v double")
    assert sorted(r["v"] for r in labels.scale_fitted(v, t, "v").collect()) == [0, 0.5, 1]


def test_neural_gradients():
    from geoloom.operators.autograd import Tensor

    rng = np.random.default_rng(0)
    w, x = rng.normal(size=(3, 3)), rng.normal(size=(4, 3))

    def loss(v):
        t = Tensor(v)
        h = (Tensor(x) @ t).norm().softmax() @ t
        h = h.take(np.array([0, 2, -1, 3])).sigmoid() + (h * h).softplus()
        return t, (h.relu().exp().log() - 0.3).power(2.0).mean()

    t, out = loss(w)
    out.backward()
    for i in range(3):
        for j in range(3):
            d = np.zeros_like(w)
            d[i, j] = 1e-6
            assert t.grad[i, j] == pytest.approx((loss(w + d)[1].data - loss(w - d)[1].data) / 2e-6, abs=1e-5)


def test_models_learn_save_and_load(spark, tmp_path):
    from geoloom.operators import neural as M

    rng = np.random.default_rng(1)
    base = rng.normal(size=(2, 6))
    df = spark.createDataFrame([(f"r{k}", *map(float, np.abs(rng.normal(size=2) @ base))) for k in range(60)], "region_id string, " + ", ".join(f"f{k} double" for k in range(6)))
    model = M.AutoEncoder(hidden=8, embedding=4, epochs=20, rate=0.01)
    with pytest.raises(NotFittedError):
        model.transform(df, "region_id")
    out = model.fit(df, "region_id").transform(df, "region_id")
    assert model.losses[-1] < 0.5 * model.losses[0] and len(out.first()["embedding"]) == 4
    model.save(str(tmp_path / "m"))
    again = M.AutoEncoder.load(str(tmp_path / "m")).transform(df, "region_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    with pytest.raises(ValueError):
        model.transform(df.drop("f0"), "region_id")
    with pytest.raises(ValueError):
        M.Hex2Vec(sizes=())
    edges = spark.createDataFrame([(f"r{a}", f"r{a + b}", 1) for a in range(59) for b in (1,)], "region_id string, neighbour_id string, distance int")
    h = M.Hex2Vec(sizes=(6, 4), epochs=6, rate=0.01).fit(df, edges)
    assert h.losses[-1] < h.losses[0] and len(h.transform(df).first()["embedding"]) == 4
    cells = [(q, r, float(abs(q) % 3), float((q + r) % 2)) for q in range(-6, 7) for r in range(-6, 7)]
    g = M.GeoVex(radius=2, embedding=3, hidden=6, epochs=4, rate=0.01)
    patches = g.patches(spark.createDataFrame(cells, "q long, r long, a double, b double"))
    assert patches.count() == 81  # 9 by 9 whole disks
    assert len(g.fit(patches, 2).transform(patches).first()["embedding"]) == 3 and g.losses[-1] < g.losses[0]
    with pytest.raises(ValueError):
        M.GeoVex(radius=1)
    rows_ = [(f"i{i}", f"i{i}p{p}", p, float(p % 4), float(i)) for i in range(8) for p in range(16)]
    s = M.S2Vec(grid=4, dim=8, heads=2, layers=1, decoder_layers=1, epochs=8, rate=0.01)
    out = s.fit_transform(spark.createDataFrame(rows_, "img_id string, patch_id string, place int, a double, b double"), ["a", "b"])
    assert out.count() == 128 and s.losses[-1] < s.losses[0]


def test_negative_samples_keep_their_distance(spark):
    ids = [f"r{k}" for k in range(30)]
    edges = spark.createDataFrame([(ids[a], ids[b], abs(a - b)) for a in range(30) for b in range(30) if abs(a - b) <= 2], "region_id string, neighbour_id string, distance int")
    regions = spark.createDataFrame([(i,) for i in ids], "region_id string")
    pairs = E.neighbour_pairs(edges)
    got = E.negative_samples(regions, edges, pairs).collect()
    assert len(got) == pairs.count()
    assert all(abs(int(r["anchor"][1:]) - int(r["negative"][1:])) > 2 for r in got)


def test_fits_take_moments_of_all_rows_and_all_exclusions(spark, monkeypatch):
    from geoloom.operators import neural as M

    monkeypatch.setattr(M, "MAX_ROWS", 16)
    rows = [(f"i{k // 16}", f"p{k}", k % 16, float(k * k % 101) if k % 7 else None, 1.0) for k in range(160)]
    patches = spark.createDataFrame(rows, "img_id string, patch_id string, place int, a double, b double")
    s = M.S2Vec(grid=4, dim=8, heads=2, layers=1, decoder_layers=1, epochs=1).fit(patches, ["a", "b"])
    a = [r[3] or 0.0 for r in rows]
    mean = sum(a) / 160
    assert s.config["mean"] == pytest.approx([mean, 1.0]) and s.config["scale"] == pytest.approx([(sum((x - mean) ** 2 for x in a) / 160) ** -0.5, 0])
    monkeypatch.setattr(M, "MAX_ROWS", 1)
    edges = spark.createDataFrame([(a, b, abs(a - b)) for a in range(60) for b in range(60) if 0 < abs(a - b) < 4], "region_id int, neighbour_id int, distance int")
    got = {tuple(r) for r in M.Hex2Vec(sizes=(2,))._too_near(spark.range(50).select(F.col("id").cast("int").alias("k")), edges, "k").collect()}
    assert got == {(a, b) for a in range(50) for b in range(50) if 0 < abs(a - b) < 3}


@pytest.mark.parametrize("gathered", [200_000, 3])
def test_quantiles_are_exact(spark, monkeypatch, gathered):
    from geoloom.operators import quantiles as Q

    monkeypatch.setattr(Q, "GATHERED", gathered)
    monkeypatch.setattr(Q, "_ACCURACY", 100)
    rng = np.random.default_rng(5)
    shares = [0.0, 0.05, 0.31, 0.5, 0.505, 0.95, 1.0]
    for values in (rng.normal(size=4000), np.round(rng.exponential(size=4000), 1), np.arange(10.0), np.array([7.0]), np.repeat([1.0, 2.0, 9.0], 50)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        assert np.allclose(Q.quantiles(df, F.col("x"), shares), np.quantile(values, shares), rtol=1e-12)
    assert Q.quantiles(df.filter("x is null"), F.col("x"), [0.5]) == [None]


def test_filters_from_tables(spark):
    df = spark.createDataFrame([("g", "a", "y"), ("g", "a", "x"), ("h", "a", None), ("h", "a", "z"), ("g", "a", "x"), ("h", "b", "q")], "grp string, key string, value string")
    assert filters.filter_from_table(df, group="grp") == {"g": {"a": ["x", "y"]}, "h": {"a": True, "b": ["q"]}}
    assert filters.filter_from_table(df) == {"a": True, "b": ["q"]}
    assert filters.filter_from_table(df.limit(0)) == {}
    given = {
        "flat": ({"a": "x", "b": True, "d": False}, {"a": ["x"], "b": True}),
        "groups": ({"one": {"a": ["x"], "b": ["q"]}, "two": {"a": ["y", "x"], "b": True, "c": "z"}}, {"a": ["x", "y"], "b": True, "c": ["z"]}),
        "several": ([{"a": ["x"]}, {"g": {"a": True, "c": ["z", "w", "z"]}}], {"a": True, "c": ["z", "w"]}),
        "nothing": ({"a": False, "b": []}, {}),
    }
    for tags, merged in given.values():
        assert filters.merge_filters(tags) == merged
    with pytest.raises(ValueError):
        E.expected_features({"a": True}, True)


def test_cells_over_a_stream(spark):
    from geoloom.streaming import trips

    rng = np.random.default_rng(11)
    start = 1_700_000_000
    pts, k = [], 0
    for trip in range(6):
        at = np.array([16.8, 51.1])
        for t in np.sort(rng.integers(0, 3000, 30)).tolist():
            at = at + (rng.random() < 0.5) * rng.uniform(-0.05, 0.05, 2)
            pts.append((trip, k, start + t, *map(float, at)))
            k += 1
    df = spark.createDataFrame(pts, "trip_id int, k long, s long, lon double, lat double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = trajectories.to_cells(df, trip="trip_id", order="ts", tie="k", zoom=14)
    got = trips.replayed_cells(spark, df, trip="trip_id", order="ts", tie="k", zoom=14, batches=3)
    assert rows(got, "trip_id", "ts", "k", "x", "y") == rows(want, "trip_id", "ts", "k", "x", "y")


def test_late_points_and_expiry_of_a_stream(spark, tmp_path):
    from geoloom.streaming import trips

    kinds = "trip_id int, ts timestamp, k long, lon double, lat double"
    at = lambda s: 1_700_000_000 + s
    files = [
        [(1, 0, 0, 17.0, 51.0), (2, 0, 1, 17.0, 51.0)],
        [(1, 100, 2, 17.0, 51.0), (1, 5000, 3, 17.0, 51.0)],  # the mark moves to 4990
        [(1, 50, 4, 18.0, 51.0), (3, 9000, 5, 17.0, 51.0)],  # number 4 is late
        [(2, 20_000, 6, 17.0, 51.0), (3, 12_000, 7, 17.0, 51.0)],  # trip 2 was still for long
        [(9, 90_000, 8, 1.0, 1.0)],
        [(9, 190_000, 9, 1.0, 1.0)],
        [(9, 290_000, 10, 1.0, 1.0)],
    ]
    for k, f in enumerate(files):
        df = spark.createDataFrame([(t, at(s), n, x, y) for t, s, n, x, y in f], "trip_id int, s long, k long, lon double, lat double").withColumn("ts", F.timestamp_seconds("s"))
        df.select("trip_id", "ts", "k", "lon", "lat").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = trips.consecutive_cells(stream, trip="trip_id", order="ts", tie="k", zoom=12, lateness="10 seconds", expiry_ms=6_000_000)
    found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [r["k"] for r in spark.read.parquet(f"{tmp_path}/out").filter("trip_id < 9").orderBy("k").collect()] == [0, 1, 5, 6]


def test_trips_of_a_stream_share_states(spark, tmp_path, monkeypatch):
    from geoloom.streaming import trips

    day = lambda d: 86_400 * d
    far, old, none = [(0, 0.1), (day(500), 0.1), (day(1000), 0.2)], [(-day(3000), 0.1), (0, 0.1)], [(0, 0.1), (1, None), (2, None), (3, 0.1), (4, 0.1)]
    named = [(1 << 60, far), (1 + (1 << 60), far), (None, none), (7, old), *((k, [(k + j, 0.1 * (j // 3)) for j in range(9)]) for k in range(100, 160))]
    pts = [(t, j, s, 16.0 + lon if lon is not None else None, 51.0) for t, p in named for j, (s, lon) in enumerate(p)]
    df = spark.createDataFrame(pts, "trip_id long, k long, s long, lon double, lat double").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(3)
    text = df.withColumn("trip_id", F.col("trip_id").cast("string"))
    setting, place = "spark.sql.shuffle.partitions", f"{tmp_path}/replay"
    before = spark.conf.get(setting)
    monkeypatch.setattr(trips, "new_path", lambda spark, label: place)
    spark.conf.set(setting, "12")
    try:
        got = trips.replayed_cells(spark, df, trip="trip_id", order="ts", tie="k", zoom=14, batches=2)
        asked = spark.conf.get(setting)
    finally:
        spark.conf.set(setting, before)
    values = lambda d: sorted(d.select("trip_id", F.unix_micros("ts").alias("us"), "k", "x", "y").collect(), key=str)
    want = trajectories.to_cells(df, trip="trip_id", order="ts", zoom=14, tie="k")
    assert got.schema["trip_id"].dataType == df.schema["trip_id"].dataType and values(got) == values(want)
    assert asked == "12" and len(list((tmp_path / "replay/state/state/0").glob("[0-9]*"))) == spark.sparkContext.defaultParallelism == 4

    df.write.parquet(f"{tmp_path}/in")
    stream = trips.consecutive_cells(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), trip="trip_id", order="ts", tie="k", zoom=14, lateness="4000 days", expiry_ms=1000, buckets=5)
    run = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < run.lastProgress.stateOperators[0].numRowsTotal <= 5  # states, not one per trip

    place = f"{tmp_path}/text"
    got = trips.replayed_cells(spark, text, trip="trip_id", order="ts", tie="k", zoom=14)
    assert values(got) == values(trajectories.to_cells(text, trip="trip_id", order="ts", zoom=14, tie="k"))


def test_spatial_split_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(splits, "LAST_CELLS", 40)
    rng = np.random.default_rng(13)
    xy = rng.uniform(-20, 20, (30_000, 2)) * np.sqrt(rng.random((30_000, 1)))
    kind = np.where(rng.random(30_000) < 0.1, "rare", np.where(xy[:, 0] > 5, "east", "west"))
    df = spark.createDataFrame([(float(x), float(y), str(c)) for (x, y), c in zip(xy, kind, strict=True)], "lon double, lat double, kind string")
    done = splits.spatial_split(df, zoom=9, target="kind", categorical=True, test=0.2, validation=0.1).collect()
    assert len(done) == 30_000 and set(done[0].asDict()) == {"lon", "lat", "kind", "split"}
    for c in ("rare", "east", "west"):
        own = [r["split"] for r in done if r["kind"] == c]
        for split, want in (("train", 0.7), ("test", 0.2), ("validation", 0.1)):
            assert abs(own.count(split) / len(own) - want) < 0.01
    where: dict = {}
    for r in done:
        cell = (int((r["lon"] + 180) / 360 * 512), int((1 - math.asinh(math.tan(math.radians(r["lat"]))) / math.pi) / 2 * 512))
        assert where.setdefault(cell, r["split"]) == r["split"]
    assert len(where) > 1_000


def test_warping_reads_places_as_arrays(spark):
    import pyarrow as pa

    lists = pa.array([[(1.0, 2.0)], None, [], [(3.0, 4.0), (5.0, 6.0)]], pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    got = [(np.degrees(p).round(9).tolist(), starts) for p, starts in evaluate._radians(lists.slice(1), rows=2)]
    assert got == [([], [0, 0, 0]), ([[3.0, 4.0], [5.0, 6.0]], [0, 2])]
    line = "array<struct<lon:double,lat:double>>"
    d = spark.createDataFrame([(1, [(0.0, 0.0)], None), (2, [(0.0, 0.0)], []), (3, [(0.0, 0.0)], [(0.0, 0.0)])], f"k int, a {line}, b {line}")
    assert {r["k"]: r["d"] for r in d.select("k", evaluate.dtw_metres(F.col("a"), F.col("b")).alias("d")).collect()} == {1: None, 2: None, 3: 0.0}


def test_parts_of_a_long_trip_are_found_by_halving(spark):
    cuts = [3, 3, 5, 8, 8, 8, 13]
    d = spark.createDataFrame([(v, cuts[:n]) for n in range(8) for v in [*range(16), None]], "v int, cuts array<int>")
    got = d.select("v", "cuts", trajectories._below(F.col("cuts"), F.col("v"), 7).alias("n")).collect()
    assert all(r["n"] == sum(r["v"] is not None and c < r["v"] for c in r["cuts"]) for r in got)
