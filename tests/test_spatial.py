import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import grid, s2
from geoloom.operators import neighbourhoods as N
from geoloom.operators import regionalizers as R
from geoloom.operators import borders
from geoloom.operators import spatial_join as J
from geoloom.operators import voronoi as V

def wkb_table(spark, shapes, name):
    return spark.createDataFrame([(k, bytearray(G.to_wkb(g))) for k, g in enumerate(shapes)], f"{name} int, geometry binary")


@pytest.fixture(scope="module")
def drawn():
    """Random triangles to heptagons, and boxes, places and lines; some share corners on a coarse lattice."""
    rng = np.random.default_rng(11)
    regions, features = [], []
    for _ in range(14):
        n = rng.integers(3, 8)
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = np.round(rng.integers(-4, 5, 2) + rng.uniform(0.5, 1.6) * np.stack([np.cos(angle), np.sin(angle)], 1), 1)
        if abs(G.area(G.polygon(ring))) > 0.1:
            regions.append(G.polygon(ring))
    corners = np.vstack([g[1][0][0] for g in regions])
    for k in range(30):
        x, y = corners[rng.integers(len(corners))] if k % 3 == 0 else np.round(rng.uniform(-5, 5, 2), 1)
        w, h = np.round(rng.uniform(0.1, 1.5, 2), 1)
        features.append([G.point(x, y), G.box(x, y, x + w, y + h), ("line", [[np.array([(x, y), (x + w, y - h)])]])][k % 3])
    return regions, features


def test_intersects_join_equals_brute_force(spark, drawn):
    regions, features = drawn
    want = [(i, j) for i, r in enumerate(regions) for j, f in enumerate(features) if G.intersects(r, f)]
    r, f = wkb_table(spark, regions, "region_id"), wkb_table(spark, features, "feature_id")
    assert len(want) > 10 and rows(J.intersects_join(r, f, cell=0.7), "region_id", "feature_id") == want
    got = J.intersects_join(r, f, cell=1.3, return_geometry=True)
    assert rows(got, "region_id", "feature_id") == want
    for row in got.collect():
        if row["geometry"] is not None:
            cut, r, f = G.from_wkb(bytes(row["geometry"])), regions[row["region_id"]], features[row["feature_id"]]
            low, high = np.maximum(G.bounds(r)[:2], G.bounds(f)[:2]), np.minimum(G.bounds(r)[2:], G.bounds(f)[2:])
            assert (G.bounds(cut)[:2] >= low - 1e-9).all() and (G.bounds(cut)[2:] <= high + 1e-9).all()
            assert cut[0] == f[0] and G.area(cut) <= min(G.area(r), G.area(f)) + 1e-9


def test_polygon_regions_hold_points_and_features_exactly(spark, drawn):
    regions, features = drawn
    r, rng = wkb_table(spark, regions, "region_id"), np.random.default_rng(12)
    xy = np.round(rng.uniform(-5, 5, (200, 2)), 2)
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "k int, lon double, lat double")
    want = sorted((k, i) for i, g in enumerate(regions) for k in np.flatnonzero(G._place(xy, g) > 0).tolist())
    assert rows(J.within_join(p, r, cell=0.8, how="inner"), "k", "region_id") == want
    assert {row["k"] for row in J.within_join(p, r, cell=0.8).collect() if row["region_id"] is None} == set(range(200)) - {k for k, _ in want}
    f = wkb_table(spark, features, "feature_id")
    got = [row["feature_id"] for row in J.semi_join(f, r.filter("region_id < 5"), cell=0.8, id_col="feature_id").orderBy("feature_id").collect()]
    assert got == [j for j, x in enumerate(features) if any(G.intersects(g, x) for g in regions[:5])]
    inside = [row["feature_id"] for row in J.semi_join(f, r, cell=0.8, id_col="feature_id", contained=True).orderBy("feature_id").collect()]
    assert inside == [j for j, x in enumerate(features) if any(G.within(x, g) for g in regions)]


@pytest.mark.parametrize("cell", [0.3, 1.0, 2.5])
def test_box_join_equals_brute_force(spark, cell):
    rng = np.random.default_rng(1)
    a, b = (np.round(rng.uniform(-3, 3, (60, 2)), 1) for _ in range(2))
    size = np.round(rng.uniform(0, 1.2, (60, 2)), 1)
    make = lambda c, name: spark.createDataFrame([(k, *map(float, (*p, *(p + s)))) for k, (p, s) in enumerate(zip(c, size, strict=True))], f"{name} int, minx double, miny double, maxx double, maxy double")
    got = rows(J.intersects_join(make(a, "region_id"), make(b, "feature_id"), cell=cell), "region_id", "feature_id")
    hi_a, hi_b = a + size, b + size
    want = [(i, j) for i in range(60) for j in range(60) if (a[i] <= hi_b[j]).all() and (b[j] <= hi_a[i]).all()]
    assert got == want


def test_join_inputs_are_checked(spark):
    with pytest.raises(ValueError):
        J.intersects_join(spark.createDataFrame([(1,)], "region_id int"), spark.createDataFrame([(1,)], "feature_id int"), cell=1.0)


def hops(graph, root):
    """Plain breadth-first distances."""
    far, todo = {root: 0}, [root]
    for x in todo:
        for y in graph.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    return far


def test_unit_boxes_touch_at_corners(spark):
    rng = np.random.default_rng(13)
    cells = sorted({(int(x), int(y)) for x, y in rng.integers(0, 6, (22, 2))})
    name = {c: f"c{c[0]}_{c[1]}" for c in cells}
    r = spark.createDataFrame([(name[x, y], float(x), float(y), x + 1.0, y + 1.0) for x, y in cells], "region_id string, minx double, miny double, maxx double, maxy double")
    graph = {name[a]: {name[b] for b in cells if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1} for a in cells}
    n = N.Neighbourhood(N.adjacency_edges(r, cell=1.0))
    for root in (name[cells[0]], name[cells[len(cells) // 2]]):
        far = hops(graph, root)
        assert n.neighbours(root) == graph[root]
        assert n.up_to(root, 2) == {x for x, d in far.items() if 0 < d <= 2}
        assert n.at(root, 3) == {x for x, d in far.items() if d == 3}
    assert n.neighbours("none") == set()


def test_polygons_touch_exactly(spark):
    shapes = [G.box(0, 0, 1, 1), G.box(1, 0, 2, 1), G.box(1, 1, 2, 2), G.box(0.5, 0.5, 1.5, 1.5)]
    r = spark.createDataFrame([(k, bytearray(G.to_wkb(g))) for k, g in enumerate(shapes)], "region_id int, geometry binary")
    assert rows(N.adjacency_edges(r, cell=0.6), "region_id", "neighbour_id") == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_center(spark, seed):
    rng = np.random.default_rng(seed)
    graph: dict = {k: set() for k in range(14)}
    for a, b in rng.integers(0, 14, (18, 2)).tolist():
        if a != b:
            graph[a].add(b)
            graph[b].add(a)
    graph = {k: v for k, v in graph.items() if v}
    root = max(graph, key=lambda k: max(hops(graph, k).values()))
    far = hops(graph, root)
    for center in (False, True):
        n = N.Neighbourhood(N.edges_from_lookup(spark, graph), include_center=center)
        for distance in (-1, 0, 1, 3):
            within = {x for x, d in far.items() if 0 < d <= distance}
            own = {root} if center and distance >= 0 else set()
            assert n.up_to(root, distance) == within | own
            assert n.at(root, distance) == ({x for x, d in far.items() if d == distance > 0} | (own if distance == 0 else set()))
        assert n.up_to(root, 2, include_center=not center) == {x for x, d in far.items() if 0 < d <= 2} | (set() if center else {root})
    assert N.up_to_distance(N.edges_from_lookup(spark, graph), 100).filter(F.col("region_id") == root).count() == len(far) - 1


def test_own_neighbour_function(spark):
    r = spark.createDataFrame([("a",), ("b",)], "region_id string")
    edges = N.edges_from_function(r, lambda x: {"a": ["b"], "b": ["a"]}[x])
    assert rows(edges, "region_id", "neighbour_id") == [("a", "b"), ("b", "a")]


def test_tiles_of_a_polygon_equal_brute_force(spark):
    shape = G.polygon([(9.91, 44.2), (10.35, 44.31), (10.52, 44.78), (10.11, 44.6), (9.83, 44.71)])
    area = spark.createDataFrame([(bytearray(G.to_wkb(shape)),)], "geometry binary")
    got = R.slippy_regions(area, 11)
    lon = lambda x: x / 2048 * 360 - 180
    lat = lambda y: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y / 2048))))
    want = [(x, y) for x in range(1070, 1095) for y in range(700, 780) if G.intersects(G.box(lon(x), lat(y + 1), lon(x + 1), lat(y)), shape)]
    assert len(want) > 10 and rows(got, "x", "y") == want
    assert got.filter(F.col("region_id") == f"{want[0][0]}_{want[0][1]}_11").count() == 1
    for zoom in (-1, 20):
        with pytest.raises(ValueError):
            R.slippy_regions(area, zoom)


def test_paths_step_to_neighbours(spark):
    df = spark.createDataFrame([(0, 0, 5, -3), (4, 4, 4, 4), (0, 0, -7, 7)], "a long, b long, c long, d long")
    for r in df.select("*", grid.path(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p")).collect():
        p = [(c["x"], c["y"]) for c in r["p"]]
        assert p[0] == (r["a"], r["b"]) and p[-1] == (r["c"], r["d"])
        assert all(max(abs(x - u), abs(y - v)) == 1 for (x, y), (u, v) in zip(p, p[1:], strict=False))


def test_hex_disks(spark):
    got = spark.range(1).select(grid.hex_disk(F.lit(0), F.lit(0), 2).alias("c")).first()["c"]
    assert len(got) == 19 and sum(c["distance"] == 2 for c in got) == 12


def test_s2_cells(spark):
    assert [s2.token(int(c)) for c in s2.cell_ids(np.array([0, 90, 0, 180, -90, 0]), np.array([0, 0, 90, 0, 0, -90.0]), 0)] == ["1", "3", "5", "7", "9", "b"]
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(-180, 180, 300), rng.uniform(-89, 89, 300)
    assert s2.token(int(s2.cell_ids(np.array([-74.006]), np.array([40.7128]), 10)[0])).startswith("89c25")
    for level in (5, 14, 30):
        ids = s2.cell_ids(lon, lat, level)
        mid = np.array([s2.center(int(c)) for c in ids])
        assert (s2.cell_ids(mid[:, 0], mid[:, 1], level) == ids).all()
        assert all(s2.level_of(int(c)) == level and s2.from_token(s2.token(int(c))) == int(c) for c in ids)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], "lon double, lat double")
    c = df.select(s2.s2_cell(F.col("lon"), F.col("lat"), 9).alias("c"), s2.s2_cell(F.col("lon"), F.col("lat"), 6).alias("p"))
    assert c.filter(s2.s2_parent(F.col("c"), 6) != F.col("p")).count() == 0
    kids = c.select("c", "p", s2.s2_children(F.col("p"), 6, 9).alias("k"))
    assert kids.filter(~F.array_contains("k", F.col("c")) | (F.size("k") != 64)).count() == 0
    assert c.filter(s2.s2_id(s2.s2_token(F.col("c"))) != F.col("c")).count() == 0
    with pytest.raises(ValueError):
        s2.s2_children(F.col("c"), 9, 6)
    with pytest.raises(ValueError):
        s2.check_level(31)


def test_s2_regions_cover_an_area(spark):
    area = spark.createDataFrame([(bytearray(G.to_wkb(G.box(17.0, 51.0, 17.2, 51.1))),)], "geometry binary")
    over, inner = R.s2_regions(area, 12), R.s2_regions(area, 12, buffer=False)
    a, b = {r["region_id"] for r in over.collect()}, {r["region_id"] for r in inner.collect()}
    assert b and b < a
    rng = np.random.default_rng(3)
    lon, lat = rng.uniform(17.0, 17.2, 200), rng.uniform(51.0, 51.1, 200)
    assert {s2.token(int(c)) for c in s2.cell_ids(lon, lat, 12)} <= a


def test_voronoi(spark):
    rng = np.random.default_rng(4)
    seeds = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform([-170, -80], [170, 80], (12, 2)))]
    s = spark.createDataFrame(seeds, "region_id int, lon double, lat double")
    p = spark.createDataFrame([(float(x), float(y)) for x, y in rng.uniform([-180, -90], [180, 90], (150, 2))], "lon double, lat double")
    near = R.voronoi_assign(p, s).collect()
    shapes = {r["region_id"]: G.from_wkb(bytes(r["geometry"])) for r in R.voronoi_polygons(s, step_degrees=6.0).collect()}
    assert set(shapes) == set(range(12))
    assert sum(map(G.area, shapes.values())) == pytest.approx(360 * 180, rel=1e-9)
    hits = sum(G.intersects(G.point(r["lon"], r["lat"]), shapes[r["region_id"]]) for r in near)
    assert hits >= 145  # edges are drawn as chords of 6 degrees
    spread = R.voronoi_assign(p.limit(40), s, cell=20.0)
    want = {(r["lon"], r["lat"]): r["region_id"] for r in near}
    assert all(want[r["lon"], r["lat"]] == r["region_id"] for r in spread.collect())
    with pytest.raises(ValueError):
        R.voronoi_assign(p, s.limit(3))
    with pytest.raises(ValueError):
        R.check_seeds(s.union(s), "region_id")


def test_voronoi_grid_equals_all_pairs_across_the_antimeridian_and_at_the_poles(spark):
    rng = np.random.default_rng(5)
    seeds = [(-179.9, 10.0), (178.0, 10.0), (0.0, 89.0), (120.0, 85.0), (180.0, -30.0), (-175.0, -89.5), *rng.uniform([100, -60], [180, 60], (20, 2)).tolist()]
    places = [(179.9, 10.0), (180.0, 10.0), (-180.0, 10.0), (-179.9, -30.5), (-100.0, 89.5), (60.0, -89.9), (-60.0, 0.0), (None, 1.0)]
    places += rng.uniform([-180, -90], [180, 90], (40, 2)).tolist() + rng.uniform([178, -60], [180, 60], (20, 2)).tolist()
    s = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(seeds)], "region_id int, lon double, lat double")
    p = spark.createDataFrame([(k, *x) for k, x in enumerate(places)], "k int, lon double, lat double")
    want = {r["k"]: (r["region_id"], r["distance_m"]) for r in R.voronoi_assign(p, s).collect()}
    assert want[0][0] == 0 and len(want) == len(places)
    for cell, rounds in ((1.0, 12), (8.0, 12), (1.0, 2)):
        got = R.voronoi_assign(p, s, cell=cell, rounds=rounds).collect()
        assert len(got) == len(places) and {r["k"]: (r["region_id"], r["distance_m"]) for r in got} == want


@pytest.mark.parametrize("kind", ["even", "crowded", "few", "line"])
def test_voronoi_regions_by_security_radius(spark, kind):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(300, 3))
    if kind == "crowded":
        p[:280] = [0.3, 0.2, 0.9] + rng.normal(0, 0.003, (280, 3))
    if kind == "few":
        p = np.array([[1, 0.1, 0.2], [0.9, 0.3, 0.1], [1, 0.2, 0.4], [0.8, 0.3, 0.4], [0, 0, 1.0]])
    if kind == "line":
        p = np.stack([np.cos(np.arange(40) / 9), np.sin(np.arange(40) / 9), np.zeros(40)], 1)
    p /= np.linalg.norm(p, axis=1)[:, None]
    rows_ = [(k, *map(float, np.degrees([np.arctan2(y, x), np.arcsin(z)]))) for k, (x, y, z) in enumerate(p)]
    seeds = spark.createDataFrame(rows_, "region_id int, lon double, lat double")
    found = V.regions(seeds, "region_id").collect()
    assert sorted(r["sid"] for r in found) == list(range(len(p)))
    total = 0.0
    for r in found:
        flat = np.array([(v["x"], v["y"], v["z"]) for v in r["verts"]])
        near = flat @ p.T
        assert (near[:, r["sid"]] >= near.max(1) - 1e-9).all()  # no corner is nearer to another seed
        for piece in np.split(flat, np.cumsum(r["sizes"])[:-1]):
            for k in range(1, len(piece) - 1):  # solid angles of a fan
                a, b, c = piece[0], piece[k], piece[k + 1]
                total += abs(2 * np.arctan2(np.dot(a, np.cross(b, c)), 1 + a @ b + b @ c + c @ a))
    assert total == pytest.approx(4 * np.pi, rel=1e-9)
    shapes = R.voronoi_polygons(seeds, step_degrees=3.0).collect()
    assert sum(G.area(G.from_wkb(bytes(r["geometry"]))) for r in shapes) == pytest.approx(360 * 180, rel=1e-9)


def test_voronoi_chunks_ask_each_other(spark, monkeypatch):
    """Crowded and sparse seeds, the antimeridian and a pole among them, in many chunks."""
    monkeypatch.setattr(V, "LEAST_CHUNK", 100)
    monkeypatch.setattr(V, "NET", 64)
    rng = np.random.default_rng(8)
    p = np.vstack([rng.normal(size=(300, 3)), [0.3, 0.2, 0.9] + rng.normal(0, 1e-3, (500, 3)), [-1, 0, 0.1] + rng.normal(0, 1e-2, (200, 3)), [[0, 0, 1.0]]])
    p /= np.linalg.norm(p, axis=1)[:, None]
    rows_ = [(k, *map(float, np.degrees([np.arctan2(y, x), np.arcsin(z)]))) for k, (x, y, z) in enumerate(p)]
    found = V.regions(spark.createDataFrame(rows_, "region_id int, lon double, lat double"), "region_id").collect()
    assert sorted(r["sid"] for r in found) == list(range(len(p)))
    total = 0.0
    for r in found:
        flat = np.array([(v["x"], v["y"], v["z"]) for v in r["verts"]])
        near = flat @ p.T
        assert (near[:, r["sid"]] >= near.max(1) - 1e-12).all()
        for piece in np.split(flat, np.cumsum(r["sizes"])[:-1]):
            for k in range(1, len(piece) - 1):
                a, b, c = piece[0], piece[k], piece[k + 1]
                total += abs(2 * np.arctan2(np.dot(a, np.cross(b, c)), 1 + a @ b + b @ c + c @ a))
    assert total == pytest.approx(4 * np.pi, rel=1e-9)


def test_nearest_seed_equals_all_pairs():
    rng = np.random.default_rng(9)
    p = np.vstack([rng.normal(size=(700, 3)), [1, 0.5, 0.2] + rng.normal(0, 1e-4, (900, 3))])
    p /= np.linalg.norm(p, axis=1)[:, None]
    p = p[np.argsort(V.curve(p))]
    places = np.vstack([p[::7] + rng.normal(0, 1e-4, (len(p[::7]), 3)), rng.normal(size=(50, 3))])
    d = ((places[:, None] - p) ** 2).sum(2)
    known, most = V.Nearest(p), np.full(len(places), 1e-8)
    got = known(places, np.full(len(places), 100.0))
    assert d[np.arange(len(d)), d.argmin(1)] == pytest.approx(((places - known.seeds[got]) ** 2).sum(1))
    some = known(places, most)
    assert ((some >= 0) == (d.min(1) <= 1e-8)).all() and 0 < (some >= 0).sum() < len(places)


def test_points_meet_boxes_on_cells_not_much_larger(spark):
    size = [2.0**k for k in range(-12, 9)]
    boxes = spark.createDataFrame([(0.0, 0.0, v, v) for v in size], "minx double, miny double, maxx double, maxy double")
    grid = J.ladder(spark.createDataFrame([(0.5, 0.5)], "lon double, lat double"), boxes, (True, False), J.POINT_LEVELS)
    assert all(min(c for c in grid.sizes if c >= v) <= 8 * v for v in size) and len(grid.sizes) <= J.POINT_LEVELS


def test_areas_and_bounds_of_mixed_shapes(spark):
    hole = G.polygon([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)])
    shapes = [G.box(0, 0, 1, 2), hole, G.merged([G.box(0, 0, 1, 1), G.box(2, 2, 3, 3)]), G.point(1, 2), G.polygon([(5, 5), (6, 5), (5, 7)])]
    df = spark.createDataFrame([(k, bytearray(G.to_wkb(g)) if g else None) for k, g in enumerate([*shapes, None])], "k int, geometry binary").coalesce(1)
    got = {r["k"]: r for r in df.select("k", G.st_area(F.col("geometry")).alias("a"), G.st_bounds(F.col("geometry")).alias("b"), G.st_holds(F.col("geometry"), F.lit(0.5), F.lit(0.5)).alias("h"), F.size(G.st_parts(F.col("geometry"))).alias("n")).collect()}
    for k, g in enumerate(shapes):
        assert got[k]["a"] == pytest.approx(G.area(g)) and tuple(got[k]["b"]) == G.bounds(g)
    assert got[5]["a"] is None and got[5]["b"]["minx"] is None
    assert [got[k]["h"] for k in range(5)] == [True, True, True, False, False] and got[2]["n"] == 2 and got[0]["n"] == 1


def test_geometry_kernel():
    hole = G.polygon([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)])
    assert G.area(hole) == 12 and G.area(G.without_holes(hole)) == 16
    assert not G.intersects(G.point(2, 2), hole) and G.intersects(G.point(1, 2), hole) and G.intersects(G.box(1.5, 1.5, 5, 2), hole)
    assert G.from_wkb(G.to_wkb(hole))[0] == "polygon" and len(G.from_wkb(G.to_wkb(hole))[1][0]) == 2
    assert G.to_wkt(G.box(0, 0, 1, 1)) == "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    both = G.merged([G.box(0, 0, 1, 1), G.box(2, 2, 3, 3)])
    assert len(G.flatten(both)) == 2 and G.to_wkt(both).startswith("MULTIPOLYGON")
    assert G.touches(G.box(0, 0, 1, 1), G.box(1, 0, 2, 1)) and not G.touches(G.box(0, 0, 1, 1), G.box(0, 0, 1, 1))
    assert G.within(G.box(0, 0, 1, 1), G.box(0, 0, 2, 2)) and not G.within(G.point(0, 0), G.box(0, 0, 2, 2))
    ring = G.buffer_metres(G.point(17, 51), 1000)
    assert G.area(ring) * 111_194.9**2 * np.cos(np.radians(51)) == pytest.approx(np.pi * 1e6, rel=0.02)
    line = ("line", [[np.array([(-1, 0.5), (2, 0.5)])]])
    assert [p[0].tolist() for p in G.clip_convex(line, G.box(0, 0, 1, 1)[1][0][0])[1]] == [[[0, 0.5], [1, 0.5]]]


def test_administrative_regions(spark):
    b = spark.createDataFrame(
        [(1, 8, {"name": "A", "name:en": "Ae"}, 0.0, 0.0, 1.0, 1.0), (2, 8, {"name": "B"}, 0.999, 0.0, 3.0, 1.0), (3, 4, {"name": "C"}, 0.0, 0.0, 9.0, 9.0), (4, 8, {}, 5.0, 5.0, 6.0, 6.0)],
        "element_id long, admin_level int, tags map<string,string>, minx double, miny double, maxx double, maxy double",
    )
    area = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "minx double, miny double, maxx double, maxy double")
    assert rows(R.administrative_regions(b, area, admin_level=8), "region_id", "element_id") == [("Ae", 1)]
    with pytest.raises(ValueError):
        R.administrative_regions(b, area, admin_level=12)


def _boxes(spark, low, size, name):
    data = [(k, *map(float, (*p, *(p + s)))) for k, (p, s) in enumerate(zip(low, size, strict=True))]
    return spark.createDataFrame(data, f"{name} int, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("kind", ["one", "two", "all", "points"])
def test_joins_find_their_own_grid(spark, kind):
    rng = np.random.default_rng(21)
    n = 150
    low = [np.round(rng.uniform(-3, 3, (n, 2)), 4) for _ in range(2)]
    size = {
        "one": lambda: rng.uniform(0.1, 0.4, (n, 1)),
        "two": lambda: np.where(rng.random((n, 1)) < 0.1, 100.0, 1e-4),
        "all": lambda: 10.0 ** rng.uniform(-5, 2, (n, 1)),
        "points": lambda: np.zeros((n, 1)),
    }
    a, b = np.round(size[kind]() * rng.uniform(0.2, 1, (n, 2)), 6), np.round(size["all" if kind == "points" else kind]() * rng.uniform(0.2, 1, (n, 2)), 6)
    low[0][: n // 3] = (low[1] + b)[: n // 3]  # corners that touch
    l, r = _boxes(spark, low[0], a, "region_id"), _boxes(spark, low[1], b, "feature_id")
    corner = lambda lo, s: np.concatenate([lo, lo + s], 1)
    x, y = corner(low[0], a), corner(low[1], b)
    want = [(i, j) for i in range(n) for j in range(n) if (x[i, :2] <= y[j, 2:]).all() and (y[j, :2] <= x[i, 2:]).all()]
    assert len(want) > 20 and rows(J.intersects_join(l, r), "region_id", "feature_id") == want
    grid = J.ladder(l, r)
    copies = J.covered(l.union(l.limit(0)), grid, "l_", left=True).groupBy("region_id").count().agg({"count": "max", "*": "count"}).first()
    if kind == "two":
        assert len(grid.sizes) == 2 and copies[0] <= 8
    if kind == "points":
        p = l.withColumnsRenamed({"minx": "lon", "miny": "lat", "region_id": "_k"}).drop("maxx", "maxy").withColumnRenamed("_k", "k")
        inside = sorted((i, j) for i in range(n) for j in range(n) if (low[0][i] > y[j, :2]).all() and (low[0][i] < y[j, 2:]).all())
        boxes = r.withColumnRenamed("feature_id", "region_id")
        assert rows(J.within_join(p, boxes, how="inner"), "k", "region_id") == inside
        both = J.within_join(p, boxes)
        assert both.columns == ["k", "lon", "lat", "region_id"]
        assert {row["k"] for row in both.collect() if row["region_id"] is None} == set(range(n)) - {i for i, _ in inside}


def test_joins_of_empty_tables_and_boxes_beyond_the_largest_level(spark):
    far, none = _boxes(spark, np.array([[-5000.0, -5000.0]]), np.array([[10_000.0, 9000.0]]), "region_id"), _boxes(spark, np.zeros((1, 2)), np.zeros((1, 2)), "feature_id")
    assert J.intersects_join(far, none.limit(0)).count() == 0
    spots = _boxes(spark, np.array([[1.0, 2.0], [5000.0, 0.0], [5001.0, 0.0]]), np.zeros((3, 2)), "feature_id")
    assert rows(J.intersects_join(far, spots), "region_id", "feature_id") == [(0, 0), (0, 1)]


def test_hops_from_many_starts_at_once(spark, monkeypatch):
    side, sizes = 20, []
    graph = {(x, y): [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= x + a < side and 0 <= y + b < side] for x in range(side) for y in range(side)}
    name = lambda c: c[0] * side + c[1]
    graph = {name(c): {name(n) for n in near} for c, near in graph.items()}
    graph[0].add(399)  # one way only
    edges = N.edges_from_lookup(spark, graph)
    keep = N.written
    monkeypatch.setattr(N, "written", lambda df, label: (out := keep(df, label), label == "hops" and sizes.append(out.count()))[0])
    got = N.up_to_distance(edges, 5, include_center=True)
    want = sorted((r, n, d) for r in graph for n, d in hops(graph, r).items() if d <= 5)
    assert sorted((r["region_id"], r["neighbour_id"], r["distance"]) for r in got.collect()) == want
    assert max(sizes) * 4 < len(want)
    few = N.up_to_distance(edges, 100, roots=spark.createDataFrame([(0,), (0,), (777,)], "region_id long"))
    assert sorted((r["neighbour_id"], r["distance"]) for r in few.filter("region_id = 0").collect()) == sorted((n, d) for n, d in hops(graph, 0).items() if d)
    assert few.filter("region_id = 777").count() == 0


def test_simplified_neighbours_share_their_borders(spark):
    rng = np.random.default_rng(9)
    n = 4
    line = lambda a, b: np.array(a) + np.linspace(0, 1, 31)[:, None] * (np.array(b) - np.array(a))
    sides = {}

    def side(a, b):
        key = (min(a, b), max(a, b))
        if key not in sides:
            p = line(*key)
            p[1:-1] += rng.normal(0, 0.02, (29, 2))
            sides[key] = p
        return sides[key] if a < b else sides[key][::-1]

    shapes = []
    for x in range(n):
        for y in range(n):
            c = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
            ring = np.vstack([side(c[k], c[(k + 1) % 4])[:-1] for k in range(4)])
            shapes.append(np.roll(ring, int(rng.integers(0, len(ring))), 0)[:: 1 if rng.random() < 0.5 else -1])
    hole = np.array([(0.5 + 0.2 * np.cos(t), 0.5 + 0.2 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 90)[:-1]])
    geometries = [G.polygon(shapes[0], hole), *[G.polygon(s) for s in shapes[1:]], G.polygon(np.roll(hole, 33, 0)[::-1])]
    df = spark.createDataFrame([(k, bytearray(G.to_wkb(g)), k) for k, g in enumerate(geometries)] + [(99, None, 1)], "region_id int, geometry binary, extra int").repartition(3)
    got = {r["region_id"]: r["geometry"] for r in borders.simplify_shared(df, 0.05).collect()}
    assert set(got) == set(range(n * n + 1)) | {99} and got.pop(99) is None
    thin = {k: G.from_wkb(bytes(g)) for k, g in got.items()}
    assert sum(len(r) for g in thin.values() for p in g[1] for r in p) * 3 < sum(len(r) for g in geometries for p in g[1] for r in p)
    edges: dict = {}
    for g in thin.values():
        for part in g[1]:
            for r in part:
                for a, b in zip(map(tuple, r[:-1]), map(tuple, r[1:]), strict=True):
                    edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
    border = [np.array(e) for e, c in edges.items() if c == 1]
    assert set(edges.values()) == {1, 2}
    assert all(any(((e[:, axis] - at) ** 2 < 0.2**2).all() for axis in (0, 1) for at in (0, n)) for e in border)  # only the outer border has one side


def test_multiplied_rows_are_not_sent_to_all(spark, tmp_path):
    """Files that pack well look small to the planner, though their rows are multiplied before they meet."""
    spark.range(40_000).selectExpr("id as k", "(id % 200) / 100 as lon", "floor(id / 200) / 100 as lat").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    boxes = p.selectExpr("k as region_id", "lon - 0.001 as minx", "lat - 0.001 as miny", "lon + 0.001 as maxx", "lat + 0.001 as maxy")
    for joined in (J.within_join(p, boxes, how="inner"), J.intersects_join(p.withColumnRenamed("k", "region_id"), boxes.withColumnRenamed("region_id", "feature_id"))):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert J.within_join(p, boxes, how="inner").count() == 40_000


def test_buffers_of_many_points_are_worked_out_together(spark, monkeypatch):
    from geoloom.functions import geometry as G

    xy = np.stack([np.linspace(-179.5, 179.5, 60), np.linspace(-88, 88, 60)], 1)
    want = [G.buffer_metres(G.point(*p), 700.0)[1][0][0] for p in xy]
    monkeypatch.setattr(G, "convex_hull", lambda r, own=G.convex_hull, calls=[]: calls.append(1) or (own(r) if len(calls) == 1 else None))
    got = G.points_buffered(G._single_points([G.to_wkb(G.point(*p)) for p in xy]), 700.0)
    assert all(np.allclose(G.from_wkb(a)[1][0][0], b, rtol=0, atol=1e-9) for a, b in zip(got, want, strict=True))
    assert G._single_points([G.to_wkb(G.point(1, 2)), None]) is None and G._single_points([G.to_wkb(G.box(0, 0, 1, 1))]) is None


def test_points_are_written_bounded_and_cut_without_the_codec(spark, monkeypatch):
    import pandas as pd

    from geoloom.functions import geometry as G

    x, y = np.array([0.0, 1.0, 2.0, 1.5]), np.array([0.0, 1.0, 0.5, 3.0])
    raws = [G.to_wkb(G.point(*p)) for p in zip(x, y, strict=True)]
    for name in ("from_wkb", "to_wkb"):
        monkeypatch.setattr(G, name, None)
    udf = lambda c: c.func if hasattr(c, "func") else c
    assert G.points_wkb(x, y) == raws
    seen = {}
    monkeypatch.setattr(G, "pandas_udf", lambda kind: lambda f: lambda *columns: seen.setdefault("f", udf(f)))
    G.st_bounds(None)
    assert seen.pop("f")(pd.Series(raws)).to_numpy().tolist() == np.stack([x, y, x, y], 1).tolist()
    G.st_clip_box(None, None, None, None, None)
    box = [pd.Series([v] * 4) for v in (0.0, 0.0, 2.0, 1.0)]
    assert seen.pop("f")(pd.Series(raws), *box).tolist() == [*raws[:3], None]
