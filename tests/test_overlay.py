"""Polygon overlays against where random points lie."""

import numpy as np
import pytest

from geoloom.functions import geometry as G
from geoloom.functions import overlay as O


def star(rng):
    n = rng.integers(3, 9)
    angle, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1, n)
    return G.polygon(np.round(rng.uniform(-0.5, 0.5, 2) + np.stack([far * np.cos(angle), far * np.sin(angle)], 1), int(rng.integers(1, 4))))


def simple(g):
    s = G._segments(g)
    meet, cross = G.segments_meet(s, s)
    return not cross.any() and meet.sum() <= 3 * len(s) and G.area(g) > 1e-3


def test_overlays_hold_the_right_places():
    rng = np.random.default_rng(0)
    inside = lambda xy, g: G._place(xy, g) > 0 if g[1] else np.zeros(len(xy), bool)
    done = 0
    for _ in range(250):
        a, b = star(rng), star(rng)
        if not (simple(a) and simple(b)):
            continue
        xy = rng.uniform(-1.6, 1.6, (1500, 2))
        ia, ib = inside(xy, a), inside(xy, b)
        for how, want in (("intersection", ia & ib), ("union", ia | ib), ("difference", ia & ~ib)):
            assert (inside(xy, O.overlay(a, b, how)) == want).all()
        assert G.area(O.overlay(a, b, "intersection")) + G.area(O.overlay(a, b, "union")) == pytest.approx(G.area(a) + G.area(b))
        done += 1
    assert done > 100


def test_touching_equal_and_holed():
    a = G.box(0, 0, 2, 2)
    assert G.to_wkt(O.overlay(a, a, "union")) == G.to_wkt(O.overlay(a, a, "intersection")) and not O.overlay(a, a, "difference")[1]
    assert not O.overlay(a, G.box(2, 0, 3, 2), "intersection")[1] and len(O.overlay(a, G.box(2, 0, 3, 2), "union")[1]) == 1
    ring = O.overlay(G.box(0, 0, 4, 4), G.box(1, 1, 2, 2), "difference")
    assert G.area(ring) == 15 and len(ring[1][0]) == 2
    assert len(O.union_all([G.box(k, 0, k + 0.5, 1) for k in range(5)])[1]) == 5
    with pytest.raises(ValueError):
        O.overlay(a, a, "other")


def test_lines_and_points_are_clipped():
    line = ("line", [[np.array([(-1.0, 1.0), (5.0, 1.0)])]])
    mask = O.overlay(G.box(0, 0, 4, 4), G.box(1, 0.5, 2, 2), "difference")
    got = O.clipped(line, mask)
    assert sorted((p[0][0, 0], p[0][-1, 0]) for p in got[1]) == [(0, 1), (2, 4)]
    assert len(O.clipped(G.point(3, 3), mask)[1]) == 1 and not O.clipped(G.point(1.5, 1), mask)[1]


def test_many_pairs_are_cut_as_each_alone(monkeypatch):
    rng = np.random.default_rng(4)
    ring = O.overlay(G.box(0, 0, 4, 4), G.box(1, 1, 2, 2), "difference")
    shapes = [G.box(x, y, x + w, y + 2) for x, y, w in rng.integers(1, 5, (40, 3))] + [ring, G.merged([G.box(0, 0, 1, 1), G.box(2, 2, 3, 5)]), ("polygon", [])]
    a, b = ([shapes[k] for k in rng.integers(0, len(shapes), 150)] for _ in range(2))
    alone = [G.intersects(x, y) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(G, "_TOGETHER", 7)  # as many edges are looked at together as a small slice holds
    assert G.intersects_all(a, b).tolist() == alone
    for how in ("intersection", "union", "difference"):
        for x, y, got in zip(a, b, O.overlays(a, b, how), strict=True):
            assert G.to_wkb(got) == G.to_wkb(O.overlay(x, y, how))


def test_pairs_of_one_small_file_are_cut_by_all_cores(spark):
    """The exact steps come after a shuffle that deals the pairs, and each runs once."""
    from pyspark.sql import functions as F

    from geoloom.operators import spatial_join

    k = F.col("id")
    r = spark.range(2).select(k.alias("region_id"), k.cast("double").alias("minx"), F.lit(0.0).alias("miny"), (k + 1.0).alias("maxx"), F.lit(1.0).alias("maxy"))
    f = spark.range(40).coalesce(1).select(k.alias("feature_id"), (k / 20).alias("minx"), F.lit(0.5).alias("miny"), (k / 20 + 0.1).alias("maxx"), F.lit(2.0).alias("maxy"))
    r, f = (x.withColumn("geometry", spatial_join._box_wkb("")) for x in (r, f))
    got = spatial_join.intersects_join(r, f, cell=0.5, return_geometry=True).filter("geometry is not null")
    assert got.groupBy().agg(F.round(F.sum(G.st_area(F.col("geometry"))), 9)).first()[0] == pytest.approx(39 * 0.1 * 0.5 + 0.05 * 0.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 2 and plan.index("run(l_geometry") < plan.index("Repartition")


def test_points_of_one_small_file_are_placed_by_all_cores(spark):
    """A point on an edge lies in no polygon, one in a part of a multipolygon in it; other points are kept once."""
    from pyspark.sql import functions as F

    from geoloom.operators import spatial_join

    two = G.merged([G.box(0, 0, 1, 1), G.box(2, 0, 3, 1)])
    areas = spark.createDataFrame([("two", bytearray(G.to_wkb(two))), ("cut", bytearray(G.to_wkb(G.polygon([(0, 0), (3, 0), (0, 3)]))))], "region_id string, geometry binary")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 2.5, 0.75), (4, 1.0, 0.5), (5, 9.0, 9.0)], "feature_id long, lon double, lat double").coalesce(1)
    got = spatial_join.within_join(points, areas, cell=1.0)
    rows = sorted((r["feature_id"], r["region_id"] or "") for r in got.select("feature_id", "region_id").collect())
    assert rows == [(1, "cut"), (1, "two"), (2, "cut"), (3, "two"), (4, "cut"), (5, "")]
    inner = spatial_join.within_join(points, areas, cell=1.0, how="inner").select("feature_id", F.col("region_id"))
    assert "Repartition" in inner._jdf.queryExecution().optimizedPlan().toString()
