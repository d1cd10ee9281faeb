"""Simplification that keeps shared borders shared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.schema import BOX, GEOMETRY
from geoloom.storage import written


def _rings(wkb: bytes) -> list[list[np.ndarray]]:
    """The rings of each part, closed."""
    return [[r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]) for r in part] for part in G.from_wkb(wkb)[1]]


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each corner of a shape with one of its two neighbours on the ring."""
    for batch in batches:
        for row, wkb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rings = [r[np.concatenate([[True], (r[1:] != r[:-1]).any(1)])] for part in _rings(wkb) for r in part]
            ends = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings] or [np.zeros((0, 4))])
            both = np.vstack([ends, ends[:, [2, 3, 0, 1]]]) + 0.0  # no negative zeros, which are other keys
            yield pa.record_batch([pa.array(np.full(len(both), row)), *[pa.array(c) for c in both.T]], names=["row", "x", "y", "nx", "ny"])


def thin_arc(arc: np.ndarray, tolerance: float) -> np.ndarray:
    """An arc with fewer corners, the same whichever end it is given from; a closed one keeps three corners at least."""
    head, tail = tuple(map(tuple, arc)), tuple(map(tuple, arc[::-1]))
    turned = tail < head
    line = arc[::-1] if turned else arc
    out = G.simplified(("line", [[line]]), tolerance)[1][0][0]
    if len(out) < 4 and (line[0] == line[-1]).all() and len(line) >= 4:
        far = int(np.hypot(*(line - line[0]).T).argmax())
        d = line[far] - line[0]
        off = np.abs((line - line[0]) @ np.array([-d[1], d[0]]))
        keep = sorted({0, far, int(off.argmax()), len(line) - 1})
        out = line[keep]
    return out[::-1] if turned else out


def _thin_ring(ring: np.ndarray, junctions: set[tuple[float, float]], tolerance: float) -> np.ndarray | None:
    """A ring cut at junctions, each arc thinned alone; without junctions it is one arc from its least corner."""
    open_ = ring[:-1]
    open_ = open_[np.concatenate([[True], (open_[1:] != open_[:-1]).any(1)])] + 0.0
    cuts = [k for k, p in enumerate(map(tuple, open_)) if p in junctions]
    if not cuts:
        cuts = [min(range(len(open_)), key=lambda k: tuple(open_[k]))]
    open_ = np.roll(open_, -cuts[0], 0)
    at = [k - cuts[0] for k in cuts] + [len(open_)]
    closed = np.vstack([open_, open_[:1]])
    out = np.vstack([thin_arc(closed[a : b + 1], tolerance)[:-1] for a, b in zip(at[:-1], at[1:], strict=True)])
    return np.vstack([out, out[:1]]) if len(out) >= 3 else None


def simplify_shared(shapes: DataFrame, tolerance: float) -> DataFrame:
    """Polygons (WKB) with fewer corners, none farther than ``tolerance`` from the arcs that stay; neighbours keep the same border.

    Corners of all shapes are joined by place: one with other than two neighbours is a junction, where borders
    part. Rings are cut there, and an arc is thinned by a rule that knows nothing but the arc, so both sides of a border get the
    same corners and neither gaps nor overlaps open. Borders must share their corners; a corner in
    the middle of a neighbour's edge does not count as shared. A shape that is nowhere wider than the tolerance may lose its area; it
    is then left out. Null geometries stay.
    """
    rows = written(shapes.drop(*BOX).withColumn("_row", F.monotonically_increasing_id()), "shapes")
    corners = written(rows.filter(F.col(GEOMETRY).isNotNull()).select("_row", GEOMETRY).mapInArrow(_corners, "row long, x double, y double, nx double, ny double"), "corners")
    parted = corners.select("x", "y", "nx", "ny").distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n <> 2").select("x", "y")
    own = corners.select("row", "x", "y").distinct().join(parted, ["x", "y"]).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("x", "y")).alias("_cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wkb, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = {(c["x"], c["y"]) for c in cuts or ()}
                parts = [[_thin_ring(r, at, tolerance) for r in part] for part in _rings(wkb)]
                parts = [[r for r in part if r is not None] for part in parts if part and part[0] is not None]
                out.append(G.to_wkb(("polygon", parts)) if parts else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["_row", "_thin"])

    thin = rows.filter(F.col(GEOMETRY).isNotNull()).select("_row", GEOMETRY).join(own, "_row", "left").mapInArrow(run, "_row long, _thin binary").filter("_thin is not null")
    done = rows.drop(GEOMETRY).join(thin, "_row").withColumnRenamed("_thin", GEOMETRY)
    none = rows.filter(F.col(GEOMETRY).isNull())
    keep = [c for c in shapes.columns if c not in BOX]
    return done.unionByName(none).select(*[F.col(f"`{c}`") for c in keep])
