"""Geometry: WKB and WKT codecs and planar predicates in numpy, and their Arrow column functions.

A geometry is (kind, parts): kind is "point", "line" or "polygon" and every part is a list of
coordinate arrays (one array for points and lines; outer ring, then holes, for polygons).
Bounding boxes are what joins work on; these functions settle the exact answer for pairs
whose boxes meet.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

EARTH_RADIUS_M = 6_371_008.8
Geometry = tuple[str, list[list[np.ndarray]]]


# --- Codecs ----------------------------------------------------------------------------------


def from_wkb(data: bytes) -> Geometry:
    """Point, line string, polygon and their multi forms and collections, of two dimensions."""
    kinds: list[str] = []
    parts: list[list[np.ndarray]] = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5
        if code & 0x20000000:  # an SRID follows
            at, code = at + 4, code & ~0x20000000
        if code == 1:
            kinds.append("point")
            parts.append([np.frombuffer(data, f"{order}f8", 2, at).reshape(1, 2).astype(float)])
            return at + 16
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        if code == 2:
            kinds.append("line")
            parts.append([np.frombuffer(data, f"{order}f8", 2 * n, at).reshape(n, 2).astype(float)])
            return at + 16 * n
        if code == 3:
            rings = []
            for _ in range(n):
                (m,) = struct.unpack_from(f"{order}I", data, at)
                rings.append(np.frombuffer(data, f"{order}f8", 2 * m, at + 4).reshape(m, 2).astype(float))
                at += 4 + 16 * m
            if rings:
                kinds.append("polygon")
                parts.append(rings)
            return at
        if code in (4, 5, 6, 7):
            for _ in range(n):
                at = read(at)
            return at
        raise ValueError(f"unsupported geometry type {code}")

    read(0)
    kind = max(kinds, key=("point", "line", "polygon").index, default="polygon")
    return kind, [p for k, p in zip(kinds, parts, strict=True) if k == kind]


def to_wkb(geometry: Geometry) -> bytes:
    kind, parts = geometry
    code = {"point": 1, "line": 2, "polygon": 3}[kind]
    done = []
    for rings in parts:
        if kind == "point":
            body = rings[0].astype("<f8").tobytes()
        elif kind == "line":
            body = struct.pack("<I", len(rings[0])) + rings[0].astype("<f8").tobytes()
        else:
            body = struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + r.astype("<f8").tobytes() for r in rings)
        done.append(struct.pack("<BI", 1, code) + body)
    return done[0] if len(done) == 1 else struct.pack("<BII", 1, code + 3, len(done)) + b"".join(done)


def to_wkt(geometry: Geometry) -> str:
    kind, parts = geometry
    ring = lambda r: "(" + ", ".join(f"{x:.12g} {y:.12g}" for x, y in r) + ")"
    body = [ring(p[0]) if kind != "polygon" else "(" + ", ".join(map(ring, p)) + ")" for p in parts]
    name = {"point": "POINT", "line": "LINESTRING", "polygon": "POLYGON"}[kind]
    if not body:
        return f"{name} EMPTY"
    return f"{name} {body[0]}" if len(body) == 1 else f"MULTI{name} ({', '.join(body)})"


def point(lon: float, lat: float) -> Geometry:
    return "point", [[np.array([[lon, lat]], float)]]


def polygon(*rings) -> Geometry:
    """A polygon from its outer ring and holes; rings are closed if they aren't."""
    closed = []
    for r in rings:
        r = np.asarray(r, float)
        closed.append(r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]))
    return "polygon", [closed]


def box(minx: float, miny: float, maxx: float, maxy: float) -> Geometry:
    return polygon([(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)])


# --- Predicates ------------------------------------------------------------------------------


def bounds(geometry: Geometry) -> tuple[float, float, float, float]:
    xy = np.vstack([r for p in geometry[1] for r in p]) if geometry[1] else np.full((1, 2), np.nan)
    return (*xy.min(0).tolist(), *xy.max(0).tolist())


def _segments(geometry: Geometry) -> np.ndarray:
    """(n, 4) segments of lines or rings; a point is a segment of no length."""
    if geometry[0] == "point":
        return np.vstack([np.hstack([r, r]) for p in geometry[1] for r in p])
    return np.vstack([np.hstack([r[:-1], r[1:]]) for p in geometry[1] for r in p])


def _side(ax, ay, bx, by, px, py):
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _on(ax, ay, bx, by, px, py):
    inside = (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))
    return inside & (_side(ax, ay, bx, by, px, py) == 0)


def segments_meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of segments: whether they share a point, and whether they properly cross."""
    ax, ay, bx, by = (a[:, k, None] for k in range(4))
    cx, cy, dx, dy = (b[None, :, k] for k in range(4))
    s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    cross = (s1 * s2 < 0) & (s3 * s4 < 0)
    touch = _on(ax, ay, bx, by, cx, cy) | _on(ax, ay, bx, by, dx, dy) | _on(cx, cy, dx, dy, ax, ay) | _on(cx, cy, dx, dy, bx, by)
    return cross | touch, cross


def locate(xy: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Of points against one polygon: 1 inside, 0 on the boundary, -1 outside."""
    inside, edge = np.zeros(len(xy), bool), np.zeros(len(xy), bool)
    px, py = xy[:, 0, None], xy[:, 1, None]
    for r in rings:
        ax, ay, bx, by = r[None, :-1, 0], r[None, :-1, 1], r[None, 1:, 0], r[None, 1:, 1]
        edge |= _on(ax, ay, bx, by, px, py).any(1)
        spans = (ay > py) != (by > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (bx - ax) * (py - ay) / (by - ay) + ax
        inside ^= (spans & (px < x)).sum(1) % 2 == 1
    return np.where(edge, 0, np.where(inside, 1, -1))


def _place(xy: np.ndarray, geometry: Geometry) -> np.ndarray:
    return np.max([locate(xy, p) for p in geometry[1]], 0)


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether the two share any point, boundaries included."""
    if not a[1] or not b[1]:
        return False
    if segments_meet(_segments(a), _segments(b))[0].any():
        return True
    if b[0] == "polygon" and (_place(_segments(a)[:, :2], b) >= 0).any():
        return True
    return a[0] == "polygon" and bool((_place(_segments(b)[:, :2], a) >= 0).any())


def _midpoints(a: Geometry, b: Geometry) -> np.ndarray:
    """Points of a's boundary between all places where it meets b's."""
    out = []
    other = _segments(b)
    for x0, y0, x1, y1 in _segments(a):
        ts = [0.0, 1.0]
        d = np.array([x1 - x0, y1 - y0])
        n = float(d @ d)
        if n:
            e = other[:, 2:] - other[:, :2]
            den = d[0] * e[:, 1] - d[1] * e[:, 0]
            w = other[:, :2] - [x0, y0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den
            ts += t[np.isfinite(t) & (t > 0) & (t < 1)].tolist()
            for end in (other[:, :2], other[:, 2:]):
                u = (end - [x0, y0]) @ d / n
                ts += u[(u > 0) & (u < 1)].tolist()
        ts = np.unique(ts)
        mid = (ts[1:] + ts[:-1]) / 2 if n else np.zeros(1)
        out.append(np.array([x0, y0]) + mid[:, None] * d)
    return np.vstack(out)


def interiors_meet(a: Geometry, b: Geometry) -> bool:
    """Whether the interiors of two polygons share a point."""
    if segments_meet(_segments(a), _segments(b))[1].any():
        return True
    if (_place(_midpoints(a, b), b) > 0).any() or (_place(_midpoints(b, a), a) > 0).any():
        return True
    return any(_place(_inner_point(p)[None], b)[0] > 0 for p in a[1]) or any(_place(_inner_point(p)[None], a)[0] > 0 for p in b[1])


def _inner_point(rings: list[np.ndarray]) -> np.ndarray:
    """A point inside a polygon: the middle of the widest inner stretch of a line between two vertex heights."""
    ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
    if len(ys) < 2:
        return rings[0][0]
    k = int(np.argmax(np.diff(ys)))
    y = (ys[k] + ys[k + 1]) / 2
    xs = []
    for r in rings:
        a, b = r[:-1], r[1:]
        hit = (a[:, 1] > y) != (b[:, 1] > y)
        xs += (a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1])).tolist()
    xs = np.sort(xs)
    k = int(np.argmax(xs[1::2] - xs[::2]))
    return np.array([(xs[2 * k] + xs[2 * k + 1]) / 2, y])


def touches(a: Geometry, b: Geometry) -> bool:
    """Whether boundaries meet and interiors don't (polygons)."""
    return intersects(a, b) and not interiors_meet(a, b)


def within(a: Geometry, b: Geometry) -> bool:
    """Whether a lies in the polygon b, boundary contact allowed but not a point on it alone."""
    if a[0] == "point":
        return bool((_place(_segments(a)[:, :2], b) > 0).all())
    return not segments_meet(_segments(a), _segments(b))[1].any() and bool((_place(_midpoints(a, b), b) >= 0).all())


# --- Many pairs at once ----------------------------------------------------------------------

#: Pairs of corners or edges that are looked at together.
_TOGETHER = 500_000


def meetings(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of row k with each of the ``count[k]`` rows from ``first[k]`` on, ascending, some rows at a time so that memory is bounded."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + _TOGETHER, "right")))
        k = np.repeat(np.arange(at, stop), count[at:stop])
        yield k, np.arange(len(k)) - (ends[k] - count[k] - done) + first[k]
        at = stop


def single_rings(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shapes are polygons of one ring in little-endian WKB, and those rings' corners in one array and sizes, read together."""
    head = struct.pack("<BII", 1, 3, 1)
    plain = np.array([r is not None and len(r) > 13 and r[:9] == head for r in raws], bool)
    some = [r for r, one in zip(raws, plain.tolist(), strict=True) if one]
    return plain, np.frombuffer(b"".join(r[13:] for r in some), "<f8").reshape(-1, 2), np.array([(len(r) - 13) // 16 for r in some], int)


class Edges:
    """The edges of many shapes in one array, those of a shape and of its parts together."""

    def __init__(self, shapes: list[Geometry], digits: int | None = None, directed: bool = False):
        rings = [(k, n, h, r) for k, g in enumerate(shapes) for n, p in enumerate(g[1]) for h, r in enumerate(p)]
        size = np.array([len(r) for *_, r in rings], int)
        xy = np.concatenate([r for *_, r in rings]) if rings else np.zeros((0, 2))
        if digits is not None:
            xy = np.round(xy, digits)
        ring = np.repeat(np.arange(len(rings)), size)
        ends = np.cumsum(size)
        if directed:  # insides to the left
            off = xy - xy[(ends - size)[ring]]
            cross = off[:-1, 0] * off[1:, 1] - off[1:, 0] * off[:-1, 1]
            turn = np.bincount(ring[:-1], np.where(ring[:-1] == ring[1:], cross, 0), len(rings)) > 0 if len(xy) else np.zeros(0, bool)
            back = turn != np.array([h == 0 for _, _, h, _ in rings], bool)
            k = np.arange(len(xy))
            xy = xy[np.where(back[ring], (2 * ends - size)[ring] - 1 - k, k)]
        points = np.array([shapes[k][0] == "point" for k, *_ in rings], bool)
        a = np.flatnonzero(np.append(ring[1:] == ring[:-1], False) | points[ring]) if len(xy) else np.zeros(0, int)
        b = np.where(points[ring[a]], a, np.minimum(a + 1, len(xy) - 1))
        self.xy, ring = np.hstack([xy[a], xy[b]]), ring[a]
        if directed:
            long = (self.xy[:, :2] != self.xy[:, 2:]).any(1)
            self.xy, ring = self.xy[long], ring[long]
        self.owner = np.array([k for k, *_ in rings], int)[ring]
        self.part = np.array([n for _, n, *_ in rings], int)[ring]
        self.count = np.bincount(self.owner, minlength=len(shapes))
        self.first = np.cumsum(self.count) - self.count
        self.polygon = np.array([g[0] == "polygon" for g in shapes], bool)

    @classmethod
    def of_rings(cls, xy: np.ndarray, size: np.ndarray) -> Edges:
        """The edges of polygons of one closed ring each, from what ``single_rings`` reads."""
        self, ends = cls([]), np.cumsum(size)
        a = np.delete(np.arange(len(xy)), ends - 1)
        self.xy, self.owner, self.part = np.hstack([xy[a], xy[a + 1]]), np.repeat(np.arange(len(size)), size - 1), np.zeros(len(a), int)
        self.count, self.first, self.polygon = size - 1, ends - size - np.arange(len(size)), np.ones(len(size), bool)
        return self

    def locate(self, xy: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of points, each against the polygon with its number: 1 inside, 0 on the boundary, -1 outside."""
        out = np.full(len(xy), -1)
        for k, e in meetings(self.first[owner], self.count[owner]):
            if not len(k):
                continue
            (px, py), (ax, ay, bx, by) = xy[k].T, self.xy[e].T
            with np.errstate(divide="ignore", invalid="ignore"):
                x = (bx - ax) * (py - ay) / (by - ay) + ax
            hit = ((ay > py) != (by > py)) & (px < x)
            start = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (self.part[e[1:]] != self.part[e[:-1]])))
            odd = np.add.reduceat(hit.astype(int), start) % 2 == 1
            edge = np.logical_or.reduceat(_on(ax, ay, bx, by, px, py), start)
            np.maximum.at(out, k[start], np.where(edge, 0, np.where(odd, 1, -1)))
        return out


def intersects_all(a: list[Geometry], b: list[Geometry]) -> np.ndarray:
    """``intersects`` of many pairs."""
    ea, eb = Edges(a), Edges(b)
    out = np.zeros(len(a), bool)
    for k, e in meetings(eb.first[ea.owner], eb.count[ea.owner]):
        (ax, ay, bx, by), (cx, cy, dx, dy) = ea.xy[k].T, eb.xy[e].T
        near = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
        k, ax, ay, bx, by, cx, cy, dx, dy = (v[near] for v in (k, ax, ay, bx, by, cx, cy, dx, dy))
        s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
        s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
        touch = _on(ax, ay, bx, by, cx, cy) | _on(ax, ay, bx, by, dx, dy) | _on(cx, cy, dx, dy, ax, ay) | _on(cx, cy, dx, dy, bx, by)
        out[ea.owner[k[(s1 * s2 < 0) & (s3 * s4 < 0) | touch]]] = True
    for mine, other in ((ea, eb), (eb, ea)):
        left = ~out[mine.owner] & other.polygon[mine.owner]
        found = other.locate(mine.xy[left, :2], mine.owner[left]) >= 0
        out[mine.owner[left][found]] = True
    return out


# --- Construction ----------------------------------------------------------------------------


def clip_convex(geometry: Geometry, mask: np.ndarray) -> Geometry:
    """The part of a geometry inside a convex ring: half-plane by half-plane."""
    ring = np.asarray(mask, float)
    ring = ring[:-1] if (ring[0] == ring[-1]).all() else ring
    if ((ring * np.roll(ring, -1, 0)[:, ::-1]) @ [1, -1]).sum() < 0:
        ring = ring[::-1]
    kind, out = geometry[0], []
    for rings in geometry[1]:
        done = []
        for r in rings:
            pts = [tuple(p) for p in (r[:-1] if kind == "polygon" else r)]
            pieces = [pts]
            for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
                side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
                cut = []
                for piece in pieces:
                    now: list = []
                    steps = range(len(piece)) if kind == "polygon" else range(1, len(piece))
                    if kind != "polygon" and piece and side(piece[0]) >= 0:
                        now.append(piece[0])
                    for i in steps:
                        p, q = piece[i - 1], piece[i]
                        sp, sq = side(p), side(q)
                        if sp * sq < 0:
                            t = sp / (sp - sq)
                            now.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                            if kind == "line" and sq < 0:
                                cut.append(now)
                                now = []
                        if sq >= 0:
                            now.append(q)
                    if now:
                        cut.append(now)
                pieces = cut
            done += [np.array(p + p[:1] if kind == "polygon" else p) for p in pieces if len(p) >= {"point": 1, "line": 2, "polygon": 3}[kind]]
        if kind == "polygon":
            if done:
                out.append(done)
        else:
            out += [[d] for d in done]
    return kind, out


def area(geometry: Geometry) -> float:
    def ring(r):
        r = r - r[0]  # small shapes lie far from the origin
        return abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())) / 2

    return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in geometry[1]) if geometry[0] == "polygon" else 0.0


def centroid(geometry: Geometry) -> np.ndarray:
    if geometry[0] != "polygon":
        return np.vstack([r for p in geometry[1] for r in p]).mean(0)
    total, acc, zero = 0.0, np.zeros(2), geometry[1][0][0][0]
    for p in geometry[1]:
        for k, r in enumerate(p):
            r = r - zero
            c = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
            s = (1 if k == 0 else -1) * (1 if c.sum() >= 0 else -1)
            total += s * c.sum() / 2
            acc += s * np.array([((r[:-1, 0] + r[1:, 0]) * c).sum(), ((r[:-1, 1] + r[1:, 1]) * c).sum()]) / 6
    return zero + acc / total if total else geometry[1][0][0][:-1].mean(0)


def simplified(geometry: Geometry, tolerance: float) -> Geometry:
    """Fewer points, none farther than ``tolerance`` from the shape that stays (the split at the farthest point)."""

    def thin(r: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(r), bool)
        keep[[0, -1]] = True
        todo = [(0, len(r) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, p = r[b] - r[a], r[a + 1 : b] - r[a]
            n = float(d @ d)
            t = np.clip(p @ d / n, 0, 1) if n else np.zeros(len(p))
            off = np.hypot(*(p - t[:, None] * d).T)
            k = int(off.argmax())
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return r[keep]

    if geometry[0] == "point":
        return geometry
    least = 4 if geometry[0] == "polygon" else 2
    return geometry[0], [[r if len(s := thin(r)) < least else s for r in p] for p in geometry[1]]


def without_holes(geometry: Geometry) -> Geometry:
    return geometry[0], [p[:1] for p in geometry[1]] if geometry[0] == "polygon" else geometry[1]


def flatten(geometry: Geometry) -> list[Geometry]:
    """The single parts of a multipart geometry."""
    return [(geometry[0], [p]) for p in geometry[1]]


def merged(polygons: list[Geometry]) -> Geometry:
    """Disjoint polygons as one multipolygon."""
    return "polygon", [p for g in polygons for p in g[1]]


def convex_hull(xy: np.ndarray) -> np.ndarray:
    pts = sorted(map(tuple, xy.tolist()))
    if len(pts) < 3:
        return np.array(pts)

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def buffer_metres(geometry: Geometry, metres: float, arcs: int = 32) -> Geometry:
    """Everything within a distance, on an azimuthal equidistant plane about the centroid.

    The union of the shape with a capsule around each of its edges; round ends are drawn by ``arcs`` chords.
    """
    from geoloom.functions.overlay import union_all

    if not geometry[1]:
        return "polygon", []
    lon0, lat0 = np.radians(centroid(geometry))
    unit = 1e5  # metres; keeps the plane's numbers as small as degrees, for which the overlay rounds

    def flat(r: np.ndarray) -> np.ndarray:
        lon, lat = np.radians(r).T
        c = np.arccos(np.clip(np.sin(lat0) * np.sin(lat) + np.cos(lat0) * np.cos(lat) * np.cos(lon - lon0), -1, 1))
        k = np.where(c > 1e-12, c / np.maximum(np.sin(c), 1e-12), 1.0) * EARTH_RADIUS_M / unit
        return np.stack([k * np.cos(lat) * np.sin(lon - lon0), k * (np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lon - lon0))], 1)

    def back(r: np.ndarray) -> np.ndarray:
        r = r * unit
        rho = np.hypot(r[:, 0], r[:, 1])
        c, safe = rho / EARTH_RADIUS_M, np.maximum(rho, 1e-12)
        lat = np.arcsin(np.clip(np.cos(c) * np.sin(lat0) + r[:, 1] * np.sin(c) * np.cos(lat0) / safe, -1, 1))
        lon = lon0 + np.arctan2(r[:, 0] * np.sin(c), safe * np.cos(lat0) * np.cos(c) - r[:, 1] * np.sin(lat0) * np.sin(c))
        return np.degrees(np.stack([lon, lat], 1))

    plane = geometry[0], [[flat(r) for r in p] for p in geometry[1]]
    turn = 2 * math.pi * np.arange(arcs) / arcs
    circle = metres / unit * np.stack([np.cos(turn), np.sin(turn)], 1)
    shapes = [("polygon", [p]) for p in plane[1]] if geometry[0] == "polygon" else []
    for e in _segments(plane):
        shapes.append(polygon(convex_hull(np.round((e.reshape(2, 1, 2) + circle).reshape(-1, 2), 11))))
    kind, parts = union_all(shapes)
    return kind, [[back(r) for r in p] for p in parts]


# --- Arrow column functions ------------------------------------------------------------------


def _pairwise(name: str):
    rule = {"intersects": intersects, "touches": touches, "within": within}[name]

    @pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict[bytes, Geometry] = {}

        def get(raw):
            if raw is None:
                return None
            raw = bytes(raw)
            if raw not in cache:
                if len(cache) > 20_000:
                    cache.clear()
                cache[raw] = from_wkb(raw)
            return cache[raw]

        for a, b in batches:
            if name == "intersects":
                known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
                out = np.full(len(a), None, object)
                for k in range(0, len(known), 2_000):
                    some = known[k : k + 2_000]
                    out[some] = intersects_all([get(x) for x in a.iloc[some]], [get(x) for x in b.iloc[some]])
                yield pd.Series(out)
                continue
            yield pd.Series([None if x is None or y is None else rule(get(x), get(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    return run.asNondeterministic()  # dear: stays after a shuffle that deals its rows, and runs once


def st_intersects(a: Column, b: Column) -> Column:
    return _pairwise("intersects")(a, b)


def st_touches(a: Column, b: Column) -> Column:
    return _pairwise("touches")(a, b)


def st_within(a: Column, b: Column) -> Column:
    return _pairwise("within")(a, b)


def st_holds(polygon: Column, lon: Column, lat: Column) -> Column:
    """Whether the interior of a WKB polygon holds a point; a polygon is read once per batch and all its points are tested together."""

    @pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for g, x, y in batches:
            code, raws = pd.factorize(np.array([b"" if v is None else bytes(v) for v in g], object))
            plain, corners, size = single_rings(raws)
            xy, out = np.stack([x.to_numpy(float), y.to_numpy(float)], 1), np.zeros(len(code), bool)
            others = Edges([from_wkb(r) if r else ("polygon", []) for r, one in zip(raws, plain.tolist(), strict=True) if not one])
            for edges, rows in ((Edges.of_rings(corners, size), plain), (others, ~plain)):
                some = rows[code]
                out[some] = edges.locate(xy[some], (np.cumsum(rows) - 1)[code[some]]) > 0
            yield pd.Series(out)

    return run(polygon, lon, lat)


def st_bounds(wkb: Column) -> Column:
    """Struct of minx, miny, maxx, maxy."""

    @pandas_udf("minx double, miny double, maxx double, maxy double")
    def run(g: pd.Series) -> pd.DataFrame:
        raws = [None if x is None else bytes(x) for x in g]
        xy = _single_points(raws)
        if xy is not None:
            return pd.DataFrame(np.hstack([xy, xy]), columns=["minx", "miny", "maxx", "maxy"], dtype=float)
        plain, corners, size = single_rings(raws)
        rows = np.full((len(raws), 4), np.nan)
        if len(size):
            rows[plain] = np.hstack([f.reduceat(corners, np.cumsum(size) - size) for f in (np.minimum, np.maximum)])
        for k in np.flatnonzero(~plain):
            rows[k] = bounds(from_wkb(raws[k])) if raws[k] is not None else np.nan
        return pd.DataFrame(rows, columns=["minx", "miny", "maxx", "maxy"], dtype=float)

    return run(wkb)


def _unary(name: str, kind: str, *args):
    rules = {
        "wkt": lambda g: to_wkt(g),
        "without_holes": lambda g: to_wkb(without_holes(g)),
        "simplified": lambda g: to_wkb(simplified(g, *args)),
        "parts": lambda g: [to_wkb(x) for x in flatten(g)],
    }

    head = struct.pack("<BII", 1, 3, 1)

    def one(raw: bytes):
        return [raw] if name == "parts" and raw[:9] == head else rules[name](from_wkb(raw))

    @pandas_udf(kind)
    def run(g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else one(bytes(x)) for x in g], dtype=object)

    return run


def st_as_wkt(wkb: Column) -> Column:
    return _unary("wkt", "string")(wkb)


def st_area(wkb: Column) -> Column:
    @pandas_udf("double")
    def run(g: pd.Series) -> pd.Series:
        raws = [None if x is None else bytes(x) for x in g]
        plain, corners, size = single_rings(raws)
        out = np.full(len(raws), np.nan)
        if len(size):
            start = np.cumsum(size) - size
            off = corners - np.repeat(corners[start], size, 0)  # small shapes lie far from the origin
            cross = np.append(off[:-1, 0] * off[1:, 1] - off[1:, 0] * off[:-1, 1], 0.0)
            cross[np.cumsum(size) - 1] = 0.0
            out[plain] = np.abs(np.add.reduceat(cross, start)) / 2
        found = pd.Series(out, dtype=object)
        for k in np.flatnonzero(~plain):
            found[k] = None if raws[k] is None else area(from_wkb(raws[k]))
        return found

    return run(wkb)


def st_without_holes(wkb: Column) -> Column:
    return _unary("without_holes", "binary")(wkb)


def _single_points(raws: list) -> np.ndarray | None:
    """(n, 2) places if all shapes are single points in little-endian WKB; None otherwise."""
    if any(r is None or len(r) != 21 for r in raws):
        return None
    flat = np.frombuffer(b"".join(raws), [("head", "S5"), ("xy", "<f8", 2)])
    return flat["xy"] if (flat["head"] == b"\x01\x01").all() else None


def points_buffered(xy: np.ndarray, metres: float, arcs: int = 32) -> list[bytes]:
    """WKB of ``buffer_metres`` of single points, worked out together: one ring about the plane's centre, drawn back for each."""
    unit, turn = 1e5, 2 * math.pi * np.arange(arcs) / arcs
    ring = polygon(convex_hull(np.round(metres / unit * np.stack([np.cos(turn), np.sin(turn)], 1), 11)))[1][0][0] * unit
    lon0, lat0 = np.radians(xy).T[:, :, None]
    rho = np.hypot(ring[:, 0], ring[:, 1])
    c, safe = rho / EARTH_RADIUS_M, np.maximum(rho, 1e-12)
    lat = np.arcsin(np.clip(np.cos(c) * np.sin(lat0) + ring[:, 1] * np.sin(c) * np.cos(lat0) / safe, -1, 1))
    lon = lon0 + np.arctan2(ring[:, 0] * np.sin(c), safe * np.cos(lat0) * np.cos(c) - ring[:, 1] * np.sin(lat0) * np.sin(c))
    head = struct.pack("<BIII", 1, 3, 1, len(ring))
    return [head + r.tobytes() for r in np.degrees(np.stack([lon, lat], 2)).astype("<f8")]


def st_buffer_metres(wkb: Column, metres: float) -> Column:
    @pandas_udf("binary")
    def run(g: pd.Series) -> pd.Series:
        out: list = []
        for k in range(0, len(g), 1_000):  # some at a time
            raws = [None if x is None else bytes(x) for x in g.iloc[k : k + 1_000]]
            xy = _single_points(raws)
            out += points_buffered(xy, metres) if xy is not None else [None if x is None else to_wkb(buffer_metres(from_wkb(x), metres)) for x in raws]
        return pd.Series(out, dtype=object)

    return run(wkb)


def st_parts(wkb: Column) -> Column:
    """The single parts, for explode."""
    return _unary("parts", "array<binary>")(wkb)


def st_simplify(wkb: Column, tolerance: float) -> Column:
    return _unary("simplified", "binary", tolerance)(wkb)


def st_centroid(wkb: Column) -> Column:
    """Struct of lon and lat; null for an empty geometry."""

    @pandas_udf("lon double, lat double, found boolean")
    def run(g: pd.Series) -> pd.DataFrame:
        shapes = [None if x is None else from_wkb(bytes(x)) for x in g]
        rows = [(*centroid(s), True) if s is not None and s[1] else (None, None, None) for s in shapes]
        return pd.DataFrame(rows, columns=["lon", "lat", "found"])

    got = run(wkb)
    return F.when(got["found"], got)


def st_merged(parts: Column) -> Column:
    """An array of WKB shapes of one kind as one multipart shape."""

    @pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for raws in lists:
            shapes = [from_wkb(bytes(x)) for x in raws if x is not None]
            out.append(to_wkb((shapes[0][0], [p for s in shapes for p in s[1]])) if shapes else None)
        return pd.Series(out, dtype=object)

    return run(parts)


def st_clip_box(wkb: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The part of a geometry inside a box; null where nothing is left."""

    @pandas_udf("binary")
    def run(g: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        xy = _single_points([None if raw is None else bytes(raw) for raw in g])
        if xy is not None:  # inside or on the edge
            inside = (xy[:, 0] >= a.to_numpy(float)) & (xy[:, 0] <= c.to_numpy(float)) & (xy[:, 1] >= b.to_numpy(float)) & (xy[:, 1] <= d.to_numpy(float))
            return pd.Series([bytes(raw) if ok else None for raw, ok in zip(g, inside.tolist(), strict=True)], dtype=object)
        for raw, *e in zip(g, a, b, c, d, strict=True):
            cut = None if raw is None else clip_convex(from_wkb(bytes(raw)), box(*e)[1][0][0])
            out.append(to_wkb(cut) if cut and cut[1] else None)
        return pd.Series(out, dtype=object)

    return run(wkb, minx, miny, maxx, maxy)


def st_point(lon: Column, lat: Column) -> Column:
    """WKB of a point from coordinates, in Python for a batch at a time."""

    @pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(points_wkb(x.to_numpy(float), y.to_numpy(float)), dtype=object)

    return run(lon, lat)


def points_wkb(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    """WKB of points, written together."""
    head = struct.pack("<BI", 1, 1)
    return [head + r.tobytes() for r in np.stack([x, y], 1).astype("<f8")]


def boxes_wkb(minx: np.ndarray, miny: np.ndarray, maxx: np.ndarray, maxy: np.ndarray) -> list[bytes]:
    """WKB of boxes, written together; one without any extent is a point."""
    head = struct.pack("<BIII", 1, 3, 1, 5)
    corners = np.stack([minx, miny, maxx, miny, maxx, maxy, minx, maxy, minx, miny], 1).astype("<f8")
    spots = points_wkb(minx, miny)
    flat = ((minx == maxx) & (miny == maxy)).tolist()
    return [spot if one else head + r.tobytes() for r, spot, one in zip(corners, spots, flat, strict=True)]


def contains_point(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against an array of (x, y) structs, in the JVM."""
    n = F.size(ring)
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > lat) != (b["y"] > lat)
        return (spans & (lon < (b["x"] - a["x"]) * (lat - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"])).cast("int")

    return F.aggregate(pairs, F.lit(0), lambda acc, e: acc + F.coalesce(crosses(e), F.lit(0))) % 2 == 1
