"""Intersection, union and difference of polygons of any shape, with holes and several parts.

Edges of both are cut where they meet; a piece belongs to the result by where its middle lies with
respect to the other polygon; pieces are then linked to rings. Rings go counter-clockwise, holes
clockwise, so that the result's inside is always to the left of a piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from geoloom.functions.geometry import Edges, Geometry, from_wkb, locate, meetings, to_wkb

#: Digits to which cut points are rounded, so that pieces of both sides end in the same place.
DIGITS = 11


def _signed(r: np.ndarray) -> float:
    r = r - r[0]
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2


def _pieces(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges of a cut at all places where they meet edges of b."""
    out = []
    for x0, y0, x1, y1 in a:
        d, n = np.array([x1 - x0, y1 - y0]), float((x1 - x0) ** 2 + (y1 - y0) ** 2)
        near = (np.minimum(b[:, 0], b[:, 2]) <= max(x0, x1)) & (np.maximum(b[:, 0], b[:, 2]) >= min(x0, x1))
        near &= (np.minimum(b[:, 1], b[:, 3]) <= max(y0, y1)) & (np.maximum(b[:, 1], b[:, 3]) >= min(y0, y1))
        o = b[near]
        ts = [0.0, 1.0]
        if len(o):
            e, w = o[:, 2:] - o[:, :2], o[:, :2] - [x0, y0]
            den = d[0] * e[:, 1] - d[1] * e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den
                s = (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
            ok = np.isfinite(t) & np.isfinite(s) & (t > 0) & (t < 1) & (s >= -1e-12) & (s <= 1 + 1e-12)
            ts += t[ok].tolist()
            for end in (o[:, :2], o[:, 2:]):
                u = (end - [x0, y0]) @ d / n
                foot = np.array([x0, y0]) + u[:, None] * d
                on = (u > 0) & (u < 1) & (np.abs(foot - end).max(1) <= 10.0**-DIGITS)
                ts += u[on].tolist()
        ts = np.unique(ts)
        p = np.round(np.array([x0, y0]) + ts[:, None] * d, DIGITS)
        p[0], p[-1] = (x0, y0), (x1, y1)
        out.append(np.hstack([p[:-1], p[1:]]))
    got = np.vstack(out) if out else np.zeros((0, 4))
    return got[(got[:, :2] != got[:, 2:]).any(1)]


def _rings(pieces: list[tuple]) -> list[np.ndarray]:
    """Closed rings of directed pieces; where several go on, the sharpest left turn keeps parts apart."""
    after = defaultdict(list)
    for k, p in enumerate(pieces):
        after[p[:2]].append(k)
    used, out = set(), []
    for k in range(len(pieces)):
        if k in used:
            continue
        ring, at = [k], k
        used.add(k)
        while True:
            x0, y0, x1, y1 = pieces[at]
            if (x1, y1) == pieces[ring[0]][:2]:
                break
            ways = [n for n in after[x1, y1] if n not in used]
            if not ways:
                ring = []
                break
            back = np.arctan2(y0 - y1, x0 - x1)
            turn = lambda n: (back - np.arctan2(pieces[n][3] - y1, pieces[n][2] - x1)) % (2 * np.pi)  # noqa: B023, E731
            at = max(ways, key=turn) if len(ways) > 1 else ways[0]
            used.add(at)
            ring.append(at)
        if len(ring) > 2:
            r = np.array([pieces[n][:2] for n in ring] + [pieces[ring[0]][:2]])
            out.append(_straight(r))
    return [r for r in out if len(r) > 3]


def _straight(r: np.ndarray) -> np.ndarray:
    """A ring without corners that lie on a straight line."""
    p = r[:-1]
    a, b = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    cross = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    p = p[cross > 1e-12 * np.maximum(np.hypot(*a.T) * np.hypot(*b.T), 1e-300)]
    return np.vstack([p, p[:1]]) if len(p) else p


def _assembled(rings: list[np.ndarray]) -> Geometry:
    outer = sorted((r for r in rings if _signed(r) > 0), key=lambda r: abs(_signed(r)))
    parts = [[r] for r in outer]
    for hole in (r for r in rings if _signed(r) < 0):
        inner = (hole[0] + hole[1]) / 2
        for part in parts:
            if locate(inner[None], part[:1])[0] >= 0:
                part.append(hole)
                break
    return "polygon", parts[::-1]


def overlay(a: Geometry, b: Geometry, how: str) -> Geometry:
    """"intersection", "union" or "difference" of two polygons."""
    return overlays([a], [b], how)[0]


def overlays(a: list[Geometry], b: list[Geometry], how: str) -> list[Geometry]:
    """``overlay`` of many pairs: edges of all pairs are cut and placed together, only rings are linked pair by pair."""
    if how not in ("intersection", "union", "difference"):
        raise ValueError(f"unknown overlay {how}")
    ea, eb = (Edges(g, DIGITS, directed=True) for g in (a, b))
    (oa, pa), (ob, pb) = _cut(ea, eb), _cut(eb, ea)
    sa, sb = (set(zip(o.tolist(), map(tuple, p.tolist()), strict=True)) for o, p in ((oa, pa), (ob, pb)))
    rows: list[dict[tuple, None]] = [{} for _ in a]
    mine = {"intersection": (True, True, False), "union": (False, True, False), "difference": (False, False, True)}[how]
    for k, row in _kept(oa, pa, eb, sb, *mine):
        rows[k][row] = None
    for k, row in _kept(ob, pb, ea, sa, how != "union", False, False):
        rows[k][row if how != "difference" else row[2:] + row[:2]] = None
    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if ea.count[k] and eb.count[k]:
            out.append(_assembled(_rings(list(rows[k]))))
        else:
            out.append(("polygon", []) if how == "intersection" else x if ea.count[k] else y if how == "union" else ("polygon", []))
    return out


def _cut(a: Edges, b: Edges) -> tuple[np.ndarray, np.ndarray]:
    """The edges of each shape of a, cut at all places where they meet edges of b's shape of the same number: shapes' numbers and pieces."""
    xy = a.xy
    d = xy[:, 2:] - xy[:, :2]
    n = (d**2).sum(1)
    edges, places = [np.repeat(np.arange(len(xy)), 2)], [np.tile([0.0, 1.0], len(xy))]
    for k, e in meetings(b.first[a.owner], b.count[a.owner]):
        (x0, y0, x1, y1), (u0, v0, u1, v1) = xy[k].T, b.xy[e].T
        near = (np.minimum(u0, u1) <= np.maximum(x0, x1)) & (np.maximum(u0, u1) >= np.minimum(x0, x1)) & (np.minimum(v0, v1) <= np.maximum(y0, y1)) & (np.maximum(v0, v1) >= np.minimum(y0, y1))
        k, o = k[near], b.xy[e[near]]
        f, w = o[:, 2:] - o[:, :2], o[:, :2] - xy[k, :2]
        den = d[k, 0] * f[:, 1] - d[k, 1] * f[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * f[:, 1] - w[:, 1] * f[:, 0]) / den
            s = (w[:, 0] * d[k, 1] - w[:, 1] * d[k, 0]) / den
        ok = np.isfinite(t) & np.isfinite(s) & (t > 0) & (t < 1) & (s >= -1e-12) & (s <= 1 + 1e-12)
        edges.append(k[ok])
        places.append(t[ok])
        for end in (o[:, :2], o[:, 2:]):
            u = ((end - xy[k, :2]) * d[k]).sum(1) / n[k]
            foot = xy[k, :2] + u[:, None] * d[k]
            on = (u > 0) & (u < 1) & (np.abs(foot - end).max(1, initial=0) <= 10.0**-DIGITS)
            edges.append(k[on])
            places.append(u[on])
    k, t = np.concatenate(edges), np.concatenate(places)
    order = np.lexsort([t, k])
    k, t = k[order], t[order]
    p = np.round(xy[k, :2] + t[:, None] * d[k], DIGITS)
    p[t == 0], p[t == 1] = xy[k[t == 0], :2], xy[k[t == 1], 2:]
    pieces = np.hstack([p[:-1], p[1:]])
    real = (k[:-1] == k[1:]) & (pieces[:, :2] != pieces[:, 2:]).any(1)
    return a.owner[k[:-1][real]], pieces[real]


def _kept(owner: np.ndarray, pieces: np.ndarray, other: Edges, theirs: set, inside: bool, same: bool, opposite: bool) -> Iterator[tuple[int, tuple]]:
    """The pieces inside (or outside) the other polygon; shared ones by their direction."""
    place = other.locate((pieces[:, :2] + pieces[:, 2:]) / 2, owner)
    for k, row, at in zip(owner.tolist(), map(tuple, pieces.tolist()), place.tolist(), strict=True):
        if (k, row) in theirs:
            keep = same
        elif (k, row[2:] + row[:2]) in theirs:
            keep = opposite
        else:
            keep = (at > 0) == inside
        if keep:
            yield k, row


def union_all(shapes: list[Geometry]) -> Geometry:
    """The union of many polygons, pair by pair so that sizes stay even; the pairs of a round are worked out together."""
    shapes = [s for s in shapes if s[1]]
    while len(shapes) > 1:
        shapes = overlays(shapes[:-1:2], shapes[1::2], "union") + shapes[len(shapes) - len(shapes) % 2 :]
    return shapes[0] if shapes else ("polygon", [])


def clip_line(g: Geometry, mask: Geometry) -> Geometry:
    """The parts of lines or points inside a polygon, its boundary included."""
    if g[0] == "point":
        kept = [p for p in g[1] if max(locate(p[0], m)[0] for m in mask[1]) >= 0] if mask[1] else []
        return "point", kept
    edges = np.vstack([np.hstack([r[:-1], r[1:]]) for rings in mask[1] for r in rings])
    out = []
    for part in g[1]:
        pieces = _pieces(np.hstack([part[0][:-1], part[0][1:]]), edges)
        middle = (pieces[:, :2] + pieces[:, 2:]) / 2
        inside = np.max([locate(middle, p) for p in mask[1]], 0) >= 0
        run: list = []
        for row, ok in zip(pieces, inside, strict=True):
            if ok and run and (run[-1] == row[:2]).all():
                run.append(row[2:])
                continue
            if len(run) > 1:
                out.append([np.array(run)])
            run = [row[:2], row[2:]] if ok else []
        if len(run) > 1:
            out.append([np.array(run)])
    return "line", out


def clipped(g: Geometry, mask: Geometry) -> Geometry:
    """A geometry of any kind cut by a polygon."""
    return all_clipped([g], [mask])[0]


def all_clipped(shapes: list[Geometry], masks: list[Geometry]) -> list[Geometry]:
    """``clipped`` of many pairs; polygons are cut together."""
    areas = [k for k, g in enumerate(shapes) if g[0] == "polygon"]
    done = dict(zip(areas, overlays([shapes[k] for k in areas], [masks[k] for k in areas], "intersection"), strict=True))
    return [done[k] if k in done else clip_line(g, m) for k, (g, m) in enumerate(zip(shapes, masks, strict=True))]


# --- Columns ---------------------------------------------------------------------------------


def _two(rule):
    """A column function from a rule on many pairs of shapes."""

    @pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), None, object)
        known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
        for k in range(0, len(known), 2_000):  # some at a time
            some = known[k : k + 2_000]
            got = rule([from_wkb(bytes(x)) for x in a.iloc[some]], [from_wkb(bytes(y)) for y in b.iloc[some]])
            for at, g in zip(some.tolist(), got, strict=True):
                out[at] = to_wkb(g) if g[1] else None
        return pd.Series(out)

    return run.asNondeterministic()  # dear: a filter on the result doesn't run it again


def st_clip(geometry: Column, mask: Column) -> Column:
    """A geometry cut by a polygon; null where nothing is left."""
    return _two(all_clipped)(geometry, mask)


def st_overlay(a: Column, b: Column, how: str) -> Column:
    """Intersection, union or difference of polygons; null where nothing is left."""
    return _two(lambda x, y: overlays(x, y, how))(a, b)


def st_union_all(shapes: Column) -> Column:
    """The union of an array of polygons."""

    @pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        out = [union_all([from_wkb(bytes(x)) for x in raws if x is not None]) for raws in lists]
        return pd.Series([to_wkb(g) if g[1] else None for g in out], dtype=object)

    return run(shapes)
