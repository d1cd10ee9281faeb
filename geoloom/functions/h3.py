"""H3 cells in numpy: the hierarchical hexagon grid on an icosahedron, without its native package.

Only the faces' centres and axes and the base cells' numbers and places are fixed data. What else the system
needs (which face borders which, how their planes turn into each other, which base cell lies
where on every face and how its digits are turned there) follows from the geometry and is
worked out once per process. A cell is an unsigned 64-bit number held as a signed one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MAX_RES = 15
# Latitude, longitude and azimuth of the i axis (radians) of the faces 0 to 19.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# Home face and i, j, k of the base cells 0 to 121, as "face:ijk".
BASE_CELLS = """
1:100 2:110 1:000 2:100 0:200 1:110 1:001 2:000 0:100 2:010 1:010 1:011 3:100 3:110 11:200 4:100 0:000 6:010 0:001 2:011
7:001 2:001 0:110 6:001 10:200 6:000 3:000 11:100 4:110 3:010 0:011 4:000 5:010 0:010 7:010 11:110 7:000 10:100 12:200
6:101 7:101 4:001 3:001 3:011 4:010 6:100 11:000 8:001 5:001 14:200 5:000 12:100 10:110 4:011 12:110 7:100 11:010 10:000
13:200 10:001 11:001 9:010 8:010 6:200 8:000 9:001 14:100 5:101 16:011 8:101 5:100 12:000 7:200 12:010 10:010 9:000 13:100
16:001 15:011 15:010 16:010 14:110 13:110 5:200 8:100 14:000 9:101 14:001 17:001 12:001 16:000 17:011 15:001 16:101 9:100
15:000 13:000 8:200 13:010 17:101 19:010 14:010 19:011 17:010 13:001 17:000 16:100 9:200 15:101 15:100 18:011 18:001 19:001
17:100 19:000 18:010 18:101 19:200 19:100 18:000 19:101 18:100
"""
UNIT = 0.38196601125010500003  # a step of resolution 0 on a face's plane
TURN = math.asin(math.sqrt(3 / 28))  # between two resolutions
ROOT7 = math.sqrt(7)
_SIN60 = math.sqrt(3) / 2
#: Steps of the digits 0 to 6 (none, K, J, JK, I, IK, IJ) as (i - k, j - k).
_STEP = np.array([(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)])
#: Digits by direction: 0, 60, ... 300 degrees.
_RING = (4, 6, 2, 3, 1, 5)
_CCW = np.array([0, 5, 3, 1, 6, 4, 2, 7])
_DIGIT = np.full((3, 3), 7)
for _d, (_a, _b) in enumerate(_STEP.tolist()):
    _DIGIT[_a + 1, _b + 1] = _d


def _unit(lat, lon) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


def _xy(axial: np.ndarray) -> np.ndarray:
    """Plane position, in steps, of (i - k, j - k)."""
    return np.stack([axial[..., 0] - axial[..., 1] / 2, axial[..., 1] * _SIN60], -1)


def _axial(xy: np.ndarray) -> np.ndarray:
    """The lattice point nearest to a plane position."""
    b = xy[..., 1] / _SIN60
    a = xy[..., 0] + b / 2
    u, v = a - b, b
    w = -u - v
    ru, rv, rw = np.rint(u), np.rint(v), np.rint(w)
    du, dv, dw = np.abs(ru - u), np.abs(rv - v), np.abs(rw - w)
    ru = np.where((du > dv) & (du > dw), -rv - rw, ru)
    rv = np.where((dv >= du) & (dv > dw), -ru - rw, rv)
    return np.stack([ru + rv, rv], -1).astype(np.int64)


def _spin(xy: np.ndarray, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return np.stack([c * xy[..., 0] - s * xy[..., 1], s * xy[..., 0] + c * xy[..., 1]], -1)


class _Geometry:
    """What follows from the faces and base cells."""

    def __init__(self):
        f = np.array(FACES)
        lat, lon, az = f.T
        self.centre = _unit(lat, lon)
        north = np.stack([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)], -1)
        east = np.stack([-np.sin(lon), np.cos(lon), np.zeros(20)], -1)
        self.x = np.cos(az)[:, None] * north + np.sin(az)[:, None] * east
        self.y = np.sin(az)[:, None] * north - np.cos(az)[:, None] * east
        #: Corners of a face in its plane, in steps of resolution 0.
        self.corner = 2 * np.array([(math.cos(t), math.sin(t)) for t in (0, 2 * math.pi / 3, 4 * math.pi / 3)])
        spots = np.stack([self.sphere(np.full(3, k), self.corner) for k in range(20)])
        points: list[np.ndarray] = []
        self.vertex = np.zeros((20, 3), int)
        for k in range(20):
            for c in range(3):
                at = next((n for n, p in enumerate(points) if p @ spots[k, c] > 0.999), len(points))
                if at == len(points):
                    points.append(spots[k, c])
                self.vertex[k, c] = at
        # Edge c of a face lies opposite to corner c; across it lies a face, by a turn and a shift.
        self.across = np.zeros((20, 3), int)
        self.turns = np.zeros((20, 3), int)
        self.shift = np.zeros((20, 3, 2))
        for k in range(20):
            for c in range(3):
                a, b = (c + 1) % 3, (c + 2) % 3
                pair = {self.vertex[k, a], self.vertex[k, b]}
                g = next(g for g in range(20) if g != k and pair <= set(self.vertex[g].tolist()))
                to = [self.corner[self.vertex[g].tolist().index(self.vertex[k, e])] for e in (a, b)]
                old, new = self.corner[b] - self.corner[a], to[1] - to[0]
                angle = math.atan2(new[1], new[0]) - math.atan2(old[1], old[0])
                n = round(angle / (math.pi / 3))
                self.across[k, c], self.turns[k, c] = g, n % 6
                self.shift[k, c] = to[0] - _spin(self.corner[a], n * math.pi / 3)
        cells = [x.split(":") for x in BASE_CELLS.split()]
        self.home = np.array([int(a) for a, _ in cells])
        ijk = np.array([[int(d) for d in b] for _, b in cells])
        self.home_axial = ijk[:, :2] - ijk[:, 2:]
        spot = self.sphere(self.home, _xy(self.home_axial))
        self.pentagon = np.array([b == "200" for _, b in cells])
        # Per face and (i - k, j - k): base cell and how often its digits turn by 60 degrees.
        self.base, self.rots = np.full((20, 5, 5), -1), np.zeros((20, 5, 5), int)
        #: Pentagon and face: whether the face meets it with its j corner; the canonical digit of the face's sector.
        self.cw: set[tuple[int, int]] = set()
        self.sector: dict[tuple[int, int], tuple[int, int]] = {}
        for n in np.flatnonzero(self.pentagon).tolist():
            self._around(n)
        for k in range(20):
            for i in range(3):
                for j in range(3):
                    for m in range(3):
                        if min(i, j, m):
                            continue
                        a, b = i - m, j - m
                        p = _xy(np.array([a, b]))
                        face, q, turned = self.settle(k, p)
                        cell = int((spot @ self.sphere(np.array([face]), q[None])[0]).argmax())
                        if self.pentagon[cell]:
                            rots = self.sector[cell, k][1] if (cell, k) in self.sector else 0
                        else:
                            rots = turned + self._to_home(face, q, cell)
                        self.base[k, a + 2, b + 2], self.rots[k, a + 2, b + 2] = cell, rots % 6

    def sphere(self, face: np.ndarray, xy: np.ndarray) -> np.ndarray:
        p = self.centre[face] + UNIT * (xy[..., :1] * self.x[face] + xy[..., 1:] * self.y[face])
        return p / np.linalg.norm(p, axis=-1, keepdims=True)

    def settle(self, face: int, xy: np.ndarray) -> tuple[int, np.ndarray, int]:
        """A plane position beyond its face as one on the face it lies on, and the turns on the way."""
        turned = 0
        for _ in range(6):
            over = -(xy @ self.corner.T) / 2  # how far out beyond edge c; the edge lies at 1
            c = int(over.argmax())
            if over[c] <= 1 + 1e-9:
                break
            n = self.turns[face, c]
            xy, turned, face = _spin(xy, n * math.pi / 3) + self.shift[face, c], turned + n, int(self.across[face, c])
        return face, xy, turned

    def _to_home(self, face: int, xy: np.ndarray, cell: int) -> int:
        """Turns from a face to a base cell's home face, of which it is the same or, where the cell lies on an edge, the next."""
        if face == self.home[cell]:
            return 0
        c = next(c for c in range(3) if self.across[face, c] == self.home[cell] and abs(-(xy @ self.corner[c]) / 2 - 1) < 1e-6)
        return int(self.turns[face, c])

    def _around(self, cell: int) -> None:
        """The five faces at a pentagon, counter-clockwise from its home face, and their canonical digits.

        The home face meets it with its i corner, in the sector of digit JK; digit K is the one that is missing.
        """
        at = self.vertex[self.home[cell], 0]
        face, canonical = int(self.home[cell]), 3
        for _ in range(5):
            own = self.vertex[face].tolist().index(at)
            local = (3, 5, 6)[own]
            rots, d = 0, local
            while d != canonical:
                d = int(_CCW[d])
                d = int(_CCW[d]) if d == 1 else d
                rots += 1
            self.sector[cell, face] = (canonical, rots)
            if own == 1:
                self.cw.add((cell, face))
            # Counter-clockwise about corner ``own`` lies the edge from it to the corner before.
            nxt = int(self.across[face, (own + 1) % 3])
            face, canonical = nxt, int(_CCW[canonical])
            canonical = int(_CCW[canonical]) if canonical == 1 else canonical


@functools.cache
def _geometry() -> _Geometry:
    return _Geometry()


def check_res(res: int) -> int:
    if not 0 <= res <= MAX_RES:
        raise ValueError(f"resolution must be from 0 to {MAX_RES}, not {res}")
    return res


# --- Bits ------------------------------------------------------------------------------------


def _assemble(base: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Cells from base cells and digits (n, res)."""
    res = digits.shape[1]
    h = np.full(len(base), 1 << 59 | res << 52, np.int64) | base.astype(np.int64) << 45
    for r in range(1, 16):
        h |= (digits[:, r - 1].astype(np.int64) if r <= res else np.int64(7)) << np.int64(3 * (15 - r))
    return h


def resolution(cells: np.ndarray) -> np.ndarray:
    return np.asarray(cells, np.int64) >> 52 & 15


def base_cell(cells: np.ndarray) -> np.ndarray:
    return np.asarray(cells, np.int64) >> 45 & 127


def digits_of(cells: np.ndarray, res: int) -> np.ndarray:
    cells = np.asarray(cells, np.int64)
    return np.stack([cells >> 3 * (15 - r) & 7 for r in range(1, res + 1)], 1) if res else np.zeros((len(cells), 0), np.int64)


def to_text(cell: int) -> str:
    return format(int(cell), "x")


def from_text(text: str) -> int:
    return int(text, 16)


def is_pentagon(cells: np.ndarray) -> np.ndarray:
    cells = np.asarray(cells, np.int64)
    out = _geometry().pentagon[base_cell(cells)]
    for r in range(1, 16):
        out = out & ((cells >> 3 * (15 - r) & 7 == 0) | (resolution(cells) < r))
    return out


def _leading(digits: np.ndarray) -> np.ndarray:
    """First digit that isn't 0, or 0."""
    if not digits.shape[1]:
        return np.zeros(len(digits), np.int64)
    at = (digits != 0).argmax(1)
    return digits[np.arange(len(digits)), at]


def parent(cells: np.ndarray, res: int) -> np.ndarray:
    cells = np.asarray(cells, np.int64)
    low = (1 << 3 * (15 - res)) - 1
    return cells & ~np.int64(15 << 52) & ~np.int64(low) | np.int64(res << 52 | low)


def children(cells: np.ndarray) -> np.ndarray:
    """The cells of the next resolution below: seven, six below a pentagon."""
    cells = np.asarray(cells, np.int64)
    res = int(resolution(cells[:1])[0]) + 1 if len(cells) else 1
    place = np.int64(3 * (15 - res))
    stem = (cells & ~np.int64(15 << 52) | np.int64(res << 52)) & ~(np.int64(7) << place)
    out = stem[:, None] | np.arange(7, dtype=np.int64) << place
    keep = ~(is_pentagon(cells)[:, None] & (np.arange(7) == 1))
    return out[keep]


# --- Places to cells and back ----------------------------------------------------------------


def cells_of(lon: np.ndarray, lat: np.ndarray, res: int) -> np.ndarray:
    """The cell of each place (degrees)."""
    return _cells_at(_unit(np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))), check_res(res))


def _cells_at(p: np.ndarray, res: int) -> np.ndarray:
    g = _geometry()
    face = (p @ g.centre.T).argmax(1)
    out = (p * g.centre[face]).sum(1)
    xy = np.stack([(p * g.x[face]).sum(1), (p * g.y[face]).sum(1)], 1) / (out * UNIT)[:, None]
    if res % 2:
        xy = _spin(xy, -TURN)
    return _number(face, _axial(xy * ROOT7**res), res)


def _number(face: np.ndarray, axial: np.ndarray, res: int) -> np.ndarray:
    """Cells from lattice points of faces' planes."""
    g = _geometry()
    a, b = axial[:, 0].copy(), axial[:, 1].copy()
    digits = np.zeros((len(a), res), np.int64)
    for r in range(res, 0, -1):
        if r % 2:
            ua, ub = np.rint((3 * a - b) / 7).astype(np.int64), np.rint((a + 2 * b) / 7).astype(np.int64)
            ca, cb = 2 * ua + ub, 3 * ub - ua
        else:
            ua, ub = np.rint((2 * a + b) / 7).astype(np.int64), np.rint((3 * b - a) / 7).astype(np.int64)
            ca, cb = 3 * ua - ub, ua + 2 * ub
        digits[:, r - 1] = _DIGIT[a - ca + 1, b - cb + 1]
        a, b = ua, ub
    base, rots = g.base[face, a + 2, b + 2], g.rots[face, a + 2, b + 2].copy()
    five = g.pentagon[base]
    if five.any() and res:
        for n in np.flatnonzero(five).tolist():
            d = digits[n : n + 1]
            if _leading(d)[0] == 1:
                d[:] = _turned(d, -1 if (int(base[n]), int(face[n])) in g.cw else 1)
            for _ in range(int(rots[n])):
                d[:] = _CCW[d]
                if _leading(d)[0] == 1:
                    d[:] = _CCW[d]
            rots[n] = 0
    for _ in range(5):
        more = rots > 0
        if not more.any():
            break
        digits[more] = _CCW[digits[more]]
        rots[more] -= 1
    return _assemble(base, digits)


def _turned(digits: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times % 6):
        digits = _CCW[digits]
    return digits


def _positions(cells: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """A face and a lattice point of its plane for each cell; the point may lie beyond the face."""
    g = _geometry()
    base, digits = base_cell(cells), digits_of(cells, res)
    face, start = g.home[base].copy(), g.home_axial[base].copy()
    five = np.flatnonzero(g.pentagon[base])
    if len(five):
        lead = _leading(digits)
        sides = {(cell, canonical): (f, rots) for (cell, f), (canonical, rots) in g.sector.items()}
        for n in five.tolist():
            if lead[n] == 0:
                continue
            f, _ = sides[int(base[n]), int(lead[n])]
            corner = int(g.vertex[f].tolist().index(g.vertex[g.home[base[n]], 0]))
            local = (3, 5, 6)[corner]
            turns = (_RING.index(local) - _RING.index(int(lead[n]))) % 6
            digits[n] = _turned(digits[n], turns)
            face[n], start[n] = f, ((2, 0), (0, 2), (-2, -2))[corner]
    a, b = start[:, 0], start[:, 1]
    for r in range(1, res + 1):
        a, b = (2 * a + b, 3 * b - a) if r % 2 else (3 * a - b, a + 2 * b)
        step = _STEP[digits[:, r - 1]]
        a, b = a + step[:, 0], b + step[:, 1]
    return face, np.stack([a, b], 1)


def _plane(axial_xy: np.ndarray, res: int) -> np.ndarray:
    """Steps of a resolution as steps of resolution 0 in the face's own axes."""
    xy = axial_xy / ROOT7**res
    return _spin(xy, TURN) if res % 2 else xy


def _settled(face: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = _geometry()
    face, xy = face.copy(), xy.copy()
    for _ in range(6):
        over = -(xy @ g.corner.T) / 2
        c = over.argmax(1)
        out = np.flatnonzero(over[np.arange(len(c)), c] > 1 + 1e-9)
        if not len(out):
            break
        n, f, e = g.turns[face[out], c[out]] * (math.pi / 3), face[out], c[out]
        x, y = xy[out, 0], xy[out, 1]
        xy[out] = np.stack([np.cos(n) * x - np.sin(n) * y, np.sin(n) * x + np.cos(n) * y], 1) + g.shift[f, e]
        face[out] = g.across[f, e]
    return face, xy


def _degrees(p: np.ndarray) -> np.ndarray:
    return np.degrees(np.stack([np.arctan2(p[..., 1], p[..., 0]), np.arcsin(np.clip(p[..., 2], -1, 1))], -1))


def _one_res(cells: np.ndarray) -> int:
    res = np.unique(resolution(cells))
    if len(res) != 1:
        raise ValueError("cells of one resolution are needed")
    return int(res[0])


def centres(cells: np.ndarray) -> np.ndarray:
    """(lon, lat) in degrees of each cell's centre."""
    cells = np.asarray(cells, np.int64)
    if not len(cells):
        return np.zeros((0, 2))
    res = _one_res(cells)
    face, axial = _positions(cells, res)
    return _degrees(_geometry().sphere(*_settled(face, _plane(_xy(axial), res))))


def _walk(face: int, p: np.ndarray, q: np.ndarray) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Follows the straight way from p on a face to q over edges: q's face and place there, and where edges were crossed."""
    g, crossed = _geometry(), []
    for _ in range(6):
        op, oq = -(p @ g.corner.T) / 2, -(q @ g.corner.T) / 2
        out = np.flatnonzero(oq > 1 + 1e-9)
        if not len(out):
            break
        t = [(1 - op[c]) / (oq[c] - op[c]) if oq[c] > op[c] + 1e-15 else 2.0 for c in out]
        c = int(out[int(np.argmin(t))])
        cut = p + min(max(min(t), 0.0), 1.0) * (q - p)
        crossed.append(g.sphere(np.array([face]), cut[None])[0])
        n = g.turns[face, c] * math.pi / 3
        p, q, face = _spin(cut, n) + g.shift[face, c], _spin(q, n) + g.shift[face, c], int(g.across[face, c])
    return face, q, crossed


def _spokes(cell: int, radius: float, angles: np.ndarray) -> list[tuple[int, np.ndarray, int, np.ndarray]]:
    """(face, centre, face, place) of the directions ``angles`` (radians in the cell's own steps) that a cell has.

    A pentagon takes, on each of its five faces, the directions within that face's sector.
    """
    g = _geometry()
    res = int(resolution(np.array([cell]))[0])
    out = []
    if is_pentagon(np.array([cell]))[0]:
        base = int(base_cell(np.array([cell]))[0])
        ring = [(f, c) for (b, f), (c, _) in g.sector.items() if b == base]
        for f, _ in ring:
            own = int(g.vertex[f].tolist().index(g.vertex[g.home[base], 0]))
            middle = math.pi + own * 2 * math.pi / 3
            for t in angles.tolist():
                turn = t + (TURN if res % 2 else 0)
                off = (turn - middle + math.pi) % (2 * math.pi) - math.pi
                if -math.pi / 6 - 1e-9 <= off < math.pi / 6 - 1e-9:
                    way = radius / ROOT7**res * np.array([math.cos(turn), math.sin(turn)])
                    out.append((f, g.corner[own], f, g.corner[own] + way))
        return out
    face, axial = _positions(np.array([cell]), res)
    face, p = _settled(face, _plane(_xy(axial), res))
    # Directions are told in the frame in which the digits are; on the settled face any frame will do.
    for t in angles.tolist():
        turn = t + (TURN if res % 2 else 0)
        q = p[0] + radius / ROOT7**res * np.array([math.cos(turn), math.sin(turn)])
        out.append((int(face[0]), p[0], int(face[0]), q))
    return out


def boundary(cell: int) -> np.ndarray:
    """(n, 2) corners (lon, lat), counter-clockwise; where an edge crosses an edge of the icosahedron it has a corner more."""
    g = _geometry()
    out: list[np.ndarray] = []
    spokes = _spokes(cell, 1 / math.sqrt(3), np.arange(6) * math.pi / 3 + math.pi / 6)
    if is_pentagon(np.array([cell]))[0]:
        spots = np.array([g.sphere(np.array([f]), q[None])[0] for _, _, f, q in spokes])
        if int(resolution(np.array([cell]))[0]) % 2:
            middle = spots.mean(0) / np.linalg.norm(spots.mean(0))
            edges = []
            for f, p, _, q in spokes:
                own = int(np.abs(g.corner - p).sum(1).argmin())
                for side in (1, -1):
                    way = g.corner[(own - side) % 3] - p
                    nxt = _spin(q - p, side * math.pi / 3)
                    d = (q - p) + ((nxt - (q - p)) * 0.5)
                    t = float(np.linalg.norm(d)) / math.cos(_between(d, way)) / np.linalg.norm(way)
                    edges.append(g.sphere(np.array([f]), (p + t * way)[None])[0])
            spots = np.array([*spots, *edges])
            keep = [k for k in range(len(spots)) if all(np.linalg.norm(spots[k] - spots[m]) > 1e-9 for m in range(k))]
            spots = _ordered(spots[keep], middle)
        else:
            spots = _ordered(spots, spots.mean(0) / np.linalg.norm(spots.mean(0)))
        return _degrees(spots)
    for k, (face, p, _, q) in enumerate(spokes):
        _, _, _, after = spokes[(k + 1) % len(spokes)]
        f1, q1, _ = _walk(face, p, q)
        out.append(g.sphere(np.array([f1]), q1[None])[0])
        for cut in _cuts(face, q, after):
            if np.linalg.norm(cut - out[-1]) > 1e-9:
                out.append(cut)
    spots = np.array(out)
    nxt = np.roll(spots, -1, 0)
    return _degrees(spots[np.linalg.norm(spots - nxt, axis=1) > 1e-12])


def _between(a: np.ndarray, b: np.ndarray) -> float:
    return math.acos(max(-1.0, min(1.0, float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))))


def _cuts(face: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Where the plane segment a b, drawn beyond a face, crosses the face's edges."""
    g = _geometry()
    oa, ob = -(a @ g.corner.T) / 2 - 1, -(b @ g.corner.T) / 2 - 1
    ts = sorted(float(oa[c] / (oa[c] - ob[c])) for c in range(3) if (oa[c] > 1e-9) != (ob[c] > 1e-9) and min(abs(oa[c]), abs(ob[c])) > 1e-9)
    out = []
    for t in ts:
        p = a + t * (b - a)
        if (-(p @ g.corner.T) / 2 <= 1 + 1e-9).all():
            out.append(g.sphere(np.array([face]), p[None])[0])
    return out


def _ordered(spots: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise about a middle."""
    east = np.cross([0.0, 0.0, 1.0], middle)
    east /= np.linalg.norm(east)
    north = np.cross(middle, east)
    return spots[np.argsort(np.arctan2(spots @ north, spots @ east))]


def neighbours(cells: np.ndarray) -> np.ndarray:
    """(m, 2) pairs of each cell's row and a cell that shares an edge with it: six, five of a pentagon."""
    cells = np.asarray(cells, np.int64)
    if not len(cells):
        return np.zeros((0, 2), np.int64)
    g, res = _geometry(), _one_res(cells)
    five = is_pentagon(cells)
    pairs = []
    plain = np.flatnonzero(~five)
    if len(plain):
        face, axial = _positions(cells[plain], res)
        face, p = _settled(face, _plane(_xy(axial), res))
        for t in range(6):
            turn = t * math.pi / 3 + (TURN if res % 2 else 0)
            q = p + np.array([math.cos(turn), math.sin(turn)]) / ROOT7**res
            f2, q2 = face.copy(), q.copy()
            away = np.flatnonzero((-(q @ g.corner.T) / 2 > 1 + 1e-9).any(1))
            for n in away.tolist():
                f2[n], q2[n], _ = _walk(int(face[n]), p[n], q[n])
            pairs.append(np.stack([plain, _cells_at(g.sphere(f2, q2), res)], 1))
    for n in np.flatnonzero(five).tolist():
        for f, _, _, q in _spokes(int(cells[n]), 1.0, np.arange(6) * math.pi / 3):
            pairs.append(np.array([[n, _cells_at(g.sphere(np.array([f]), q[None]), res)[0]]]))
    return np.concatenate(pairs)


def disks(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, distance) of all cells within k steps of each cell, itself included."""
    cells = np.asarray(cells, np.int64)
    row, cell = np.arange(len(cells)), cells
    rows, out, far = [row], [cell], [np.zeros(len(cells), np.int64)]
    before = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for d in range(1, k + 1):
        if not len(cell):
            break
        distinct, back = np.unique(cell, return_inverse=True)
        near = neighbours(distinct)
        near = near[np.argsort(near[:, 0], kind="stable")]
        starts = np.searchsorted(near[:, 0], np.arange(len(distinct) + 1))
        n = starts[back + 1] - starts[back]
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[back], n)
        pair = np.stack([np.repeat(row, n), near[pick, 1]], 1)
        seen = np.concatenate([np.stack([row, cell], 1), np.stack(before, 1)])
        pair = np.unique(pair, axis=0)
        both = np.concatenate([seen, pair])
        _, first = np.unique(both, axis=0, return_index=True)
        new = both[np.sort(first[first >= len(seen)])]
        before = (row, cell)
        row, cell = new[:, 0], new[:, 1]
        rows.append(row)
        out.append(cell)
        far.append(np.full(len(row), d, np.int64))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(far)


def local_ij(origin: int, cells: np.ndarray) -> np.ndarray:
    """(n, 2) coordinates i, j of the origin less those of cells, in the frame of the origin's base cell.

    Pairs that lie on faces which don't border, or that a pentagon comes between, are a ValueError.
    """
    cells = np.asarray(cells, np.int64)
    g, res = _geometry(), int(resolution(np.array([origin]))[0])
    if len(cells) and _one_res(cells) != res:
        raise ValueError("cells of the origin's resolution are needed")
    own = int(base_cell(np.array([origin]))[0])
    home = int(g.home[own])
    everyone = np.concatenate([[np.int64(origin)], cells])
    out = np.zeros((len(everyone), 2), np.int64)
    face, axial = _positions(everyone, res)
    for n, cell in enumerate(everyone.tolist()):
        base = int(base_cell(np.array([cell]))[0])
        if cell != origin and (g.pentagon[base] or g.pentagon[own]) and not (base == own and _same_sector(origin, cell, res)):
            raise ValueError("a pentagon lies between the cells")
        xy, f = _plane(_xy(axial[n]), res), int(face[n])
        if f != (home if not g.pentagon[own] else int(face[0])):
            target = home if not g.pentagon[own] else int(face[0])
            f, xy, _ = g.settle(f, xy)
            if f != target:
                edges = [c for c in range(3) if g.across[f, c] == target]
                if not edges:
                    raise ValueError("the cells lie on faces that don't border")
                xy = _spin(xy, g.turns[f, edges[0]] * math.pi / 3) + g.shift[f, edges[0]]
        flat = xy * ROOT7**res
        out[n] = _axial(_spin(flat, -TURN) if res % 2 else flat)
    return out[0] - out[1:]


def _same_sector(a: int, b: int, res: int) -> bool:
    la, lb = _leading(digits_of(np.array([a, b]), res)).tolist()
    return la == lb or 0 in (la, lb)


def path(start: int, end: int) -> np.ndarray:
    """Cells of a straight way between two cells, both included; each borders the next."""
    return paths(np.array([start], np.int64), np.array([end], np.int64))[0]


def _in_frame(target: np.ndarray, face: np.ndarray, axial: np.ndarray, res: int) -> np.ndarray:
    """Lattice points of cells in the frames of target faces; ValueError where the faces don't border."""
    g = _geometry()
    xy, face = _plane(_xy(axial), res), face.copy()
    off = np.flatnonzero(face != target)
    if len(off):
        face[off], xy[off] = _settled(face[off], xy[off])
        off = off[face[off] != target[off]]
    for n in off.tolist():
        edges = [c for c in range(3) if g.across[face[n], c] == target[n]]
        if not edges:
            raise ValueError("the cells lie on faces that don't border")
        xy[n] = _spin(xy[n], g.turns[face[n], edges[0]] * math.pi / 3) + g.shift[face[n], edges[0]]
    flat = xy * ROOT7**res
    return _axial(_spin(flat, -TURN) if res % 2 else flat)


def paths(starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The ``path`` of each pair of cells (of one resolution), worked out together."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    if not len(starts):
        return []
    g, res = _geometry(), int(resolution(starts[:1])[0])
    if _one_res(np.concatenate([starts, ends])) != res:
        raise ValueError("cells of the origin's resolution are needed")
    own, other = base_cell(starts), base_cell(ends)
    five = g.pentagon[own] | g.pentagon[other]
    for n in np.flatnonzero(five & (starts != ends)).tolist():
        if g.pentagon[own[n]] or own[n] != other[n]:
            raise ValueError("a pentagon lies between the cells")
    (face, axial), (to_face, to_axial) = _positions(starts, res), _positions(ends, res)
    target = np.where(g.pentagon[own], face, g.home[own])
    way = _in_frame(target, to_face, to_axial, res) - _in_frame(target, face, axial, res)
    n = np.maximum(np.abs(way).max(1), np.abs(way[:, 0] - way[:, 1]))
    stops = np.cumsum(n + 1)
    row = np.repeat(np.arange(len(n)), n + 1)
    step = np.arange(stops[-1]) - np.repeat(stops - n - 1, n + 1)
    at = _axial(_xy(axial[row].astype(float) + step[:, None] * way[row] / np.maximum(n, 1)[row, None] + np.array([1e-7, 2e-7])))
    where = _settled(face[row], _plane(_xy(at), res))
    return np.split(_cells_at(g.sphere(*where), res), stops[:-1])


def cover(polygon, res: int, buffer: bool = True) -> Iterator[int]:
    """Cells of a WKB-like polygon: those that meet it, or with ``buffer`` off those whose centre it holds.

    From the base cells down, a cell stays as long as a disc that holds all cells below it may meet
    the polygon; so the work follows the size of the answer.
    """
    from geoloom.functions import geometry as G

    x0, y0, x1, y1 = G.bounds(polygon)
    cells = _assemble(np.arange(122), np.zeros((122, 0), np.int64))
    for r in range(res + 1):
        reach = 38.0 / ROOT7**r  # degrees; beyond the farthest descendant of a cell
        c = centres(cells)
        wide = reach / np.maximum(np.cos(np.radians(np.minimum(np.abs(c[:, 1]) + reach, 89.5))), 0.01)
        near = (c[:, 1] >= y0 - reach) & (c[:, 1] <= y1 + reach)
        near &= ((c[:, 0] >= x0 - wide) & (c[:, 0] <= x1 + wide)) | ((c[:, 0] + 360 <= x1 + wide)) | ((c[:, 0] - 360 >= x0 - wide)) | (wide >= 180)
        cells = cells[near]
        if r < res:
            cells = children(cells)
    if not buffer:
        inside = G._place(centres(cells), polygon) >= 0 if len(cells) else np.zeros(0, bool)
        yield from cells[inside].tolist()
        return
    for cell in cells.tolist():
        ring = boundary(cell)
        if np.ptp(ring[:, 0]) > 180:
            ring[:, 0] = np.where(ring[:, 0] < 0, ring[:, 0] + 360, ring[:, 0])
        for shift in (0, -360) if ring[:, 0].max() > 180 else (0,):
            if G.intersects(G.polygon(ring + [shift, 0]), polygon):
                yield cell
                break


# --- Columns ---------------------------------------------------------------------------------


def h3_cell(lon: Column, lat: Column, res: int) -> Column:
    """The cell of a place as a long; null for null."""
    check_res(res)

    @pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = (x.notna() & y.notna()).to_numpy()
        out = pd.Series(pd.array([None] * len(x), dtype="Int64"))
        if ok.any():
            out[ok] = cells_of(x.to_numpy(float)[ok], y.to_numpy(float)[ok], res)
        return out

    return run(lon, lat)


def h3_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def h3_number(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def h3_parent(cell: Column, res: int) -> Column:
    """Plain bit arithmetic."""
    low = (1 << 3 * (15 - check_res(res))) - 1
    return cell.bitwiseAND(F.lit(~((15 << 52) | low))).bitwiseOR(F.lit(res << 52 | low))


def h3_disk(cell: Column, k: int) -> Column:
    """Array of structs (cell, distance) within k steps."""

    @pandas_udf("array<struct<cell:long,distance:int>>")
    def run(c: pd.Series) -> pd.Series:
        row, near, far = disks(c.to_numpy(np.int64), k)
        out: list[list] = [[] for _ in range(len(c))]
        for n, x, d in zip(row.tolist(), near.tolist(), far.tolist(), strict=True):
            out[n].append({"cell": x, "distance": d})
        return pd.Series(out)

    return run(cell)


def h3_polygon(cell: Column) -> Column:
    """WKB of a cell's boundary."""
    from geoloom.functions import geometry as G

    @pandas_udf("binary")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([G.to_wkb(G.polygon(boundary(int(x)))) for x in c], dtype=object)

    return run(cell)


def h3_centre(cell: Column) -> Column:
    """Struct of lon and lat; cells of one resolution."""

    @pandas_udf("lon double, lat double")
    def run(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(centres(c.to_numpy(np.int64)), columns=["lon", "lat"])

    return run(cell)


def h3_local_ij(origin: Column, cell: Column) -> Column:
    """Struct of i and j of an origin less those of a cell."""

    @pandas_udf("i long, j long")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local_ij(int(x), np.array([y], np.int64))[0].tolist() for x, y in zip(a, b, strict=True)], columns=["i", "j"])

    return run(origin, cell)


def h3_path(start: Column, end: Column) -> Column:
    @pandas_udf("array<long>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out: list = []
        for k in range(0, len(a), 2_000):  # some at a time: a way has a cell per step
            out += paths(a.to_numpy(np.int64)[k : k + 2_000], b.to_numpy(np.int64)[k : k + 2_000])
        return pd.Series(out, dtype=object)

    return run(start, end)
