"""Spherical Voronoi regions: seeds lie in chunks along a curve, and corners ask for nearer seeds in their own chunk, then in those that they reach into."""

from __future__ import annotations

import functools
import itertools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geoloom.functions import geometry as G
from geoloom.schema import GEOMETRY
from geoloom.storage import written

#: Seeds of a cube in the first round at most, unless they crowd within a hair's breadth.
CROWD = 64
#: Seeds that a task solves together; fewer where there are few, so that all cores have some.
CHUNK, LEAST_CHUNK = 16_384, 1_024
#: Seeds, drawn by hash, that all tasks know: they only bound regions early that reach out of their chunk.
NET = 16_384
_EPS = 1e-13
#: Seeds of a leaf, leaves of a bough, regions that are cut together.
_LEAF, _BOUGH, _TOGETHER = 16, 32, 2_048
#: Squares along a side of a face of the cube that the curve runs through: two to this.
_BITS = 25
#: Half the width of the square around a seed from which its region is cut, on the plane that touches the sphere there.
_WIDE = 1.7
#: A region is pieces within the eight octants of the sphere, so a piece is convex and never wraps around the map.
_OCTANTS = [np.array([(a, 0, 0), (0, b, 0), (0, 0, c)], float) for a, b, c in itertools.product((1, -1), repeat=3)]
_STATE = "x double, y double, z double, verts array<struct<x:double,y:double,z:double>>, sizes array<int>"
_VERTEX = pa.struct([(c, pa.float64()) for c in "xyz"])


def unit(lon: Column, lat: Column) -> list[Column]:
    """A place's point on the unit sphere."""
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)]


def cubes(x: Column, y: Column, z: Column, side: float) -> list[Column]:
    """The cube of a grid that holds a point."""
    return [F.floor(v / F.lit(side)).cast("long") for v in (x, y, z)]


def first_side(points: DataFrame, n: int) -> float:
    """The side of cubes (2 holds the sphere in eight) of which none holds more than ``CROWD`` of ``n`` points (x, y, z), from a count per cube and try."""
    if n <= CROWD:
        return 2.0
    side = min(2.0, math.sqrt(4 * math.pi / n) * 1.5)
    while side > 1e-7 and points.groupBy(*cubes(F.col("x"), F.col("y"), F.col("z"), side)).count().agg(F.max("count")).first()[0] > CROWD:
        side /= 4
    return side


def _normals(seeds: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Unit normals, towards the seeds, of the planes halfway to others; none for a seed itself."""
    d = seeds - others
    long = np.sqrt((d * d).sum(1, keepdims=True))
    return np.divide(d, long, out=np.zeros_like(d), where=long > 0)


def _cut(piece: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of a spherical polygon on the positive side of a plane through the centre."""
    s = piece @ normal
    if (s >= -_EPS).all():
        return piece
    if (s <= _EPS).all():
        return piece[:0]
    out = []
    for k in range(len(piece)):
        a, b, sa, sb = piece[k - 1], piece[k], s[k - 1], s[k]
        if (sa > 0) != (sb > 0) and sa != sb:
            p = a + sa / (sa - sb) * (b - a)
            out.append(p / math.sqrt(p @ p))
        if sb > 0:
            out.append(b)
    return np.array(out).reshape(-1, 3)


def _parted(pieces: list[np.ndarray], normal: np.ndarray) -> list[np.ndarray]:
    return [p for p in (_cut(piece, normal) for piece in pieces) if len(p) >= 3]


def clipped(seed: np.ndarray, pieces: list[np.ndarray], others: np.ndarray) -> list[np.ndarray]:
    """Pieces cut along the great circles halfway to the other seeds, the deepest cut first."""
    normals = _normals(seed, others)
    while len(normals) and pieces:
        depth = (np.concatenate(pieces) @ normals.T).min(0)
        k = int(depth.argmin())
        if depth[k] >= -_EPS:
            break
        pieces = _parted(pieces, normals[k])
        normals = normals[depth < -_EPS] if (depth >= -_EPS).any() else np.delete(normals, k, 0)
    return pieces


def _octants(cell: np.ndarray) -> list[np.ndarray]:
    """A convex polygon's parts in the octants that it meets."""
    pieces = [cell]
    for axis in np.eye(3):
        pieces = [part for p in pieces for part in ([p] if (p @ axis >= -_EPS).all() or (p @ axis <= _EPS).all() else _parted([p], axis) + _parted([p], -axis))]
    return pieces


def _upright(seeds: np.ndarray) -> np.ndarray:
    """Axes (columns) in which a patch of the sphere lies flat, so that boxes around its parts are thin."""
    middle = seeds.mean(0)
    long = math.sqrt(float(middle @ middle))
    if long < 0.5:
        return np.eye(3)
    middle = middle / long
    east = np.eye(3)[(int(np.abs(middle).argmax()) + 1) % 3]
    east = east - (east @ middle) * middle
    east /= math.sqrt(float(east @ east))
    return np.stack([east, np.cross(middle, east), middle], 1)


def _along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of a face's squares along a Hilbert curve."""
    n, d = 1 << _BITS, np.zeros(len(x), np.int64)
    for k in range(_BITS - 1, -1, -1):
        rx, ry = x >> k & 1, y >> k & 1
        d += (3 * rx ^ ry) << 2 * k
        flip, low = (ry == 0) & (rx == 1), ry == 0
        x, y = np.where(flip, n - 1 - x, x), np.where(flip, n - 1 - y, y)
        x, y = np.where(low, y, x), np.where(low, x, y)
    return d


def _face(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The axis of the cube's face that a point lies on, and the face's first key."""
    axis = np.abs(seeds).argmax(1)
    return axis, (axis * 2 + (seeds[np.arange(len(seeds)), axis] < 0)).astype(np.int64) << 2 * _BITS


def _square(v: np.ndarray) -> np.ndarray:
    """The row or column of squares for places from -1 to 1 across a face."""
    n = 1 << _BITS
    return np.clip(np.floor((v + 1) / 2 * n), 0, n - 1).astype(np.int64)


def curve(seeds: np.ndarray) -> np.ndarray:
    """Where points of the unit sphere lie along Hilbert curves through the faces of a cube around it."""
    rows, (axis, face) = np.arange(len(seeds)), _face(seeds)
    long = np.abs(seeds[rows, axis])
    return face + _along(*(_square(seeds[rows, (axis + k) % 3] / long) for k in (1, 2)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns, pa.array(curve(np.stack([batch[c].to_numpy() for c in "xyz"], 1)))], names=[*batch.schema.names, "key"])


def _enclosed(seeds: np.ndarray, reach: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether all places within a distance of each seed surely lie between two keys of the curve, both not included."""
    rows, (axis, face) = np.arange(len(seeds)), _face(seeds)
    long, reach = np.abs(seeds[rows, axis]), reach * (1 + 1e-6) + 1e-13
    inside, squares = reach < long / 2, []
    least = np.maximum(long - reach, long / 2)
    for k in (1, 2):
        v = seeds[rows, (axis + k) % 3]
        ends = [np.minimum((v - reach) / least, (v - reach) / (long + reach)), np.maximum((v + reach) / least, (v + reach) / (long + reach))]
        inside &= (ends[0] > -1) & (ends[1] < 1)
        squares.append(list(map(_square, ends)))
    wide = np.maximum(*[b - a for a, b in squares])
    shift = np.ceil(np.log2(wide + 1.0)).astype(np.int64)  # squares of this size: two a side at most
    for x, y in itertools.product(*squares):
        key = _along(x, y) >> 2 * shift << 2 * shift
        inside &= (face + key > low) & (face + key + (np.int64(1) << 2 * shift) - 1 < high)
    return inside


class Nearest:
    """Finds the nearest of many seeds, given along a curve: boxes around leaves of them and around boughs of leaves tell where to look."""

    def __init__(self, seeds: np.ndarray):
        short = -len(seeds) % (_LEAF * _BOUGH)
        self.seeds = np.concatenate([seeds, np.repeat(seeds[-1:], short, 0)])
        self.turn = _upright(seeds)
        leaves = (self.seeds @ self.turn).T.reshape(3, -1, _LEAF)
        self.leaves = [np.ascontiguousarray(c) for c in leaves]
        self.boxes = np.stack([leaves.min(2), leaves.max(2)], 1).reshape(3, 2, -1, _BOUGH)
        self.boughs = np.stack([self.boxes[:, 0].min(2), self.boxes[:, 1].max(2)], 1)
        self.box = np.stack([self.boughs[:, 0].min(1), self.boughs[:, 1].max(1)], 1)

    def __call__(self, places: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each place the number of the nearest seed whose squared distance is at most ``most``, -1 where none is."""
        return np.concatenate([self._some(places[k : k + 4096] @ self.turn, most[k : k + 4096]) for k in range(0, len(places), 4096)]) if len(places) else np.zeros(0, int)

    @staticmethod
    def _off(places: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Squared distances (p, b) of places from boxes (3, 2, b), or from boxes of their own (3, 2, p, b)."""
        total = 0.0
        for c in range(3):
            v = places[:, c, None]
            gap = np.maximum(np.maximum(boxes[c, 0] - v, v - boxes[c, 1]), 0.0)
            total = total + gap * gap
        return total

    def _within(self, places: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest seed of a leaf each: squared distance and number."""
        total = 0.0
        for c in range(3):
            gap = self.leaves[c][leaf] - places[:, c, None]
            gap *= gap
            total = gap if c == 0 else total + gap
        k = total.argmin(1)
        return total[np.arange(len(k)), k], leaf * _LEAF + k

    def _some(self, places: np.ndarray, most: np.ndarray) -> np.ndarray:
        off, best = self._off(places, self.boughs), most * (1 + 1e-6)
        found = np.full(len(places), -1)
        far = np.flatnonzero((off <= best[:, None]).sum(1) > 4)  # a first seed spares them most boughs
        if len(far):
            bough = off[far].argmin(1)
            leaf = bough * _BOUGH + self._off(places[far], self.boxes[:, :, bough]).argmin(1)
            near, seed = self._within(places[far], leaf)
            less = near <= best[far]
            best[far[less]], found[far[less]] = near[less], seed[less]
        p, bough = np.nonzero(off <= best[:, None])
        k, twig = np.nonzero(self._off(places[p], self.boxes[:, :, bough]) <= best[p, None])
        p, leaf = p[k], bough[k] * _BOUGH + twig
        near, seed = self._within(places[p], leaf)
        close = near <= best[p]
        p, near, seed = p[close], near[close], seed[close]
        order = np.lexsort((near, p))
        p, seed = p[order], seed[order]
        first = np.append(True, p[1:] != p[:-1])[: len(p)]
        found[p[first]] = seed[first]
        return found


def _nearer(known: Nearest, places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The nearest seeds of places, their own where none is nearer."""
    k = known(places, ((places - own) ** 2).sum(1))
    return np.where((k >= 0)[:, None], known.seeds[k], own)


class Cells:
    """Convex regions around seeds as rows of corners, which are cut together."""

    def __init__(self, seeds: np.ndarray, corners: np.ndarray, count: np.ndarray):
        self.seeds, self.corners, self.count = seeds, corners, count
        self.sure = np.zeros(corners.shape[:2], bool)

    @classmethod
    def around(cls, seeds: np.ndarray) -> Cells:
        """Squares as wide as may be."""
        least = np.eye(3)[np.abs(seeds).argmin(1)]
        east = np.cross(least, seeds)
        east /= np.linalg.norm(east, axis=1, keepdims=True)
        north = np.cross(seeds, east)
        corners = np.stack([seeds + _WIDE * (a * east + b * north) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))], 1)
        corners /= np.linalg.norm(corners, axis=2, keepdims=True)
        return cls(seeds, np.pad(corners, ((0, 0), (0, 12), (0, 0))), np.full(len(seeds), 4))

    @classmethod
    def of(cls, seeds: np.ndarray, flat: np.ndarray, count: np.ndarray) -> Cells:
        corners = np.zeros((len(seeds), int(count.max(initial=4)) + 8, 3))
        row = np.repeat(np.arange(len(seeds)), count)
        corners[row, np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)] = flat
        return cls(seeds, corners, count.copy())

    def real(self) -> np.ndarray:
        return np.arange(self.corners.shape[1]) < self.count[:, None]

    def cut(self, rows: np.ndarray, others: np.ndarray) -> None:
        """Cuts some rows, each once, along the great circle halfway to another seed."""
        normals = _normals(self.seeds[rows], others)
        wide = int(self.count[rows].max(initial=0))
        s = np.einsum("rvk,rk->rv", self.corners[rows, :wide], normals)
        real = np.arange(wide) < self.count[rows, None]
        met = np.flatnonzero(((s < -_EPS / 2) & real).any(1))
        if not len(met):
            return
        rows, s, normals, n = rows[met], s[met], normals[met], self.count[rows[met]]
        inside = (s > 0) & real[met]
        k = np.arange(wide)
        before = np.take_along_axis(inside, np.where(k == 0, n[:, None] - 1, k - 1), 1)
        start = inside & ~before
        odd = start.sum(1) != 1  # a hair's breadth off convex
        for r, normal in zip(rows[odd], normals[odd], strict=True):
            self._put(r, _cut(self.corners[r, : self.count[r]], normal))
        if odd.any():
            rows, s, n, inside, start = (v[~odd] for v in (rows, s, n, inside, start))
        if not len(rows):
            return
        m, one = inside.sum(1), np.arange(len(rows))
        self._room(int(m.max()) + 2)
        order = (start.argmax(1)[:, None] + np.arange(wide)) % n[:, None]
        v = np.take_along_axis(self.corners[rows, :wide], order[..., None], 1)
        s = np.take_along_axis(s, order, 1)
        sure = np.take_along_axis(self.sure[rows, :wide], order, 1)
        ends = []
        for a, b in ((m - 1, m), (n - 1, np.zeros(len(rows), int))):
            sa, sb = s[one, a], s[one, b]
            p = v[one, a] + (sa / (sa - sb))[:, None] * (v[one, b] - v[one, a])
            ends.append(p / np.sqrt((p * p).sum(1, keepdims=True)))
        self.corners[rows, :wide], self.sure[rows, :wide] = v, sure
        for k, p in enumerate(ends):
            self.corners[rows, m + k], self.sure[rows, m + k] = p, False
        self.count[rows] = m + 2

    def _room(self, wide: int) -> None:
        more = wide + 8 - self.corners.shape[1]
        if more > 8:
            self.corners, self.sure = np.pad(self.corners, ((0, 0), (0, more), (0, 0))), np.pad(self.sure, ((0, 0), (0, more)))

    def _put(self, row: int, piece: np.ndarray) -> None:
        if len(piece) >= 3:
            self._room(len(piece))
            self.corners[row, : len(piece)], self.sure[row], self.count[row] = piece, False, len(piece)

    def settle(self, nearer) -> tuple[np.ndarray, np.ndarray]:
        """Cuts until no corner has a nearer seed, as ``nearer`` (of places and their seeds) finds them, or the seeds themselves; the rows that were cut and by which seeds."""
        cut_rows, cut_by = [], []
        while True:
            row, k = np.nonzero(self.real() & ~self.sure)
            if not len(row):
                break
            places, own = self.corners[row, k], self.seeds[row]
            others = nearer(places, own)
            depth = (places * _normals(own, others)).sum(1)
            self.sure[row, k] = True
            hit = depth < -_EPS
            row, others, depth = row[hit], others[hit], depth[hit]
            order = np.lexsort((depth, row))
            row, others = row[order], others[order]
            new = np.append(True, (row[1:] != row[:-1]) | (others[1:] != others[:-1]).any(1))[: len(row)]
            row, others = row[new], others[new]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
            rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            for turn in range(int(rank.max(initial=-1)) + 1):
                self.cut(row[rank == turn], others[rank == turn])
            cut_rows.append(row)
            cut_by.append(others)
        return (np.concatenate(cut_rows), np.concatenate(cut_by)) if cut_rows else (np.zeros(0, int), np.zeros((0, 3)))

    def pieces(self) -> tuple[np.ndarray, list[list[int]]]:
        """Corners of all rows in a line, and the sizes of each row's pieces: rows that meet more than one octant are parted."""
        real = self.real()
        low, high = (f(np.where(real[..., None], self.corners, e), axis=1) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
        several = np.flatnonzero(((low < -_EPS) & (high > _EPS)).any(1))
        sizes = [[n] for n in self.count.tolist()]
        if not len(several):
            return self.corners[real], sizes
        runs, at, ends = [], 0, np.cumsum(self.count)
        flat = self.corners[real]
        for r in several:
            parts = _octants(flat[ends[r] - self.count[r] : ends[r]])
            runs += [flat[at : ends[r] - self.count[r]], *parts]
            at, sizes[r] = ends[r], [len(p) for p in parts]
        return np.concatenate([*runs, flat[at:]]), sizes


def _settled(seed: np.ndarray, pieces: list[np.ndarray], nearer) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``Cells.settle`` for the pieces of one region of any size: the pieces and the seeds that cut them."""
    by = []
    while True:
        flat = np.concatenate(pieces)
        others = nearer(flat, np.broadcast_to(seed, flat.shape))
        normals = _normals(seed, others)
        depth = (flat * normals).sum(1)
        k = int(depth.argmin())
        if depth[k] >= -_EPS:
            return pieces, by
        by.append(others[k])
        pieces = _parted(pieces, normals[k])


def _lists(ends: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_VERTEX)))


def _state(seeds: np.ndarray, flat: np.ndarray, sizes: list[list[int]]) -> list[pa.Array]:
    """The columns of ``_STATE``."""
    return [*(pa.array(seeds[:, k]) for k in range(3)), _lists(np.cumsum([0, *map(sum, sizes)]), flat), pa.array(sizes, pa.list_(pa.int32()))]


def _spots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of (x, y, z) as one array of rows and the list's ends; null lists are empty."""
    flat = column.flatten()
    return np.stack([flat.field(k).to_numpy() for k in range(3)], 1), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())


def _ranges(ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places in a line of the lists of some rows."""
    count = np.diff(ends, prepend=0)[rows]
    return np.arange(count.sum()) + np.repeat(ends[rows] - np.cumsum(count), count)


def _begin(id_type: pa.DataType, size: int, net: np.ndarray):
    """Seeds along the curve to chunks with the regions that they have among themselves, bounded by the net."""
    far = Nearest(net)

    def solve(chunk: int, ids: pa.Array, keys: pa.Array, seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = Nearest(seeds)
        box = [[*near.turn.T.ravel().tolist(), *near.box.T.ravel().tolist()]]
        first, last = (int(keys[k].as_py()) for k in (0, -1))

        def nearer(places: np.ndarray, own: np.ndarray) -> np.ndarray:
            found, turned = _nearer(near, places, own), places @ near.turn
            out = np.flatnonzero(((turned < near.box[:, 0]) | (turned > near.box[:, 1])).any(1))
            found[out] = _nearer(far, places[out], found[out])
            return found

        for at in range(0, len(seeds), _TOGETHER):
            own = seeds[at : at + _TOGETHER]
            cells, rows = Cells.around(own), np.arange(len(own))
            # a start from seeds along the curve
            beside = near.seeds.reshape(-1, 8 * _LEAF, 3)
            beside = beside[(at + rows) // (8 * _LEAF)]
            off = sum((beside[..., c] - own[:, c, None]) ** 2 for c in range(3))
            order = np.argsort(off, 1)[:, 1:20]
            for k in range(order.shape[1]):
                cells.cut(rows, beside[rows, order[:, k]])
            cells.settle(nearer)
            flat, sizes = cells.pieces()
            bounded = np.where(cells.real(), np.einsum("rvk,rk->rv", cells.corners, own), 1.0).min(1) > 0.52
            if not bounded.all():  # they may reach beyond the square
                ends, runs = np.cumsum([0, *map(sum, sizes)]), []
                for r in range(len(own)):
                    if bounded[r]:
                        runs.append(flat[ends[r] : ends[r + 1]])
                    else:
                        parts, _ = _settled(own[r], _OCTANTS, nearer)
                        runs.append(np.concatenate(parts))
                        sizes[r] = [len(p) for p in parts]
                flat = np.concatenate(runs)
            row = np.repeat(rows, [sum(s) for s in sizes])
            reach = np.zeros(len(own))
            np.maximum.at(reach, row, np.sqrt(((flat - own[row]) ** 2).sum(1)))
            reach = pa.array(reach, mask=_enclosed(own, 2 * reach, first, last))
            columns = [pa.array(np.full(len(own), chunk)), keys[at : at + _TOGETHER], pa.array((box if at == 0 else [None]) + [None] * (len(own) - 1), pa.list_(pa.float64()))]
            columns += [reach, ids[at : at + _TOGETHER].cast(id_type), *_state(own, flat, sizes)]
            yield pa.record_batch(columns, names=["chunk", "key", "box", "reach", "sid", "x", "y", "z", "verts", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            while n >= 2 * size or (batch is None and n):
                table = pa.Table.from_batches(held)
                some = table.slice(0, size if n >= 2 * size else n).combine_chunks()
                held, n = table.slice(some.num_rows).to_batches(), n - some.num_rows
                yield from solve(chunk, some["sid"].combine_chunks(), some["key"].combine_chunks(), np.stack([some[c].to_numpy() for c in "xyz"], 1))
                chunk += 1

    return run


def _cutters(id_type: pa.DataType):
    """For regions that reach into a chunk, the seeds of the chunk that cut them."""

    def run(_, asked: pa.Table, there: pa.Table) -> pa.Table:
        names = ["sid", "found"]
        if not (asked.num_rows and there.num_rows):
            return pa.table([pa.array([], id_type), pa.array([], pa.list_(_VERTEX))], names=names)
        spots = there.sort_by("tkey")
        nearer = functools.partial(_nearer, Nearest(np.stack([spots[f"t{c}"].to_numpy() for c in "xyz"], 1)))
        seeds = np.stack([asked[c].to_numpy() for c in "xyz"], 1)
        flat, ends = _spots(asked["verts"].combine_chunks())
        sizes = asked["sizes"].to_pylist()
        one = np.array([len(s) == 1 for s in sizes], bool)
        rows, by = [], []
        single = np.flatnonzero(one)
        for at in range(0, len(single), _TOGETHER):
            some = single[at : at + _TOGETHER]
            cells = Cells.of(seeds[some], flat[_ranges(ends, some)], np.diff(ends, prepend=0)[some])
            r, others = cells.settle(nearer)
            rows.append(some[r])
            by.append(others)
        for r in np.flatnonzero(~one):
            _, others = _settled(seeds[r], np.split(flat[ends[r] - sum(sizes[r]) : ends[r]], np.cumsum(sizes[r])[:-1]), nearer)
            if others:
                rows.append(np.full(len(others), r))
                by.append(np.array(others))
        row, by = (np.concatenate(rows), np.concatenate(by)) if rows else (np.zeros(0, int), np.zeros((0, 3)))
        order = np.argsort(row, kind="stable")
        hit, count = np.unique(row, return_counts=True)
        return pa.table([asked["sid"].combine_chunks().take(pa.array(hit)).cast(id_type), _lists(np.cumsum([0, *count]), by[order])], names=names)

    return run


def _finish(id_type: pa.DataType):
    """Cuts regions by what other chunks found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(start, _TOGETHER)
                seeds = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], 1)
                flat, ends = _spots(batch.column(4))
                others, other_ends = _spots(batch.column(6))
                sizes, count = batch.column(5).to_pylist(), np.diff(other_ends, prepend=0)
                cut = count > 0
                one = np.array([len(s) == 1 for s in sizes], bool)
                some, parts = np.flatnonzero(cut & one), {}
                if len(some):
                    cells = Cells.of(seeds[some], flat[_ranges(ends, some)], np.diff(ends, prepend=0)[some])
                    for turn in range(int(count[some].max())):
                        rows = np.flatnonzero(count[some] > turn)
                        cells.cut(rows, others[other_ends[some[rows]] - count[some[rows]] + turn])
                    done, done_sizes = cells.pieces()
                    at = np.cumsum([0, *map(sum, done_sizes)])
                    parts = {int(r): (done[at[k] : at[k + 1]], done_sizes[k]) for k, r in enumerate(some)}
                for r in np.flatnonzero(cut & ~one):
                    pieces = np.split(flat[ends[r] - sum(sizes[r]) : ends[r]], np.cumsum(sizes[r])[:-1])
                    pieces = clipped(seeds[r], pieces, others[other_ends[r] - count[r] : other_ends[r]])
                    parts[int(r)] = np.concatenate(pieces), [len(p) for p in pieces]
                if parts:
                    runs, at = [], 0
                    for r in sorted(parts):
                        runs += [flat[at : ends[r] - sum(sizes[r])], parts[r][0]]
                        at, sizes[r] = ends[r], parts[r][1]
                    flat = np.concatenate([*runs, flat[at:]])
                yield pa.record_batch([batch.column(0).cast(id_type), *_state(seeds, flat, sizes)], names=["sid", "x", "y", "z", "verts", "sizes"])

    return run


def regions(seeds: DataFrame, seed_id: str) -> DataFrame:
    """(sid, x, y, z, verts, sizes) of the regions: vertices on the unit sphere, piece by piece.

    A seed cuts a region if and only if it is nearer to one of its corners than the region's own. Seeds are dealt by ranges of a curve to chunks;
    a chunk's regions are cut among themselves until no corner has a nearer seed there, and by a net of a few seeds of all places, which
    bounds those at its edge. Regions that the chunk's part of the curve surrounds are done. Others ask in the chunks in whose box their corners may have nearer
    seeds, and what was found cuts them once more. However seeds crowd, a corner looks up one seed at a time and no pairs are listed.
    """
    id_type = seeds.schema[seed_id].dataType
    own = seeds.select(F.col(seed_id).alias("sid"), *[c.alias(n) for c, n in zip(unit(F.col("lon"), F.col("lat")), "xyz", strict=True)])
    arrow_id, kind = to_arrow_type(id_type), id_type.simpleString()
    own = written(own.mapInArrow(_keyed, f"sid {kind}, x double, y double, z double, key long"), "seeds")
    n = own.count()
    size = min(CHUNK, max(LEAST_CHUNK, n // 32))
    known = own.filter(F.pmod(F.xxhash64("sid"), F.lit(max(1, -(-2 * n // NET)))) == 0) if n > NET else own
    known = known.orderBy("key").limit(NET).select("x", "y", "z").toArrow()
    net = np.stack([known[c].to_numpy() for c in "xyz"], 1)
    placed = own.repartitionByRange(-(-n // size), "key").sortWithinPartitions("key")
    begun = written(placed.mapInArrow(_begin(arrow_id, size, net), f"chunk long, key long, box array<double>, reach double, sid {kind}, {_STATE}"), "begun")
    boxes = begun.filter("box is not null").select(F.col("chunk").alias("to"), F.col("box").alias("b"))

    def off(at) -> Column:
        """The squared distance of a place from a chunk's box, which lies along axes of its own."""
        turned = [sum((F.col("b")[3 * k + j] * at(c) for j, c in enumerate("yz", 1)), F.col("b")[3 * k] * at("x")) for k in range(3)]
        gaps = [F.greatest(F.col("b")[9 + k] - t, t - F.col("b")[12 + k], F.lit(0.0)) for k, t in enumerate(turned)]
        return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]

    hair = 1 + 1e-6
    square = lambda v: sum(((v[c] - F.col(c)) * (v[c] - F.col(c)) for c in "yz"), (v["x"] - F.col("x")) * (v["x"] - F.col("x")))
    near = (F.col("to") != F.col("chunk")) & (off(F.col) <= 4 * hair * F.col("reach") * F.col("reach"))
    state = ["sid", "x", "y", "z", "verts", "sizes"]
    some = begun.filter("reach is not null").drop("box", "key")
    asked = some.join(F.broadcast(boxes), near).filter(F.exists("verts", lambda v: off(lambda c: v[c]) <= square(v) * hair))
    asked = asked.select("to", *state)
    there = begun.select(*[F.col(c).alias(f"t{c}") for c in ("chunk", "key", *"xyz")])
    found = asked.groupBy("to").cogroup(there.groupBy("tchunk")).applyInArrow(_cutters(arrow_id), f"sid {kind}, found array<struct<x:double,y:double,z:double>>")
    found = found.groupBy("sid").agg(F.flatten(F.collect_list("found")).alias("found"))
    met = some.select(*state).join(found, "sid", "left")
    return begun.filter("reach is null").select(*state).unionByName(written(met.mapInArrow(_finish(arrow_id), f"sid {kind}, {_STATE}"), "regions"))


def _arc(a: np.ndarray, b: np.ndarray, seed: np.ndarray, step: float) -> list[np.ndarray]:
    """Corners of an edge from its first end up to its last: halved until no part is longer than ``step`` or half its distance from the seed.

    Both sides of an edge are as far from their seeds and halve alike, so they get the same corners.
    """
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        long = math.sqrt(float((p - q) @ (p - q)))
        mid = p + q
        mid = mid / math.sqrt(float(mid @ mid))
        far = math.sqrt(float((mid - seed) @ (mid - seed)))
        if long > step or long > max(0.5 * far, 1e-7):
            todo += [(mid, q), (p, mid)]
        else:
            out.append(p)
    return out


def _ring(piece: np.ndarray, seed: np.ndarray, step: float) -> np.ndarray | None:
    """A piece as a closed ring in degrees; a pole becomes the part of the map's edge above the piece."""
    inside = piece.mean(0)
    west = math.floor(math.degrees(math.atan2(inside[1], inside[0])) / 90) * 90.0
    points = [p for a, b in zip(piece, np.roll(piece, -1, 0), strict=True) for p in _arc(a, b, seed, step)]
    out, poles = [], [math.hypot(p[0], p[1]) < 1e-12 for p in points]
    lon = [min(west + 90, max(west, (math.degrees(math.atan2(p[1], p[0])) - west + 180) % 360 - 180 + west)) for p in points]
    for k, p in enumerate(points):
        if poles[k]:
            after = (k + 1) % len(points)
            out += [(lon[k - 1], math.copysign(90.0, p[2])), (lon[after], math.copysign(90.0, p[2]))]
        else:
            out.append((lon[k], math.degrees(math.asin(float(np.clip(p[2], -1, 1))))))
    ring = np.array(out)
    ring = ring[np.concatenate([[True], (np.abs(np.diff(ring, axis=0)) > 0).any(1)])]
    if len(ring) < 3:
        return None
    nxt = np.roll(ring, -1, 0)
    turned = (ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum() < 0
    ring = ring[::-1] if turned else ring
    return np.vstack([ring, ring[:1]])


def _outlines(flat: np.ndarray, size: np.ndarray, seeds: np.ndarray, step: float) -> list[bytes | None]:
    """``_ring`` of many pieces, each with its seed, as WKB polygons; None where nothing is left."""
    ends = np.cumsum(size)
    after = np.arange(1, len(flat) + 1)
    after[ends - 1] = ends - size
    p, q, at = flat, flat[after], np.repeat(np.arange(len(size)), size)
    while True:
        mid = p + q
        mid = mid / np.sqrt((mid * mid).sum(1, keepdims=True))
        long, far = (np.sqrt((d * d).sum(1)) for d in (p - q, mid - seeds[at]))
        parted = (long > step) | (long > np.maximum(0.5 * far, 1e-7))
        if not parted.any():
            break
        k = np.repeat(np.arange(len(p)), 1 + parted)
        twice = k[1:] == k[:-1]
        p, q, at = np.where(np.append(False, twice)[:, None], mid[k], p[k]), np.where(np.append(twice, False)[:, None], mid[k], q[k]), at[k]
    inside = np.add.reduceat(flat, ends - size)
    west = (np.floor(np.degrees(np.arctan2(inside[:, 1], inside[:, 0])) / 90) * 90.0)[at]
    lon = np.minimum(west + 90, np.maximum(west, (np.degrees(np.arctan2(p[:, 1], p[:, 0])) - west + 180) % 360 - 180 + west))
    xy = np.stack([lon, np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1)))], 1)
    poles = np.unique(at[np.hypot(p[:, 0], p[:, 1]) < 1e-12])
    keep = np.append(True, (at[1:] != at[:-1]) | (xy[1:] != xy[:-1]).any(1))
    xy, at = xy[keep], at[keep]
    m = np.bincount(at, minlength=len(size))
    start = np.cumsum(m) - m
    off = xy - xy[start[at]]
    after = np.append(off[1:], off[:1], 0)
    after[start + m - 1] = 0
    flip = np.bincount(at, off[:, 0] * after[:, 1] - after[:, 0] * off[:, 1], len(size)) < 0
    ring = np.repeat(np.arange(len(size)), m + 1)
    k = np.arange(len(ring)) - (start + np.arange(len(size)))[ring]
    k = np.where(k == m[ring], 0, k)
    raw = xy[start[ring] + np.where(flip[ring], m[ring] - 1 - k, k)].astype("<f8").tobytes()
    begin, head = 16 * (start + np.arange(len(size))), struct.pack("<BII", 1, 3, 1)
    out = [head + struct.pack("<I", c + 1) + raw[b : b + 16 * (c + 1)] if c >= 3 else None for b, c in zip(begin.tolist(), m.tolist(), strict=True)]
    for k in poles.tolist():
        done = _ring(flat[ends[k] - size[k] : ends[k]], seeds[k], step)
        out[k] = None if done is None else G.to_wkb(("polygon", [[done]]))
    return out


def drawn(found: DataFrame, seed_id: str, step_degrees: float) -> DataFrame:
    """Regions as WKB polygons in longitude and latitude, split at the octants' edges."""
    id_type = found.schema["sid"].dataType
    arrow_id, step = to_arrow_type(id_type), math.radians(step_degrees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _TOGETHER):
                batch = whole.slice(start, _TOGETHER)
                seeds = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], 1)
                flat, _ = _spots(batch.column(1))
                parts = pc.list_value_length(batch.column(2)).to_numpy()
                made = _outlines(flat, batch.column(2).flatten().to_numpy(), np.repeat(seeds, parts, 0), step)
                shapes, ends = [], np.cumsum(parts).tolist()
                for n, end in zip(parts.tolist(), ends, strict=True):
                    some = [w for w in made[end - n : end] if w is not None]
                    shapes.append(some[0] if len(some) == 1 else struct.pack("<BII", 1, 6, len(some)) + b"".join(some))
                yield pa.record_batch([batch.column(0).cast(arrow_id), pa.array(shapes, pa.binary())], names=[seed_id, GEOMETRY])

    return found.select("sid", "verts", "sizes", "x", "y", "z").mapInArrow(run, f"`{seed_id}` {id_type.simpleString()}, {GEOMETRY} binary")
