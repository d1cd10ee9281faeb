"""S2 cells: cube projection and Hilbert order in numpy, id arithmetic as Column expressions.

Ids are the 64-bit S2 cell ids as signed longs; tokens are their hex digits without trailing
zeros. The curve's orientation tables follow from two rules: swap the axes, invert them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MAX_LEVEL = 30
# The order of the four children along the curve, per orientation (bit 0 swap, bit 1 invert).
POS_TO_IJ = np.array([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]])
POS_TO_ORIENTATION = np.array([1, 0, 0, 3])
IJ_TO_POS = np.argsort(POS_TO_IJ, axis=1)


def check_level(level: int) -> int:
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"level must be from 0 to {MAX_LEVEL}, not {level}")
    return level


def _st(u: np.ndarray) -> np.ndarray:
    """Quadratic projection of cube coordinates to [0, 1]."""
    return np.where(u >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(u)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(u)))


def _uv(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def cell_ids(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    """Ids (uint64) of the cells of a level that hold the points."""
    lam, phi = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    xyz = np.stack([np.cos(lam) * np.cos(phi), np.sin(lam) * np.cos(phi), np.sin(phi)])
    axis = np.abs(xyz).argmax(0)
    face = axis + 3 * (np.take_along_axis(xyz, axis[None], 0)[0] < 0)
    x, y, z = xyz
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    size = 1 << MAX_LEVEL
    i = np.clip(np.floor(size * _st(u)), 0, size - 1).astype(np.int64)
    j = np.clip(np.floor(size * _st(v)), 0, size - 1).astype(np.int64)
    turn, pos = face & 1, np.zeros(len(face), np.uint64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        p = IJ_TO_POS[turn, ((i >> k) & 1) << 1 | ((j >> k) & 1)]
        pos = pos << np.uint64(2) | p.astype(np.uint64)
        turn = turn ^ POS_TO_ORIENTATION[p]
    leaf = (face.astype(np.uint64) << np.uint64(61)) | (pos << np.uint64(1)) | np.uint64(1)
    low = np.uint64(1 << 2 * (MAX_LEVEL - check_level(level)))
    return leaf & ~(low - np.uint64(1)) & ~low | low if level < MAX_LEVEL else leaf


def level_of(cell: int) -> int:
    cell &= (1 << 64) - 1
    return MAX_LEVEL - ((cell & -cell).bit_length() - 1) // 2


def _face_ij(cell: int) -> tuple[int, int, int, int]:
    """Face, i, j of the cell's low corner on the leaf grid, and its size there."""
    cell &= (1 << 64) - 1
    level = level_of(cell)
    face, turn, i, j = cell >> 61, (cell >> 61) & 1, 0, 0
    for k in range(level):
        p = cell >> (59 - 2 * k) & 3
        ij = int(POS_TO_IJ[turn, p])
        i, j = i << 1 | ij >> 1, j << 1 | ij & 1
        turn ^= int(POS_TO_ORIENTATION[p])
    size = 1 << (MAX_LEVEL - level)
    return face, i * size, j * size, size


def _lonlat(face: int, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    u, v = _uv(np.asarray(s, float)), _uv(np.asarray(t, float))
    one = np.ones_like(u)
    x, y, z = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)][face]
    return np.stack([np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))], -1)


def boundary(cell: int) -> np.ndarray:
    """The four corners, counter-clockwise, as (lon, lat)."""
    face, i, j, size = _face_ij(cell)
    n = float(1 << MAX_LEVEL)
    s, t = np.array([i, i + size, i + size, i]) / n, np.array([j, j, j + size, j + size]) / n
    return _lonlat(face, s, t)


def center(cell: int) -> np.ndarray:
    face, i, j, size = _face_ij(cell)
    n = float(1 << MAX_LEVEL)
    return _lonlat(face, np.array([(i + size / 2) / n]), np.array([(j + size / 2) / n]))[0]


def token(cell: int) -> str:
    return f"{cell & (1 << 64) - 1:016x}".rstrip("0") or "X"


def from_token(text: str) -> int:
    return int(text.ljust(16, "0"), 16)


# --- Column functions ------------------------------------------------------------------------


def s2_cell(lon: Column, lat: Column, level: int) -> Column:
    """Cell id as a signed long."""
    check_level(level)

    @pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(cell_ids(x.to_numpy(), y.to_numpy(), level).view(np.int64))

    return run(lon, lat)


def s2_token(cell: Column) -> Column:
    return F.regexp_replace(F.lower(F.lpad(F.hex(cell), 16, "0")), "0+$", "")


def s2_id(text: Column) -> Column:
    """Id of a token; ids beyond the signed range wrap."""
    padded = F.rpad(text, 16, "0")
    high, low = F.conv(F.substring(padded, 1, 8), 16, 10).cast("long"), F.conv(F.substring(padded, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def s2_parent(cell: Column, level: int) -> Column:
    """The cell of a coarser level that holds a cell."""
    low = 1 << 2 * (MAX_LEVEL - check_level(level))
    mask = -(low << 1)
    return cell.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(low))


def s2_children(cell: Column, level: int, target: int) -> Column:
    """Array of all cells of level ``target`` in a cell of level ``level``, in curve order."""
    if check_level(target) < check_level(level):
        raise ValueError("children can't be of a coarser level")
    if target == level:
        return F.array(cell)
    own, low = 1 << 2 * (MAX_LEVEL - level), 1 << 2 * (MAX_LEVEL - target)
    first = cell - F.lit(own - low)
    return F.transform(F.sequence(F.lit(0), F.lit(4 ** (target - level) - 1)), lambda k: first + k * F.lit(2 * low))
