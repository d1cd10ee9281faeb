"""The H3 grid against itself over the whole Earth, and against known cells."""

import numpy as np
import pytest

from geoloom.functions import geometry as G
from geoloom.functions import h3


def everything(res):
    cells = h3._assemble(np.arange(122), np.zeros((122, 0), int))
    for _ in range(res):
        cells = h3.children(cells)
    return cells


# Places and their cells.
@pytest.mark.parametrize(("lon", "lat", "res", "cell"), [(17.9261, 50.6696, 10, "8a1e23c44b5ffff"), (-122.418307270836, 37.7752702151959, 9, "8928308280fffff")])
def test_known_cells(lon, lat, res, cell):
    assert h3.to_text(h3.cells_of([lon], [lat], res)[0]) == cell
    assert h3.to_text(h3.parent(np.array([h3.from_text(cell)]), 5)[0]) == h3.to_text(h3.cells_of(*h3.centres(np.array([h3.from_text(cell)])).T, 5)[0])


def test_base_cells_are_numbered_from_north_to_south():
    g = h3._geometry()
    lat = h3._degrees(g.sphere(g.home, h3._xy(g.home_axial)))[:, 1]
    assert (np.diff(lat) < 1e-9).all() and g.pentagon.sum() == 12


@pytest.mark.parametrize("res", [0, 1, 2, 3])
def test_all_cells_of_a_resolution(res):
    cells = everything(res)
    assert len(cells) == len(set(cells.tolist())) == 2 + 120 * 7**res
    assert (h3.cells_of(*h3.centres(cells).T, res) == cells).all()
    near = h3.neighbours(cells)
    pairs = set(zip(cells[near[:, 0]].tolist(), near[:, 1].tolist(), strict=True))
    assert len(pairs) == len(near) == 6 * len(cells) - 12 and all((b, a) in pairs for a, b in pairs)


@pytest.mark.parametrize("res", [0, 1, 2])
def test_boundaries_tile_the_sphere(res):
    def area(ring):
        p = h3._unit(np.radians(ring[:, 1]), np.radians(ring[:, 0]))
        c = p.mean(0) / np.linalg.norm(p.mean(0))
        q = np.roll(p, -1, 0)
        return sum(2 * np.arctan2(c @ np.cross(a, b), 1 + a @ b + b @ c + c @ a) for a, b in zip(p, q, strict=True))

    cells = everything(res).tolist()
    assert sum(area(h3.boundary(c)) for c in cells) == pytest.approx(4 * np.pi)
    assert sum(h3.is_pentagon(np.array(cells))) == 12


def test_disks_and_paths():
    start, end = h3.cells_of([17.0, 17.4], [51.1, 51.2], 8).tolist()
    row, cell, far = h3.disks(np.array([start, end]), 3)
    assert np.bincount(far).tolist() == [2, 12, 24, 36] and len(set(zip(row.tolist(), cell.tolist(), strict=True))) == 74
    way = h3.path(start, end)
    near = h3.neighbours(way)
    pairs = set(zip(way[near[:, 0]].tolist(), near[:, 1].tolist(), strict=True))
    assert way[0] == start and way[-1] == end and all(p in pairs for p in zip(way[:-1].tolist(), way[1:].tolist(), strict=True))
    five = everything(1)[h3.is_pentagon(everything(1))][:1]
    assert np.bincount(h3.disks(five, 2)[2]).tolist() == [1, 5, 10]


# Pairs that a pentagon comes between.
@pytest.mark.parametrize(("a", "b"), [("83a75dfffffffff", "83a791fffffffff"), ("84a605bffffffff", "84a6021ffffffff"), ("836200fffffffff", "837400fffffffff")])
def test_pentagons_have_no_local_coordinates(a, b):
    with pytest.raises(ValueError):
        h3.local_ij(h3.from_text(a), np.array([h3.from_text(b)]))
    assert h3.local_ij(h3.from_text(a), np.array([h3.from_text(a)])).tolist() == [[0, 0]]


def test_cover_holds_every_place_of_an_area():
    rng = np.random.default_rng(4)
    shape = G.polygon([(10, 45), (11.3, 45.2), (11, 46.1), (10.2, 45.7)])
    xy = rng.uniform((10, 45), (11.3, 46.1), (4000, 2))
    inside = xy[G.locate(xy, shape[1][0]) > 0]
    cells = set(h3.cover(shape, 6))
    assert set(h3.cells_of(*inside.T, 6).tolist()) <= cells
    whole = set(h3.cover(shape, 6, buffer=False))
    assert whole < cells and (G.locate(h3.centres(np.array(sorted(whole))), shape[1][0]) >= 0).all()
    with pytest.raises(ValueError):
        h3.check_res(16)


def test_paths_of_many_pairs_are_worked_out_together(monkeypatch):
    lon, lat = np.linspace(16.8, 17.2, 400), np.linspace(51.0, 51.2, 400)[::-1]
    cells = h3.cells_of(lon, lat, 8)
    alone = [h3.path(a, b).tolist() for a, b in zip(cells[:-7].tolist(), cells[7:].tolist(), strict=True)]
    calls = []
    monkeypatch.setattr(h3, "_cells_at", lambda p, res, own=h3._cells_at: calls.append(len(p)) or own(p, res))
    assert [p.tolist() for p in h3.paths(cells[:-7], cells[7:])] == alone and len(calls) == 1
    assert all(p[0] == a and p[-1] == b for p, a, b in zip(alone, cells[:-7].tolist(), cells[7:].tolist(), strict=True))
