"""Outlines and clipped polygons: against a sweep over whole masks and against areas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import kernels, outlines, plots, rings


def masks():
    rng = np.random.default_rng(5)
    spiral = np.zeros((33, 33), bool)
    r = c = 16
    for k, (dr, dc) in enumerate([(0, 2), (2, 0), (0, -2), (-2, 0)] * 8):
        for _ in range(k // 2 + 1):
            if 0 <= r + dr < 33 and 0 <= c + dc < 33:
                spiral[r, c] = spiral[r + dr // 2, c + dc // 2] = spiral[r + dr, c + dc] = True
                r, c = r + dr, c + dc
    nested = np.ones((21, 21), bool)
    for k in range(1, 10):
        nested[k : 21 - k, k : 21 - k] = k % 2 == 0
    return {1: rng.random((25, 31)) < 0.6, 2: spiral, 3: nested, 4: np.ones((1, 1), bool), 5: np.indices((8, 9)).sum(0) % 2 == 0, 6: rng.random((20, 20)) < 0.9}


def turned(ring):
    """A ring from its least corner on."""
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def test_rings_and_nesting(spark):
    some = masks()
    rows = [(g, int(r), int(c), 1) for g, m in some.items() for r, c in np.argwhere(m)] + [(7, 0, 0, None), (8, 0, 0, 2), (8, 0, 1, 3), (8, 1, 0, 3), (8, 1, 1, 2)]
    px = spark.createDataFrame(rows, "boundary_id long, px_row int, px_col int, zone int").repartition(5)
    found = outlines.regions(px).collect()
    for g, m in some.items():
        mine = [x for x in found if x.boundary_id == g]
        want = sorted(turned(r) for r in kernels.boundary_rings(m))
        points = lambda ring: [(int(p.x), int(p.y)) for p in ring]
        assert sorted(turned(points(r)) for x in mine for r in [x.outer, *x.holes]) == want
        assert sum(x.area_px for x in mine) == m.sum()
        for x in mine:
            outer = np.array(points(x.outer), float)
            assert all(rings._inside(np.mean(points(h)[:2], axis=0), outer) for h in x.holes)
            assert x.area_px == abs(rings.area_of(outer)) - sum(abs(rings.area_of(np.array(points(h), float))) for h in x.holes)
    assert sorted((x.zone, x.area_px) for x in found if x.boundary_id == 8) == [(2, 1.0), (2, 1.0), (3, 1.0), (3, 1.0)]
    assert not [x for x in found if x.boundary_id == 7]
    several = outlines.multipolygons(outlines.regions(px)).where("boundary_id = 3").first()
    assert several.region_count == 5 and [len(p.holes) for p in several.polygons].count(1) == 5


def test_polygons_within_boxes():
    """The area of the parts is the area of the whole less that of the holes, box by box; parts are valid and apart."""
    rng = np.random.default_rng(6)
    seen = 0
    for _ in range(200):
        turn = np.sort(rng.random(rng.integers(6, 14))) * 2 * np.pi
        outer = np.c_[np.cos(turn), np.sin(turn)] * (4 + 4 * rng.random((len(turn), 1)))
        if not rings.is_valid(outer) or np.diff(turn, append=turn[0] + 2 * np.pi).max() > 2.5:
            continue
        around = np.linspace(0, 2 * np.pi, 9)[:-1]
        holes = [np.c_[np.cos(around), np.sin(around)] * 0.5 + at for at in ((0.7, 0.6), (-0.8, 0.3))]
        if not all(rings._inside(p, outer) for h in holes for p in h) or rings._sides_meet(outer, np.vstack(holes)):
            continue
        if rng.random() < 0.5:
            outer = outer[::-1]
        (x0, x1), (y0, y1) = (sorted(rng.random(2) * 4 - 2) for _ in range(2))
        parts = rings.clip_polygon(outer, holes, x0, y0, x1, y1)
        alone = lambda p: sum(abs(rings.area_of(q)) for q in rings.clip_parts(p, x0, y0, x1, y1))
        mine = sum(abs(rings.area_of(p)) - sum(abs(rings.area_of(h)) for h in inner) for p, inner in parts)
        assert mine == pytest.approx(alone(outer) - sum(map(alone, holes)), abs=1e-9)
        for p, inner in parts:
            assert rings.is_valid(p) and all(np.sign(rings.area_of(h)) == -np.sign(rings.area_of(p)) for h in inner)
        seen += any(inner for _, inner in parts)
    assert seen > 5


def test_cells_of_concave_fields(spark):
    point = lambda x, y: {"x": x / 1e4, "y": y / 1e4}
    u = [point(*p) for p in ((0, 0), (60, 0), (60, 60), (40, 60), (40, 20), (20, 20), (20, 60), (0, 60))]
    df = spark.createDataFrame([(1, u)], "boundary_id long, ring array<struct<x:double,y:double>>")
    cells = plots.grid_plots(df, 2, 1).orderBy("plot_id").collect()
    assert [len(c.polygons) for c in cells] == [1, 2]
    for p in cells[1].polygons:
        xs = sorted({round(q.x * 1e4, 6) for q in p.outer})
        assert xs in ([0.0, 20.0], [40.0, 60.0])  # no side bridges the notch
