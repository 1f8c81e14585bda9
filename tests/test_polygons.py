"""Snapping across features and exact cell coverage against plain readings."""

import collections
import random

import numpy as np
import pytest
from test_geometry import star, vertices

from edgeline.operators import coverage as cov
from edgeline.operators import snapping

VERTEX = "fid long, ring int, vtx long, x double, y double"


@pytest.mark.parametrize("seed, tolerance", [(0, 3.0), (1, 8.0), (2, 0.5)])
def test_neighbours_meet_in_one_place(spark, seed, tolerance):
    r = random.Random(seed)
    rows = [(f, 0, v, round(r.uniform(-40, 40), 1), round(r.uniform(-40, 40), 1))
            for f in range(12) for v in range(20)]
    places = sorted({(x, y) for *_, x, y in rows})
    root = {p: p for p in places}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(places):
        for b in places[i + 1:]:
            if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= tolerance ** 2:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    df = spark.createDataFrame(rows, VERTEX)
    got = {(g.fid, g.vtx): (g.x, g.y) for g in snapping.snap_neighbours(df, tolerance).collect()}
    assert got == {(f, v): find((x, y)) for f, _, v, x, y in rows}
    assert any(find(p) != p for p in places)


def test_crowded_cell_needs_no_pairs(spark):
    """Thousands of positions in one cell are linked to its first, not to one another."""
    rows = [(i, 0, 0, i * 1e-5, 0.0) for i in range(3000)]
    got = snapping.snap_neighbours(spark.createDataFrame(rows, VERTEX), 1.0).collect()
    assert {(g.x, g.y) for g in got} == {(0.0, 0.0)}


def test_snapping_edges(spark):
    none = spark.createDataFrame([], VERTEX)
    assert snapping.snap_neighbours(none, 1.0).collect() == []
    with pytest.raises(ValueError):
        snapping.snap_neighbours(none, 0.0)
    rows = [(1, 0, 0, None, 1.0), (1, 0, 1, 5.0, 5.0)]
    got = {g.vtx: (g.x, g.y) for g in snapping.snap_neighbours(spark.createDataFrame(rows, VERTEX), 1.0).collect()}
    assert got == {0: (None, 1.0), 1: (5.0, 5.0)}


def clipped(points, x0, x1, y0, y1):
    """Area of a polygon inside a box, by cutting it along the four sides in turn."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(points, points[1:] + points[:1]):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        points = out
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


@pytest.mark.parametrize("seed", [0, 1])
def test_coverage_equals_clipping(spark, seed):
    rng = np.random.default_rng(seed)
    shapes = {1: star(rng, 0, 0, 3000), 2: star(rng, 400, -900, 1300, snap=500),
              3: [(-750.0, -250.0), (-750.0, 900.0), (1250.0, 900.0), (1250.0, -250.0), (-750.0, -250.0)]}
    df = vertices(spark, {fid: [points] for fid, points in shapes.items()})
    got = {(r.fid, r.cx, r.cy): r.area for r in cov.coverage(df).collect()}
    for fid, points in shapes.items():
        ring = [tuple(map(float, p)) for p in points]
        ring = ring[:-1] if ring[0] == ring[-1] else ring
        for cx in range(-9, 9):
            for cy in range(-9, 9):
                want = clipped(ring, cx * 500, cx * 500 + 500, cy * 500, cy * 500 + 500)
                assert got.get((fid, cx, cy), 0.0) == pytest.approx(want, abs=1e-3)
    total = collections.Counter()
    for (fid, _, _), area in got.items():
        total[fid] += area
    for fid, points in shapes.items():
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2
        assert total[fid] == pytest.approx(abs(area), rel=1e-9)


def test_largest_overlap_ties_and_misses(spark):
    areas = spark.createDataFrame([(1, 0, 0, 5.0), (1, 1, 0, 5.0), (2, 9, 9, 1.0), (3, 0, 0, 1.0), (3, 1, 0, 2.0)],
                                  "fid long, cx long, cy long, area double")
    zones = spark.createDataFrame([("b", 0, 0), ("a", 1, 0)], "label string, cx long, cy long")
    got = {r.fid: tuple(r)[1:] for r in cov.largest_overlap(areas, zones).collect()}
    assert got == {1: ("a", 5.0, 10.0), 2: (None, None, 1.0), 3: ("a", 2.0, 3.0)}
