"""Footprint polygons and depths against plain readings on small random masks."""

import collections
import random

import numpy as np
import pytest

from edgeline.operators import cells as cl
from edgeline.operators import footprints as fp


def mask(seed, n=24, fill=0.62):
    rng = random.Random(seed)
    return {(x, y) for x in range(-3, n) for y in range(-2, n) if rng.random() < fill}


def components(spark, cells):
    rows = spark.createDataFrame(sorted(cells), "cx long, cy long")
    return cl.components(rows, 7).cache()


def inside(rings, x, y):
    """Even-odd rule over all rings of a footprint."""
    odd = False
    for points in rings:
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            if (y0 <= y) != (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) <= x:
                odd = not odd
    return odd


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_polygons_hold_their_cells(spark, seed):
    comp = components(spark, mask(seed))
    own = collections.defaultdict(set)
    for r in comp.collect():
        own[r.component].add((r.cx, r.cy))
    polys = collections.defaultdict(lambda: collections.defaultdict(list))
    numbers = collections.defaultdict(list)
    for r in sorted(fp.polygons(comp, 2.0).collect(), key=lambda r: r.vtx):
        polys[r.fid][r.ring].append((r.x, r.y))
        numbers[r.fid].append((r.vtx, r.ring))
    assert set(polys) == set(own)
    for fid, rings in polys.items():
        assert [v for v, _ in numbers[fid]] == list(range(len(numbers[fid])))
        assert [r for _, r in numbers[fid]] == sorted(r for _, r in numbers[fid])
        area = 0.0
        for ring, points in sorted(rings.items()):
            assert points[0] == points[-1] and min(points) == points[0]
            signed = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) / 2
            assert (signed < 0) == (ring == 0)
            area -= signed
            # Only corners: no vertex lies straight between its neighbours.
            for a, b, c in zip(points, points[1:], points[2:] + points[1:2]):
                assert (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])
        assert area == 4 * len(own[fid])
        for x in range(-4, 25):
            for y in range(-3, 25):
                assert inside(rings.values(), 2 * x + 1, 2 * y + 1) == ((x, y) in own[fid])


def gap(d):
    return max(abs(d) - 0.5, 0)


@pytest.mark.parametrize("seed, fill", [(3, 0.62), (4, 0.93), (5, 1.0)])
def test_depths_are_exact(spark, seed, fill):
    comp = components(spark, mask(seed, fill=fill))
    own = collections.defaultdict(set)
    for r in comp.collect():
        own[r.component].add((r.cx, r.cy))
    rows = fp.depths(comp, 10.0).collect()
    assert len(rows) == comp.count()
    around = [(x, y) for x in range(-5, 27) for y in range(-4, 27)]
    for r in rows:
        far = min((gap(x - r.cx) ** 2 + gap(y - r.cy) ** 2) ** 0.5
                  for x, y in around if (x, y) not in own[r.component])
        assert r.depth == pytest.approx(10 * far, abs=1e-9)


def test_row_blocks_do_not_change_depths(spark, monkeypatch):
    comp = components(spark, mask(6, fill=0.9))
    want = {(r.cx, r.cy): r.depth for r in fp.depths(comp).collect()}
    monkeypatch.setattr(fp, "ROW_BLOCK", 1)
    assert {(r.cx, r.cy): r.depth for r in fp.depths(comp).collect()} == want


def test_shrinking_agrees_with_the_interval_method(spark):
    comp = components(spark, mask(7, fill=0.9))
    for radius in (1.0, 750.0, 1200.0):
        a = {tuple(r) for r in fp.shrink(comp, radius).collect()}
        b = {tuple(r) for r in cl.shrink(comp, radius, keys=["component"]).collect()}
        assert a == b
    rows = fp.survival(comp, 750.0).collect()
    left = collections.Counter(r.component for r in fp.shrink(comp, 750.0).collect())
    assert all(r.n_left == left[r.component] and r.empty == (r.n_left == 0) for r in rows)
    assert sum(r.n_cells for r in rows) == comp.count()


def test_lower_envelope():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sites = np.sort(rng.choice(60, rng.integers(1, 30), replace=False)).astype(float)
        heights = rng.integers(0, 200, len(sites)) / 4
        at = np.sort(rng.integers(-10, 70, 40)).astype(float)
        want = ((at[:, None] - sites[None]) ** 2 + heights[None]).min(axis=1)
        assert np.allclose(fp.lower_envelope(sites, heights, at), want, atol=1e-9)


def test_empty_mask(spark):
    none = spark.createDataFrame([], "cx long, cy long, component long")
    assert fp.polygons(none).collect() == [] and fp.survival(none, 750.0).collect() == []
