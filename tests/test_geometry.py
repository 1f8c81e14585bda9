"""Vertices, masks, spacing and spatial joins against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeline.operators import boundary as bd
from edgeline.operators import cells as cl
from edgeline.operators import leaves
from edgeline.operators import vertices as vx

VERTEX = "fid long, ring int, vtx long, x double, y double"


def vertices(spark, features):
    rows = []
    for fid, rings in features.items():
        i = 0
        for ring, points in enumerate(rings):
            for x, y in points:
                rows.append((fid, ring, i, float(x), float(y)))
                i += 1
    return spark.createDataFrame(rows, VERTEX)


def star(rng, mx, my, size, n=9, snap=None):
    pts = []
    for i in range(n):
        r = size * rng.uniform(0.3, 1.0)
        a = -2 * math.pi * i / n
        pts.append((mx + r * math.cos(a), my + r * math.sin(a)))
    if snap:
        pts = [(round(x / snap) * snap, round(y / snap) * snap) for x, y in pts]
    return pts + pts[:1]


def walk(points, sep):
    """Equal spacing read step by step along one line."""
    cum = [0.0]
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        cum.append(cum[-1] + math.hypot(bx - ax, by - ay))
    n = max(1, math.floor(cum[-1] / sep + 1e-10))
    out = []
    for k in range(n):
        i = sum(c <= k * sep + 1e-6 for c in cum) - 1
        f = (k * sep - cum[i]) / (cum[i + 1] - cum[i])
        (ax, ay), (bx, by) = points[i], points[i + 1]
        out.append((ax + f * (bx - ax), ay + f * (by - ay), math.atan2(ay - by, ax - bx)))
    return out


def test_spacing_reads_like_a_walk(spark, monkeypatch):
    rng = random.Random(4)
    rings = {i: star(rng, 0, 0, 200.0 * (i + 1), snap=1.0) for i in range(12)}
    rings[20] = [(0, 0), (0, 50), (50, 50), (0, 0)]                  # shorter than the spacing
    rings[21] = [(0, 0), (0, 1000), (1000, 1000), (1000, 0), (0, 0)]  # exact multiple
    rings[22] = [(0, 0), (0, 0), (0, 900), (0, 900), (700, 900), (0, 0)]  # repeated vertices
    monkeypatch.setattr(bd, "SEGMENT_BLOCK", 3)
    monkeypatch.setattr(bd, "POINT_BLOCK", 4)
    got = {}
    for r in bd.spaced_points(vertices(spark, {k: [v] for k, v in rings.items()}), 500.0).collect():
        got.setdefault(r.fid, {})[r.transect_id] = (r.x, r.y, r.theta)
    for fid, points in rings.items():
        want = walk(points, 500.0)
        assert sorted(got[fid]) == list(range(1, len(want) + 1))
        for i, w in enumerate(want):
            assert got[fid][i + 1] == pytest.approx(w, abs=1e-5)
    assert len(got[20]) == 1 and len(got[21]) == 8


def test_ring_modes(spark):
    outer = [(0, 0), (0, 2000), (2000, 2000), (2000, 0), (0, 0)]
    hole = [(500, 500), (1500, 500), (1500, 1500), (500, 1500), (500, 500)]
    v = vertices(spark, {1: [outer, hole]})
    assert vx.segments(v, "concat").count() == 9 and vx.segments(v, "per_ring").count() == 8
    got = {r.perimeter for r in vx.perimeters(v, geodesic=False).collect()}
    assert got == {12000.0}


def test_transect_side_and_length(spark):
    point = spark.createDataFrame([(1, 1, 0.0, 0.0, -math.pi / 2)],
                                  "fid long, transect_id long, x double, y double, theta double")
    # Travel is north (theta points back south), so inside lies east, on the right.
    got = {r.pnt_pst: (r.x, r.y) for r in bd.transects(point, 2500.0, 2).collect()}
    assert got[-2] == pytest.approx((5000, 0)) and got[1] == pytest.approx((-2500, 0))
    sets = bd.transects_by_length(point, [(5, 1, 2500.0), (10, 2, 2500.0), (15, 1, 7500.0)])
    assert {(r.length_km, r["count"]) for r in sets.groupBy("length_km").count().collect()} == {
        (5, 3), (10, 5), (15, 3)}


def inside(points, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
            odd = not odd
    return odd


def distance(points, x, y):
    best = math.inf
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = 0 if n == 0 else max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / n))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.mark.parametrize("seed, snap, leaf", [(1, None, None), (2, None, None), (3, 50.0, None),
                                              (4, 100.0, None), (2, None, 300), (4, 100.0, 300)])
def test_spatial_join_equals_theta_join(spark, seed, snap, leaf):
    """Snapped polygons put vertices and borders on cell centres."""
    rng = random.Random(seed)
    shapes = {i: star(rng, rng.uniform(-2e3, 2e3), rng.uniform(-2e3, 2e3), 1500, snap=snap)
              for i in range(8)}
    pts = [(i, rng.uniform(-4e3, 4e3), rng.uniform(-4e3, 4e3)) for i in range(400)]
    if snap:
        pts += [(400 + i, rng.randrange(-80, 80) * 25.0 + 7.0, rng.randrange(-80, 80) * 25.0 + 3.0)
                for i in range(200)]
    df = spark.createDataFrame(pts, "p long, x double, y double")
    v = vertices(spark, {k: [s] for k, s in shapes.items()})
    got = {(r.p, r.pid): (r.inside, r.dist) for r in
           bd.near_or_inside(df, ["p"], v, 120.0, 800.0 if leaf else 200.0,
                             leaf_pairs=leaf).collect()}
    want = {}
    for p, x, y in pts:
        for fid, s in shapes.items():
            d, i = distance(s, x, y), inside(s, x, y)
            if i or d <= 120:
                want[p, fid] = (i or d <= 1e-9, d)
    assert set(got) == set(want)
    for k, (i, d) in want.items():
        assert got[k][0] == i
        if d <= 120:
            assert got[k][1] == pytest.approx(d)


def test_no_leaf_of_a_dense_coast_exceeds_the_bound(spark):
    rng = random.Random(8)
    coast = star(rng, 0, 0, 900, n=600)
    v = vertices(spark, {1: [coast]})
    pts = spark.createDataFrame([(rng.uniform(-900, 900), rng.uniform(-900, 900), 0, 0)
                                 for _ in range(3000)], "px double, py double, cx long, cy long")
    pts = pts.withColumns({c: F.floor(F.col(p) / 2000) for c, p in (("cx", "px"), ("cy", "py"))})
    seg = vx.segments(v, "per_ring")
    content = bd.border_pieces(seg, 2000.0, 20.0).unionByName(
        cl.fill(seg, 2000.0), allowMissingColumns=True)
    p, c = leaves.split(pts, content, "fid", 2000.0, 20.0, 4000)
    cell = ["level", "cx", "cy"]
    n = {tuple(r)[:3]: r["count"] for r in p.groupBy(*cell).count().collect()}
    m = {tuple(r)[:3]: r["count"] for r in c.groupBy(*cell).count().collect()}
    assert sum(n.values()) == 3000 and max(k[0] for k in n) >= 2
    assert max(n[k] * m.get(k, 0) for k in n) <= 4000
    # Every leaf's parity is that of its centre.
    centres = {tuple(r) for r in c.filter("ax IS NULL").select(*cell).collect()}
    for level, cx, cy in {tuple(r) for r in c.select(*cell).distinct().collect()}:
        size = 2000 / 2 ** level
        assert ((level, cx, cy) in centres) == inside(coast, (cx + .5) * size, (cy + .5) * size)


def test_within_distance_keeps_misses(spark):
    box = [(0, 0), (0, 1000), (1000, 1000), (1000, 0), (0, 0)]
    other = [(x + 1600, y) for x, y in box]
    v = vertices(spark, {1: [box], 2: [other]}).withColumn("site_id", F.concat(F.lit("P"), "fid"))
    pts = spark.createDataFrame([(1, 1, 500.0, 500.0), (1, 2, 1300.0, 500.0), (1, 3, 9e4, 0.0)],
                                "fid long, transect_id long, x double, y double")
    m = bd.within_distance(pts, ["fid", "transect_id"], v)
    assert sorted((r.transect_id, r.site_id or "") for r in m.collect()) == [
        (1, "P1"), (2, "P1"), (2, "P2"), (3, "")]
    assert [r.transect_id for r in bd.unique_matches(m, ["fid", "transect_id"]).collect()] == [1]


def test_fill_matches_centre_test(spark):
    rng = random.Random(9)
    shapes = {i: star(rng, 0, 0, 4000, snap=250.0) for i in range(5)}
    got = {(r.fid, r.cx, r.cy) for r in
           cl.rasterise(vertices(spark, {k: [s] for k, s in shapes.items()})).collect()}
    want = {(f, i, j) for f, s in shapes.items() for i in range(-12, 12) for j in range(-12, 12)
            if inside(s, (i + 0.5) * 500, (j + 0.5) * 500)}
    assert got == want


def mask(seed, n=24, fill=0.55):
    rng = np.random.default_rng(seed)
    return {(int(x) - 7, int(y) - 7) for x, y in np.argwhere(rng.random((n, n)) < fill)}


def frame(spark, cells):
    return spark.createDataFrame(sorted(cells), "cx long, cy long")


@pytest.mark.parametrize("seed, tile", [(0, 5), (1, 4), (2, 1024)])
def test_components(spark, seed, tile):
    cells = mask(seed)
    parent = {c: c for c in cells}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for x, y in cells:
        for other in ((x + 1, y), (x, y + 1)):
            if other in cells:
                parent[root((x, y))] = root(other)
    want = {}
    for c in cells:
        want.setdefault(root(c), set()).add(c)
    got = {}
    for r in cl.components(frame(spark, cells), tile).collect():
        got.setdefault(r.component, set()).add((r.cx, r.cy))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_of_tiles(spark):
    """A snake through many tiles settles and keeps one name."""
    cells = {(x, 0) for x in range(120)} | {(119, y) for y in range(60)} | {(x, 59) for x in range(119)}
    got = cl.components(frame(spark, cells), 2)
    assert got.count() == len(cells) and got.select("component").distinct().count() == 1


def test_rings_close_and_keep_the_mask_on_the_right(spark):
    cells = mask(5) | {(40, 40), (41, 41), (40, 41), (42, 41), (41, 40), (42, 42)} - {(41, 41)}
    comp = cl.components(frame(spark, cells), 6)
    rows = cl.trace_rings(comp).collect()
    assert len(rows) == cl.outline(frame(spark, cells)).count()
    rings, area = {}, 0
    for r in rows:
        rings.setdefault(r.ring if r.component is None else (r.component, r.ring), []).append(r)
    for ring in rings.values():
        ring.sort(key=lambda r: r.pos)
        assert [r.pos for r in ring] == list(range(ring[0].n)) or len({r.n for r in ring}) > 1
    by_start = {}
    for r in rows:
        by_start.setdefault((r.component, r.ring, r.n), []).append(r)
    for ring in by_start.values():
        ring.sort(key=lambda r: r.pos)
        pts = [(r.x, r.y) for r in ring]
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            assert abs(ax - bx) + abs(ay - by) == 1
            area += (bx - ax) * (ay + by) / 2      # clockwise area is positive
    assert area == len(cells)


@pytest.mark.parametrize("radius", [400.0, 750.0, 1700.0])
def test_shrink(spark, radius):
    cells = {(x, y) for x in range(14) for y in range(12)} - {(3, 4)} | {(30, y) for y in range(9)}
    gap = lambda d: max(abs(d) - 0.5, 0) * 500

    def near_background(c):
        n = math.ceil(radius / 500) + 1
        return any((c[0] + i, c[1] + j) not in cells and gap(i) ** 2 + gap(j) ** 2 < radius ** 2
                   for i in range(-n, n + 1) for j in range(-n, n + 1))

    got = {(r.cx, r.cy) for r in cl.shrink(frame(spark, cells), radius).collect()}
    assert got == {c for c in cells if not near_background(c)}


def test_owner_and_overlap(spark):
    cells = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 1, 0)], "fid long, cx long, cy long")
    got = {(r.cx, r.cy): r.fid for r in cl.owners(cells, [-F.col("fid")], "fid").collect()}
    assert got == {(0, 0): 2, (1, 0): 2}
    zones = spark.createDataFrame([("b", 0, 0), ("a", 1, 0)], "label string, cx long, cy long")
    best = {r.fid: r.label for r in cl.largest_overlap(cells, zones, "fid", "label").collect()}
    assert best == {1: "b", 2: "a"}                # a tie goes to the smaller label


def test_projections_round_trip(spark):
    df = spark.createDataFrame([(1, 0, i, lon, lat) for i, (lon, lat) in enumerate(
        [(0.0, 0.0), (-179.0, 89.9), (101.1, 16.66), (25.0, -60.0), (10.0, 90.0)])], VERTEX)
    for target in ("cylinder", "mollweide"):
        back = vx.reproject(vx.reproject(df, "lonlat", target), target, "lonlat").collect()
        for a, b in zip(df.collect(), sorted(back, key=lambda r: r.vtx)):
            assert a.y == pytest.approx(b.y, abs=1e-5)
            if abs(a.y) < 89.95:
                assert a.x == pytest.approx(b.x, abs=1e-5)


def test_evaluation_drops_shallow_and_outside(spark):
    big = [(0, 0), (0, 30000), (30000, 30000), (30000, 0), (0, 0)]
    small = [(x / 4 + 50000, y / 4) for x, y in big]
    v = vertices(spark, {1: [big], 2: [small]})
    pts = bd.transects(bd.spaced_points(v, 500.0), 2500.0, 2)
    valid = bd.inner_validity(pts, v, 5500.0)
    kept = bd.drop_bad_transects(pts, valid)
    counts = {r.fid: r["count"] for r in kept.groupBy("fid").count().collect()}
    assert counts.get(2) is None and counts[1] == 240 * 5
