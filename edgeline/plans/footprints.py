"""Queries for footprints: components, rings, polygons, their points, and inner buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.operators import boundary as bd
from edgeline.operators import cells as cl
from edgeline.operators import footprints as fp
from edgeline.operators import vertices as vx
from edgeline.plans.borders import _FOCAL, SPACING, filled_mask
from edgeline.plans.registry import query
from edgeline.session import materialise

# Components of unbroken row runs: labels spread between touching runs until none falls.
_VIEWS = dict(_FOCAL)
_VIEWS["mask_runs"] = """
SELECT cy, min(cx) AS a, max(cx) AS b, cy * 4294967296 + min(cx) + 2147483648 AS id
FROM (SELECT cx, cy, cx - row_number() OVER (PARTITION BY cy ORDER BY cx) AS g FROM focal)
GROUP BY cy, g"""
_VIEWS["run_labels"] = """
WITH RECURSIVE touch AS MATERIALIZED (
  SELECT p.id AS i, q.id AS j FROM mask_runs p JOIN mask_runs q
    ON abs(p.cy - q.cy) = 1 AND p.a <= q.b AND p.b >= q.a),
found(id, label) USING KEY (id) AS (
  SELECT id, id FROM mask_runs
  UNION
  SELECT t.j, min(f.label) FROM found f JOIN touch t ON t.i = f.id
    JOIN recurring.found g ON g.id = t.j
  WHERE f.label < g.label GROUP BY t.j)
SELECT id, label FROM found"""
_VIEWS["mask_components"] = """
SELECT unnest(range(a, b + 1)) AS cx, r.cy, l.label AS component
FROM mask_runs r JOIN run_labels l USING (id)"""
# Rings: a key per side in the order (x0, y0, x1, y1), its follower, a walk from each ring's first.
_VIEWS["comp_sides"] = """
SELECT c.component, cx + ax AS x0, cy + ay AS y0, cx + bx AS x1, cy + bz AS y1,
  (cx + ax + 1048576) * 8388608 + (cy + ay + 1048576) * 4 + d AS k
FROM mask_components c, (VALUES (-1, 0, 0, 0, 0, 1, 2), (0, 1, 0, 1, 1, 1, 3),
                                (1, 0, 1, 1, 1, 0, 1), (0, -1, 1, 0, 0, 0, 0))
  s(dx, dy, ax, ay, bx, bz, d)
WHERE (c.cx + s.dx, c.cy + s.dy) NOT IN (SELECT (cx, cy) FROM focal)"""
_VIEWS["followers"] = """
SELECT k, min_by(nk, turn) AS nk, min(turn) <> 0 AS turns FROM (
  SELECT s.k, t.k AS nk, (s.x1 - s.x0) * (t.y1 - t.y0) - (s.y1 - s.y0) * (t.x1 - t.x0) AS turn
  FROM comp_sides s JOIN comp_sides t
    ON s.component = t.component AND s.x1 = t.x0 AND s.y1 = t.y0)
GROUP BY k"""
_VIEWS["ring_names"] = """
WITH RECURSIVE named(k, low) USING KEY (k) AS (
  SELECT k, k FROM followers
  UNION
  SELECT f.nk, n.low FROM named n JOIN followers f USING (k)
    JOIN recurring.named g ON g.k = f.nk
  WHERE n.low < g.low)
SELECT k, low FROM named"""
_VIEWS["ring_walk"] = """
WITH RECURSIVE walk(low, pos, k) AS (
  SELECT low, CAST(0 AS BIGINT), k FROM ring_names WHERE k = low
  UNION ALL
  SELECT w.low, w.pos + 1, f.nk FROM walk w JOIN followers f USING (k) WHERE f.nk <> w.low)
SELECT low, pos, k FROM walk"""
_VIEWS["ring_order"] = """
SELECT s.component, w.low, w.pos, s.x0 AS x, s.y0 AS y, s.x1, s.y1, f.turns,
  min_by(s.y0 * 4294967296 + s.x0 + 2147483648, w.k) OVER (PARTITION BY w.low) AS ring,
  count(*) OVER (PARTITION BY w.low) AS n
FROM ring_walk w JOIN comp_sides s USING (k) JOIN followers f USING (k)"""
_VIEWS["ring_list"] = """
SELECT component, low, sum(x * y1 - x1 * y) AS area2,
  row_number() OVER (PARTITION BY component ORDER BY sum(x * y1 - x1 * y) > 0, any_value(ring)) - 1
    AS number
FROM ring_order GROUP BY component, low"""
_VIEWS["fp_vertices"] = """
SELECT component AS fid, CAST(number AS INTEGER) AS ring, x * 500.0::DOUBLE AS x, y * 500.0::DOUBLE AS y,
  row_number() OVER (PARTITION BY component ORDER BY number, place) - 1 AS vtx
FROM (SELECT component, low, x, y, pos AS place FROM (
        SELECT *, lag(turns) OVER (PARTITION BY low ORDER BY pos) AS came FROM ring_order)
      WHERE coalesce(came, true)
      UNION ALL SELECT component, low, x, y, n FROM ring_order WHERE pos = 0)
JOIN ring_list USING (component, low)"""
_VIEWS["fp_segments"] = """
SELECT a.fid, a.vtx AS seg, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
  sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
FROM fp_vertices a JOIN fp_vertices b ON a.fid = b.fid AND b.vtx = a.vtx + 1"""
_VIEWS["fp_runs"] = """
SELECT *, round(upto - len, 6) AS c0, round(upto, 6) AS c1 FROM (
  SELECT *, sum(len) OVER (PARTITION BY fid ORDER BY seg) AS upto,
         round(sum(len) OVER (PARTITION BY fid), 6) AS total FROM fp_segments)"""
_VIEWS["fp_spaced"] = f"""
SELECT r.fid, n.k + 1 AS transect_id, x0 + (n.k * {SPACING}::DOUBLE - c0) / (c1 - c0) * (x1 - x0) AS x,
       y0 + (n.k * {SPACING}::DOUBLE - c0) / (c1 - c0) * (y1 - y0) AS y
FROM (SELECT fid, unnest(range(0, CAST(greatest(1, floor(max(total) / {SPACING} + 1e-10)) AS BIGINT))) AS k
      FROM fp_runs GROUP BY fid) n
JOIN fp_runs r ON r.fid = n.fid AND r.c0 <= n.k * {SPACING}::DOUBLE AND n.k * {SPACING}::DOUBLE < r.c1"""


def _left_view(radius: float) -> str:
    """Cells of a footprint without a cell of anything else nearer than the radius."""
    n = int(radius / 500.0 + 1.5)
    return f"""
SELECT c.component, c.cx, c.cy FROM mask_components c WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(range({-n}, {n + 1})) AS dx), (SELECT unnest(range({-n}, {n + 1})) AS dy)
  WHERE pow(greatest(abs(dx) - 0.5::DOUBLE, 0) * 500, 2)
      + pow(greatest(abs(dy) - 0.5::DOUBLE, 0) * 500, 2) < pow({radius}, 2)
    AND (c.component, c.cx + dx, c.cy + dy) NOT IN (SELECT (component, cx, cy) FROM mask_components))"""


SHRINK, DEEP = 750.0, 3600.0


def components(v):
    return materialise(cl.components(filled_mask(v)), "components")


def footprint_vertices(v):
    return materialise(fp.polygons(components(v)), "footprint-vertices")


@query("c08_components", "SELECT cx, cy, component FROM mask_components", views=_VIEWS)
def _(v):
    return cl.components(filled_mask(v))


@query("c08_rings", "SELECT component, ring, pos, x, y, n FROM ring_order", views=_VIEWS)
def _(v):
    return cl.trace_rings(components(v))


@query("c08_ring_areas", """
SELECT component, CAST(number AS INTEGER) AS ring, area2, area2 > 0 AS hole FROM ring_list""",
       ints="area2", views=_VIEWS)
def _(v):
    return fp.rings(cl.ring_runs(components(v))).select("component", "ring", "area2", "hole")


@query("c12_footprint_vertices", "SELECT fid, ring, vtx, x, y FROM fp_vertices", dbl="x y", views=_VIEWS)
def _(v):
    return footprint_vertices(v)


@query("c12_footprint_points", """
SELECT s.fid, s.rings, s.vertices, s.vx, s.vy, p.n_points, p.px, p.py FROM (
  SELECT fid, count(DISTINCT ring) AS rings, count(*) AS vertices, sum(x) AS vx, sum(y) AS vy
  FROM fp_vertices GROUP BY fid) s
JOIN (SELECT fid, count(*) AS n_points, sum(x) AS px, sum(y) AS py FROM fp_spaced GROUP BY fid) p
  USING (fid)""", dbl="vx vy px py", views=_VIEWS)
def _(v):
    """From registry polygons over mask, components and rings to spaced border points."""
    vertices = footprint_vertices(v)
    corners = vertices.groupBy("fid").agg(
        (F.max("ring") + 1).cast("long").alias("rings"), F.count(F.lit(1)).alias("vertices"),
        F.sum("x").alias("vx"), F.sum("y").alias("vy"))
    points = bd.spaced_points(vertices, SPACING).groupBy("fid").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("x").alias("px"), F.sum("y").alias("py"))
    return corners.join(points, "fid")


@query("c12_footprint_perimeter", """
SELECT fid, sum(len) AS perimeter FROM (
  SELECT a.fid, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
  FROM fp_vertices a JOIN fp_vertices b ON a.fid = b.fid AND a.ring = b.ring AND b.vtx = a.vtx + 1)
GROUP BY fid""", dbl="perimeter", views=_VIEWS)
def _(v):
    return vx.perimeters(footprint_vertices(v), geodesic=False)


@query("c09_footprint_survival", """
SELECT c.component, count(*) AS n_cells, count(l.cx) AS n_left, count(l.cx) = 0 AS empty
FROM mask_components c LEFT JOIN left_cells l USING (component, cx, cy) GROUP BY 1""",
       views={**_VIEWS, "left_cells": _left_view(DEEP)})
def _(v):
    return fp.survival(components(v), DEEP).drop("deepest")


@query("c09_footprint_shrink", "SELECT component, cx, cy FROM left_cells",
       views={**_VIEWS, "left_cells": _left_view(SHRINK)})
def _(v):
    return fp.shrink(components(v), SHRINK)
