"""Queries for vertices, grid-cell masks, border points and transects."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.functions import geometry as geo
from edgeline.operators import boundary as bd
from edgeline.operators import cells as cl
from edgeline.operators import coverage as cov
from edgeline.operators import snapping
from edgeline.operators import vertices as vx
from edgeline.plans.oracle import VIEWS
from edgeline.plans.registry import query
from edgeline.session import materialise
from edgeline.sources import adapter

SPACING, UNIT, N_SIDE, NEAR = 500.0, 2500.0, 2, 750.0
BUFFER = UNIT * N_SIDE + 500
KEY = ["fid", "transect_id"]
_L, _C = adapter.LATTICE, adapter.LATTICE_COLS

VIEWS["rings"] = f"""
SELECT fid, CAST(v.ring AS INTEGER) AS ring, CAST(v.vtx AS BIGINT) AS vtx, v.x AS x, v.y AS y
FROM (SELECT fid, unnest([
    {{'ring': 0, 'vtx': 0, 'x': mx - hw, 'y': my - hh}},
    {{'ring': 0, 'vtx': 1, 'x': mx - hw, 'y': my + hh}},
    {{'ring': 0, 'vtx': 2, 'x': mx - hw + (fid % 3) * 0.00001::DOUBLE, 'y': my + hh}},
    {{'ring': 0, 'vtx': 3, 'x': mx + hw - hw * 0.3::DOUBLE, 'y': my + hh}},
    {{'ring': 0, 'vtx': 4, 'x': mx + hw, 'y': my + hh - hw * 0.3::DOUBLE}},
    {{'ring': 0, 'vtx': 5, 'x': mx + hw, 'y': my - hh}},
    {{'ring': 0, 'vtx': 6, 'x': mx - hw, 'y': my - hh}},
    {{'ring': 1, 'vtx': 7, 'x': mx - hw * 0.25::DOUBLE, 'y': my - hh * 0.25::DOUBLE}},
    {{'ring': 1, 'vtx': 8, 'x': mx + hw * 0.25::DOUBLE, 'y': my - hh * 0.25::DOUBLE}},
    {{'ring': 1, 'vtx': 9, 'x': mx + hw * 0.25::DOUBLE, 'y': my + hh * 0.25::DOUBLE}},
    {{'ring': 1, 'vtx': 10, 'x': mx - hw * 0.25::DOUBLE, 'y': my + hh * 0.25::DOUBLE}},
    {{'ring': 1, 'vtx': 11, 'x': mx - hw * 0.25::DOUBLE, 'y': my - hh * 0.25::DOUBLE}}]) AS v
  FROM (SELECT s_suppkey AS fid, CAST((s_suppkey % {_C}) * {_L} + {_L // 2} AS DOUBLE) AS mx,
          CAST((s_suppkey // {_C}) * {_L} + {_L // 2} AS DOUBLE) AS my,
          abs(s_acctbal) % 7000.0::DOUBLE + 3500.0::DOUBLE AS hw,
          (abs(s_acctbal) * 3.0::DOUBLE) % 7000.0::DOUBLE + 3500.0::DOUBLE AS hh FROM supplier))
WHERE v.ring = 0 OR fid % 4 = 0"""
VIEWS["polygons"] = """
SELECT * REPLACE (CASE WHEN fid % 13 = 0 THEN x - 4000000.0::DOUBLE ELSE x END AS x),
       'P' || fid AS site_id FROM rings"""
VIEWS["polygon_info"] = """
SELECT 'P' || s_suppkey AS site_id, s_name AS name, abs(s_acctbal) + 200.0 AS gis_area,
       CAST(1950 + s_suppkey % 70 AS INTEGER) AS status_yr FROM supplier"""
VIEWS["segs"] = """
SELECT a.fid, a.vtx AS seg, a.ring, b.ring AS ring_end, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
FROM rings a JOIN rings b ON a.fid = b.fid AND b.vtx = a.vtx + 1"""
VIEWS["site_segs"] = """
SELECT a.fid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
FROM polygons a JOIN polygons b ON a.fid = b.fid AND b.vtx = a.vtx + 1 AND a.ring = b.ring"""
VIEWS["own_segs"] = "SELECT fid, x0, y0, x1, y1 FROM segs WHERE ring = ring_end"
VIEWS["zones"] = f"""
SELECT n_nationkey AS fid, r_name AS label, (n_nationkey % 5) * {adapter.ZONE_STEP} - 10000 AS x0,
       (n_nationkey // 5) * {adapter.ZONE_STEP} - 10000 AS y0,
       (n_nationkey % 5) * {adapter.ZONE_STEP} + {adapter.ZONE_STEP + 10000} AS x1,
       (n_nationkey // 5) * {adapter.ZONE_STEP} + {adapter.ZONE_STEP + 10000} AS y1
FROM nation JOIN region ON n_regionkey = r_regionkey"""
# Mask cells by testing the centres of each footprint's bounding box.
VIEWS["mask"] = """
SELECT c.fid, c.cx, c.cy FROM (
  SELECT fid, unnest(range(CAST(floor(min(x) / 500) AS BIGINT), CAST(ceil(max(x) / 500) AS BIGINT))) AS cx,
         y0, y1 FROM (SELECT fid, x, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM rings
                      WINDOW w AS (PARTITION BY fid)) GROUP BY fid, y0, y1) b,
  LATERAL (SELECT b.fid, b.cx, unnest(range(CAST(floor(b.y0 / 500) AS BIGINT),
                                            CAST(ceil(b.y1 / 500) AS BIGINT))) AS cy) c
JOIN segs s ON s.fid = c.fid AND s.ring = s.ring_end
WHERE (s.y0 <= (c.cy + 0.5::DOUBLE) * 500) <> (s.y1 <= (c.cy + 0.5::DOUBLE) * 500)
  AND s.x0 + ((c.cy + 0.5::DOUBLE) * 500 - s.y0) * (s.x1 - s.x0) / (s.y1 - s.y0)
      <= (c.cx + 0.5::DOUBLE) * 500
GROUP BY ALL HAVING count(*) % 2 = 1"""
VIEWS["union_mask"] = "SELECT DISTINCT cx, cy FROM mask"
VIEWS["zone_cells"] = """
SELECT DISTINCT label, cx, cy FROM (
  SELECT label, cx, unnest(range(CAST(ceil(y0 / 500 - 0.5) AS BIGINT),
                                 CAST(ceil(y1 / 500 - 0.5) AS BIGINT))) AS cy
  FROM (SELECT *, unnest(range(CAST(ceil(x0 / 500 - 0.5) AS BIGINT),
                               CAST(ceil(x1 / 500 - 0.5) AS BIGINT))) AS cx FROM zones))"""


# ---- polygons --------------------------------------------------------------
@query("c01_perimeter_ratio", f"""
SELECT fid, perimeter, perimeter / gis_area AS pa_ratio FROM (
  SELECT fid, sum(2 * {geo.SPHERE} * asin(sqrt(least(1, pow(sin((radians(lat1) - radians(lat0)) / 2), 2)
     + cos(radians(lat0)) * cos(radians(lat1)) * pow(sin((radians(lon1) - radians(lon0)) / 2), 2)))))
     AS perimeter
  FROM ll GROUP BY fid) JOIN (SELECT s_suppkey AS fid, abs(s_acctbal) + 200.0 AS gis_area
                              FROM supplier) USING (fid)""", dbl="perimeter pa_ratio", views={
    "ll": f"""SELECT fid, degrees(x0 / {geo.A * geo.K0}) AS lon0, degrees(x1 / {geo.A * geo.K0}) AS lon1,
  degrees(b0 + {geo.E2 / 3 + 31 * geo.E2**2 / 180 + 517 * geo.E2**3 / 5040} * sin(2 * b0)
    + {23 * geo.E2**2 / 360 + 251 * geo.E2**3 / 3780} * sin(4 * b0)
    + {761 * geo.E2**3 / 45360} * sin(6 * b0)) AS lat0,
  degrees(b1 + {geo.E2 / 3 + 31 * geo.E2**2 / 180 + 517 * geo.E2**3 / 5040} * sin(2 * b1)
    + {23 * geo.E2**2 / 360 + 251 * geo.E2**3 / 3780} * sin(4 * b1)
    + {761 * geo.E2**3 / 45360} * sin(6 * b1)) AS lat1
FROM (SELECT *, asin(y0 * {2 * geo.K0 / (geo.A * geo.QP)}) AS b0,
        asin(y1 * {2 * geo.K0 / (geo.A * geo.QP)}) AS b1 FROM segs WHERE ring = ring_end)"""})
def _(v):
    lonlat = vx.reproject(v.rings(), "cylinder", "lonlat")
    area = v.table("supplier").select(F.col("s_suppkey").alias("fid"),
                                      (F.abs("s_acctbal") + 200.0).alias("gis_area"))
    return (vx.perimeters(lonlat).join(area, "fid")
            .select("fid", "perimeter",
                    F.try_divide(F.col("perimeter"), F.col("gis_area")).alias("pa_ratio")))


_LAT = (f"b + {geo.E2 / 3 + 31 * geo.E2**2 / 180 + 517 * geo.E2**3 / 5040} * sin(2 * b) "
        f"+ {23 * geo.E2**2 / 360 + 251 * geo.E2**3 / 3780} * sin(4 * b) "
        f"+ {761 * geo.E2**3 / 45360} * sin(6 * b)")


@query("c02_reproject", f"""
SELECT fid, vtx, degrees(lon) AS lon, degrees(lat) AS lat,
  lon * cos(th) * {2 * 2 ** 0.5 / 3.141592653589793 * geo.A} AS x,
  sin(th) * {2 ** 0.5 * geo.A} AS y
FROM (SELECT fid, vtx, lon, lat, list_reduce(range(1, 41), lambda t, i:
        t - (t + sin(t) - pi() * sin(lat)) / (1 + cos(t)), lat) / 2 AS th
  FROM (SELECT fid, vtx, x / {geo.A * geo.K0} AS lon, {_LAT} AS lat
        FROM (SELECT *, asin(y * {2 * geo.K0 / (geo.A * geo.QP)}) AS b FROM rings)))""",
       dbl="lon lat x y")
def _(v):
    lonlat = vx.reproject(v.rings(), "cylinder", "lonlat")
    x, y = geo.lonlat_to_mollweide(F.col("x"), F.col("y"))
    return lonlat.select("fid", "vtx", F.col("x").alias("lon"), F.col("y").alias("lat"),
                         x.alias("mx"), y.alias("my")).withColumnsRenamed({"mx": "x", "my": "y"})


@query("c03_snap", """
SELECT fid, ring, row_number() OVER (PARTITION BY fid ORDER BY vtx) - 1 AS vtx, x, y
FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (
        SELECT fid, ring, vtx, round(x * 1000) / 1000 AS x, round(y * 1000) / 1000 AS y FROM rings)
      WINDOW w AS (PARTITION BY fid, ring ORDER BY vtx))
WHERE px IS NULL OR x <> px OR y <> py""", dbl="x y")
def _(v):
    return vx.snap(v.rings(), precision=1e3)


@query("c03_snap_grid", """
SELECT fid, ring, row_number() OVER (PARTITION BY fid ORDER BY vtx) - 1 AS vtx, x, y
FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (
        SELECT fid, ring, vtx, round(round(x / 40) * 40 * 1000) / 1000 AS x,
               round(round(y / 40) * 40 * 1000) / 1000 AS y FROM rings)
      WINDOW w AS (PARTITION BY fid, ring ORDER BY vtx))
WHERE px IS NULL OR x <> px OR y <> py""", dbl="x y")
def _(v):
    return vx.snap(v.rings(), precision=1e3, grid=40.0)


SNAP = 2500.0


@query("c03_snap_neighbours", """
SELECT fid, ring, row_number() OVER (PARTITION BY fid ORDER BY vtx) - 1 AS vtx, x, y
FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (
        SELECT fid, ring, vtx, round(to_x * 1000) / 1000 AS x, round(to_y * 1000) / 1000 AS y
        FROM rings JOIN snapped USING (x, y))
      WINDOW w AS (PARTITION BY fid, ring ORDER BY vtx))
WHERE px IS NULL OR x <> px OR y <> py""", dbl="x y", views={
    "places": "SELECT x, y, row_number() OVER (ORDER BY x, y) AS id FROM (SELECT DISTINCT x, y FROM rings)",
    "snap_roots": f"""
WITH RECURSIVE near AS MATERIALIZED (
  SELECT a.id AS i, b.id AS j FROM places a JOIN places b ON a.id <> b.id
   AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {SNAP * SNAP}),
found(id, root) USING KEY (id) AS (
  SELECT id, id FROM places
  UNION
  SELECT n.j, min(f.root) FROM found f JOIN near n ON n.i = f.id
    JOIN recurring.found g ON g.id = n.j WHERE f.root < g.root GROUP BY n.j)
SELECT id, root FROM found""",
    "snapped": """
SELECT p.x, p.y, q.x AS to_x, q.y AS to_y
FROM places p JOIN snap_roots USING (id) JOIN places q ON q.id = root"""})
def _(v):
    return vx.snap(snapping.snap_neighbours(v.rings(), SNAP), precision=1e3)


# ---- masks -----------------------------------------------------------------
@query("c04_erase_overlaps", """
SELECT cx, cy, fid FROM (SELECT *, row_number() OVER (
  PARTITION BY cx, cy ORDER BY 1950 + fid % 70, fid) AS r FROM mask) WHERE r = 1""")
def _(v):
    year = (1950 + F.col("fid") % 70).alias("status_yr")
    return cl.owners(cl.rasterise(v.rings()), [year], "fid")


@query("c05_rasterise", "SELECT cx, cy, min(fid) AS value FROM mask GROUP BY cx, cy")
def _(v):
    cells = cl.rasterise(v.rings())
    return cl.first_value(cells.withColumn("pa_def", F.col("fid")), "pa_def")


_FOCAL = {"focal": """
SELECT * FROM (SELECT m.cx + d.dx AS cx, m.cy + e.dy AS cy, count(*) AS value
  FROM union_mask m, (SELECT unnest([-1, 0, 1]) AS dx) d, (SELECT unnest([-1, 0, 1]) AS dy) e
  GROUP BY ALL)
WHERE cx > (SELECT min(cx) FROM union_mask) AND cx < (SELECT max(cx) FROM union_mask)
  AND cy > (SELECT min(cy) FROM union_mask) AND cy < (SELECT max(cy) FROM union_mask)"""}


def union_mask(v):
    cells = materialise(cl.rasterise(v.rings()).select("cx", "cy"), "mask-cells")
    return materialise(cl.distinct_cells(cells, cells.count()), "union-mask").withColumn(
        "value", F.lit(1).cast("long"))


def filled_mask(v):
    return materialise(cl.reclassify_mask(cl.focal_sum(union_mask(v))).select("cx", "cy"),
                       "filled-mask")


@query("c06_focal_sum", "SELECT * FROM focal", views=_FOCAL)
def _(v):
    return cl.focal_sum(union_mask(v))


@query("c07_reclassify", "SELECT cx, cy, CAST(1 AS INTEGER) AS value FROM focal WHERE value > 0",
       views=_FOCAL)
def _(v):
    return cl.reclassify_mask(cl.focal_sum(union_mask(v)))


@query("c08_outline", """
SELECT cx + ax AS x0, cy + ay AS y0, cx + bx AS x1, cy + bz AS y1
FROM focal f, (VALUES (-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0),
                      (0, -1, 1, 0, 0, 0)) s(dx, dy, ax, ay, bx, bz)
WHERE (f.cx + s.dx, f.cy + s.dy) NOT IN (SELECT (cx, cy) FROM focal)""", views=_FOCAL)
def _(v):
    return cl.outline(filled_mask(v))


@query("c08_ring_vertices", """
SELECT cx + ax AS x, cy + ay AS y
FROM focal f, (VALUES (-1, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (0, -1, 1, 0)) s(dx, dy, ax, ay)
WHERE (f.cx + s.dx, f.cy + s.dy) NOT IN (SELECT (cx, cy) FROM focal)""", views=_FOCAL)
def _(v):
    return cl.trace_rings(materialise(cl.components(filled_mask(v)), "components")).select("x", "y")


@query("c09_shrink", """
SELECT cx, cy FROM focal f WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)
  WHERE (f.cx + dx, f.cy + dy) NOT IN (SELECT (cx, cy) FROM focal))""", views=_FOCAL)
def _(v):
    return cl.shrink(filled_mask(v), 750.0)


def zone_cells(v):
    return cl.dissolve(cl.rasterise(v.zones(), carry=["label"]), "label")


@query("c10_dissolve", "SELECT label, count(*) AS n_cells, sum(cx) AS sx, sum(cy) AS sy FROM zone_cells GROUP BY 1",
       ints="sx sy")
def _(v):
    return zone_cells(v).groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"),
                                              F.sum("cx").alias("sx"), F.sum("cy").alias("sy"))


@query("c11_largest_overlap", """
SELECT m.fid, b.label, b.n AS n_cells FROM (SELECT DISTINCT fid FROM mask) m
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY n DESC, label) AS r
           FROM (SELECT fid, label, count(*) AS n FROM mask JOIN zone_cells USING (cx, cy)
                 GROUP BY ALL)) b ON m.fid = b.fid AND b.r = 1""")
def _(v):
    return cl.largest_overlap(cl.rasterise(v.rings()), zone_cells(v), "fid", "label")


# Covered area of a cell: along each border segment the distance to the cell's right edge,
# cut to the cell, summed by its antiderivative over the segment's part in the cell's row.
_G = lambda u: f"(CASE WHEN {u} <= 0 THEN 0 WHEN {u} >= 500 THEN 500 * {u} - 125000 ELSE {u} * {u} / 2 END)"
_COVERED = {
    "row_parts": """
SELECT fid, cy, x0 + (ya - y0) * (x1 - x0) / (y1 - y0) AS xa, x0 + (yb - y0) * (x1 - x0) / (y1 - y0) AS xb,
       yb - ya AS rise, c0, c1
FROM (SELECT *, least(greatest(y0, cy * 500::DOUBLE), (cy + 1) * 500::DOUBLE) AS ya,
        least(greatest(y1, cy * 500::DOUBLE), (cy + 1) * 500::DOUBLE) AS yb
      FROM (SELECT *, unnest(range(CAST(floor(least(y0, y1) / 500) AS BIGINT),
                                   CAST(floor(greatest(y0, y1) / 500) AS BIGINT) + 1)) AS cy
            FROM own_segs JOIN (SELECT fid, CAST(floor(min(x) / 500) AS BIGINT) AS c0,
                                  CAST(floor(max(x) / 500) AS BIGINT) AS c1 FROM rings GROUP BY fid)
              USING (fid) WHERE y0 <> y1))
WHERE ya <> yb""",
    "covered": f"""
SELECT fid, cx, cy, sum(CASE WHEN abs(u1 - u0) < 1e-6
    THEN rise * least(greatest((u0 + u1) / 2, 0), 500) ELSE rise * ({_G('u1')} - {_G('u0')}) / (u1 - u0) END) AS area
FROM (SELECT fid, cy, cx, rise, (cx + 1) * 500 - xa AS u0, (cx + 1) * 500 - xb AS u1
      FROM (SELECT *, unnest(range(c0, c1 + 1)) AS cx FROM row_parts))
GROUP BY ALL HAVING area > 1e-3"""}


@query("c11_covered_area", """
SELECT fid, count(*) AS n_cells, sum(area) / 1e6 AS covered_km2, s.km2 AS shoelace_km2
FROM covered JOIN (SELECT fid, sum(y1 * x0 - x1 * y0) / -2e6 AS km2 FROM own_segs GROUP BY fid) s USING (fid)
GROUP BY fid, s.km2""", dbl="covered_km2 shoelace_km2", views=_COVERED)
def _(v):
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    shoelace = vx.segments(v.rings()).groupBy("fid").agg((F.sum(cross) / -2e6).alias("shoelace_km2"))
    covered = cov.coverage(v.rings()).filter("area > 1e-3").groupBy("fid").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.sum("area") / 1e6).alias("covered_km2"))
    return covered.join(shoelace, "fid")


@query("c11_largest_overlap_area", """
SELECT t.fid, b.label, b.o / 1e6 AS overlap_km2, t.a / 1e6 AS total_km2
FROM (SELECT fid, sum(area) AS a FROM covered GROUP BY fid) t
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY round(o * 1e6) DESC, label) AS r
           FROM (SELECT fid, label, sum(area) AS o FROM covered JOIN zone_cells USING (cx, cy)
                 GROUP BY ALL)) b ON t.fid = b.fid AND b.r = 1""",
       dbl="overlap_km2 total_km2", views=_COVERED)
def _(v):
    return cov.largest_overlap(cov.coverage(v.rings()), zone_cells(v)).select(
        "fid", "label", (F.col("overlap") / 1e6).alias("overlap_km2"),
        (F.col("total") / 1e6).alias("total_km2"))


@query("c12_segments", "SELECT fid, seg, ring, x0, y0, x1, y1 FROM segs", dbl="x0 y0 x1 y1")
def _(v):
    return vx.segments(v.rings(), "concat")


# ---- border points and transects -------------------------------------------
VIEWS["runs"] = """
SELECT *, round(upto - len, 6) AS c0, round(upto, 6) AS c1 FROM (
  SELECT *, sum(len) OVER (PARTITION BY fid ORDER BY seg) AS upto,
         round(sum(len) OVER (PARTITION BY fid), 6) AS total
  FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM segs))"""
VIEWS["spaced"] = """
SELECT r.fid, n.k + 1 AS transect_id, x0 + (n.k * 500.0::DOUBLE - c0) / (c1 - c0) * (x1 - x0) AS x,
       y0 + (n.k * 500.0::DOUBLE - c0) / (c1 - c0) * (y1 - y0) AS y, atan2(y0 - y1, x0 - x1) AS theta
FROM (SELECT fid, unnest(range(0, CAST(greatest(1, floor(max(total) / 500 + 1e-10)) AS BIGINT))) AS k
      FROM runs GROUP BY fid) n
JOIN runs r ON r.fid = n.fid AND r.c0 <= n.k * 500.0::DOUBLE AND n.k * 500.0::DOUBLE < r.c1"""
VIEWS["tpoints"] = """
SELECT fid, transect_id, CAST(p AS INTEGER) AS pnt_pst,
       x - p * 2500.0::DOUBLE * cos(theta + pi() / 2) AS x,
       y - p * 2500.0::DOUBLE * sin(theta + pi() / 2) AS y
FROM spaced, (SELECT unnest(range(-2, 3)) AS p)"""


def border_points(v):
    return bd.spaced_points(v.rings(), SPACING)


def transect_points(v):
    return bd.transects(border_points(v), UNIT, N_SIDE)


@query("c13_spaced_points", "SELECT * FROM spaced", dbl="x y theta")
def _(v):
    return border_points(v)


@query("c14_transects", "SELECT * FROM tpoints", dbl="x y")
def _(v):
    return transect_points(v)


# The plain theta joins: every point against every segment of every polygon.
def _theta(points: str, segs: str, on: str = "true") -> str:
    return f"""
SELECT fid, transect_id, pnt_pst, gid,
  sum(CASE WHEN (y0 <= y) <> (y1 <= y) AND x0 + (y - y0) * (x1 - x0) / (y1 - y0) <= x
           THEN 1 ELSE 0 END) % 2 = 1 AS odd,
  min(sqrt(pow(x - x0 - t * (x1 - x0), 2) + pow(y - y0 - t * (y1 - y0), 2))) AS dist
FROM (SELECT p.fid, p.transect_id, p.pnt_pst, p.x, p.y, g.gid, g.x0, g.y0, g.x1, g.y1,
        coalesce(greatest(0, least(1, ((p.x - g.x0) * (g.x1 - g.x0) + (p.y - g.y0) * (g.y1 - g.y0))
          / nullif((g.x1 - g.x0) * (g.x1 - g.x0) + (g.y1 - g.y0) * (g.y1 - g.y0), 0))), 0) AS t
      FROM {points} p JOIN (SELECT fid AS gid, x0, y0, x1, y1 FROM {segs}) g ON {on})
GROUP BY ALL"""


def _matches(points: str) -> str:
    return f"""
SELECT p.fid, p.transect_id, h.site_id FROM (SELECT * FROM {points} WHERE pnt_pst = 0) p
LEFT JOIN (SELECT DISTINCT fid, transect_id, 'P' || gid AS site_id
           FROM ({_theta(f'(SELECT * FROM {points} WHERE pnt_pst = 0)', 'site_segs')})
           WHERE odd OR dist <= 750) h USING (fid, transect_id)"""


VIEWS["raw_matches"] = _matches("tpoints")
VIEWS["inner_hits"] = _theta("(SELECT * FROM tpoints WHERE pnt_pst < 0)", "own_segs", "g.gid = p.fid")
# A cell survives the inner buffer when no background cell lies within the distance.
VIEWS["cores"] = f"""
SELECT DISTINCT m.fid FROM mask m WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(range(-12, 13)) AS dx), (SELECT unnest(range(-12, 13)) AS dy)
  WHERE pow(greatest(abs(dx) - 0.5::DOUBLE, 0) * 500, 2)
      + pow(greatest(abs(dy) - 0.5::DOUBLE, 0) * 500, 2) < pow({BUFFER}, 2)
    AND (m.fid, m.cx + dx, m.cy + dy) NOT IN (SELECT (fid, cx, cy) FROM mask))"""
VIEWS["validity"] = f"""
SELECT h.fid, h.transect_id, h.pnt_pst,
  c.fid IS NOT NULL AND NOT ((odd OR dist <= 1e-9) AND dist >= {BUFFER}) AS inner_valid,
  c.fid IS NOT NULL AND (odd OR dist <= 1e-9) AS boundary_valid
FROM inner_hits h LEFT JOIN cores c USING (fid)"""
VIEWS["good_points"] = """
SELECT * FROM tpoints WHERE (fid, transect_id) NOT IN (
  SELECT (fid, transect_id) FROM validity WHERE NOT (inner_valid AND boundary_valid))"""
VIEWS["matches"] = _matches("good_points")
VIEWS["single"] = """
SELECT fid, transect_id, max(site_id) AS site_id FROM matches GROUP BY 1, 2 HAVING count(*) = 1"""
VIEWS["kept"] = """
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY fid, transect_id) AS site_transect
FROM single WHERE site_id IS NOT NULL"""


def border_only(points):
    return points.filter(F.col("pnt_pst") == 0)


#: Pairs of a point and a border piece that may meet in one leaf of the grid.
LEAF_PAIRS = 20_000


def raw_matches(v):
    points = materialise(border_only(transect_points(v)), "border_points")
    return bd.within_distance(points, KEY, v.polygons(), NEAR)


def stored_points(v):
    """Transect points, written once for the several evaluation steps."""
    return materialise(transect_points(v), "transect_points")


def good_points(v):
    points = stored_points(v)
    return bd.drop_bad_transects(points, bd.inner_validity(points, v.rings(), BUFFER))


def matches(v):
    points = materialise(border_only(good_points(v)), "good_border_points")
    return bd.within_distance(points, KEY, v.polygons(), NEAR)


def kept(v):
    return bd.renumber(bd.unique_matches(matches(v), KEY))


@query("c15_transects_per_site", """
SELECT site_id, count(*) AS ntrsct FROM raw_matches WHERE site_id IS NOT NULL GROUP BY 1""")
def _(v):
    return (raw_matches(v).filter(F.col("site_id").isNotNull()).groupBy("site_id")
            .agg(F.count(F.lit(1)).alias("ntrsct")))


@query("c16_within_distance", "SELECT * FROM raw_matches")
def _(v):
    return raw_matches(v)


@query("c16_within_distance_by_leaves", "SELECT * FROM raw_matches")
def _(v):
    points = materialise(border_only(transect_points(v)), "border_points")
    return bd.within_distance(points, KEY, v.polygons(), NEAR, leaf_pairs=LEAF_PAIRS)


@query("c17_inner_buffer", "SELECT fid, transect_id, pnt_pst, inner_valid FROM validity")
def _(v):
    return bd.inner_validity(stored_points(v), v.rings(), BUFFER).drop("boundary_valid")


@query("c18_inside_own", """
SELECT fid, transect_id, pnt_pst, odd OR dist <= 1e-9 AS inside FROM inner_hits""")
def _(v):
    key = [*KEY, "pnt_pst"]
    inner = stored_points(v).filter(F.col("pnt_pst") < 0)
    hits = bd.near_or_inside(inner, key, v.rings(), 0.0, 2000.0, own=True)
    return inner.select(*key).join(hits.select(*key, "inside"), key, "left").na.fill(False)


@query("c19_good_transects", "SELECT * FROM good_points", dbl="x y")
def _(v):
    return good_points(v)


@query("c20_ambiguous_removed", "SELECT * FROM single")
def _(v):
    return bd.ambiguous_removed(matches(v), KEY)


@query("c21_unmatched_removed", "SELECT * FROM single WHERE site_id IS NOT NULL")
def _(v):
    return bd.unmatched_removed(bd.ambiguous_removed(matches(v), KEY))


@query("c22_renumber", "SELECT * FROM kept")
def _(v):
    return kept(v)


@query("c23_annotated_points", """
SELECT k.site_id, k.site_transect, g.pnt_pst, g.x, g.y, i.name, i.gis_area, i.status_yr
FROM good_points g JOIN kept k USING (fid, transect_id) JOIN polygon_info i USING (site_id)""",
       dbl="x y gis_area")
def _(v):
    points = materialise(good_points(v), "good_points")
    border = bd.within_distance(border_only(points), KEY, v.polygons(), NEAR)
    numbered = bd.renumber(bd.unique_matches(border, KEY))
    return bd.annotate(points, numbered, v.polygon_info()).drop("fid", "transect_id")


@query("c24_transects_by_length", f"""
SELECT s.fid, s.transect_id, l.length_km, CAST(p AS INTEGER) AS pnt_pst,
       s.x - p * l.unit * cos(theta + pi() / 2) AS x, s.y - p * l.unit * sin(theta + pi() / 2) AS y
FROM spaced s, (VALUES (5, 1, 2500.0::DOUBLE), (10, 2, 2500.0::DOUBLE), (15, 1, 7500.0::DOUBLE))
       l(length_km, n_side, unit), (SELECT unnest(range(-2, 3)) AS p)
WHERE abs(p) <= n_side""", dbl="x y")
def _(v):
    return bd.transects_by_length(border_points(v), adapter.LENGTHS)
