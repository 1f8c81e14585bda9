"""Queries for water masking, composites, gradients and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.operators import imagery as im
from edgeline.plans.oracle import VIEWS
from edgeline.plans.registry import query
from edgeline.session import materialise, scratch_path
from edgeline.sources import adapter
from edgeline.sources import tables as tb

POINT = ["site_id", "transect_id", "pnt_pst"]
RES = {"MODIS": 500.0, "LANDSAT": 30.0}
BOX = (0.0, 0.0, 4000.0, 3000.0)
YEARS = (2018, 2019, 2020)
MODIS = {"MODIS": RES["MODIS"]}
RADIUS = 3


def _bands(offset: int) -> str:
    return "[" + ", ".join(
        f"CAST(embedding[{k + offset}] AS DOUBLE) + 1.0::DOUBLE "
        f"+ ((vec_id * 7 + y * 13 + {k * 5}) % 11) * 0.02::DOUBLE" for k in range(1, 8)) + "]"


VIEWS["scenes"] = f"""
SELECT make_date(y, (vec_id % 4) * 3 + 1, 15) AS date, (vec_id // 4) % 16 AS cx,
       (vec_id // 4) // 16 AS cy, 'LANDSAT' AS sensor, {_bands(7)} AS bands
FROM embeddings, (SELECT unnest([2018, 2019, 2020]) AS y)
UNION ALL
SELECT make_date(y, (vec_id % 4) * 3 + 1, 15), (vec_id // 4) % 16, (vec_id // 4) // 16, 'MODIS',
       {_bands(0)} FROM embeddings, (SELECT unnest([2018, 2019, 2020]) AS y)"""
VIEWS["water"] = """
SELECT vec_id % 20 AS px, vec_id // 20 AS py, CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END AS max_extent
FROM embeddings"""
VIEWS["land"] = f"""
SELECT * FROM points WHERE (CAST(floor(x / {adapter.WATER_RES}) AS BIGINT),
                            CAST(floor(y / {adapter.WATER_RES}) AS BIGINT)) IN (
  SELECT (px, py) FROM (SELECT px, py, max(max_extent) AS e FROM water GROUP BY ALL) WHERE e = 0)"""
_MED = ", ".join(f"median(bands[{i}]) AS m{i}" for i in range(1, 8))
VIEWS["composite"] = f"""
SELECT sensor, CAST(year(date) AS INTEGER) AS year, cx, cy, {_MED} FROM scenes GROUP BY ALL"""
_UNIT = ", ".join(f"m{i} / sqrt({' + '.join(f'm{k} * m{k}' for k in range(1, 8))}) AS u{i}"
                  for i in range(1, 8))
_DOT = " + ".join(f"a.u{i} * b.u{i}" for i in range(1, 8))


def _angle(dot: str) -> str:
    return f"acos(greatest(-1, least(1, {dot})))"


VIEWS["units"] = f"SELECT sensor, year, cx, cy, {_UNIT} FROM composite"
VIEWS["gradient"] = f"""
SELECT t.sensor, t.year, t.cx, t.cy, 100 * {_angle(_DOT)} AS gradient FROM (
  SELECT sensor, year, cx, cy, arg_max((mx, my), (total, -my, -mx)) AS dil,
         arg_min((mx, my), (total, my, mx)) AS ero FROM (
    SELECT c.sensor, c.year, c.cx, c.cy, a.cx AS mx, a.cy AS my,
           round(sum(CASE WHEN a.cx = b.cx AND a.cy = b.cy THEN 0
                     ELSE {_angle(_DOT)} END), 9) AS total
    FROM units c
    JOIN units a ON a.sensor = c.sensor AND a.year = c.year AND abs(a.cx - c.cx) <= 3
      AND abs(a.cy - c.cy) <= 3
    JOIN units b ON b.sensor = c.sensor AND b.year = c.year AND abs(b.cx - c.cx) <= 3
      AND abs(b.cy - c.cy) <= 3
    GROUP BY ALL) GROUP BY ALL) t
JOIN units a ON a.sensor = t.sensor AND a.year = t.year AND (a.cx, a.cy) = t.dil
JOIN units b ON b.sensor = t.sensor AND b.year = t.year AND (b.cx, b.cy) = t.ero"""


def composite(v, first: int = YEARS[0], last: int = YEARS[-1]):
    return im.yearly_median(im.select_scenes(v.scenes(), first, last))


def gradient(v, res: dict[str, float] = RES, year: int | None = None, box=None):
    """Gradient of the sensors in ``res``, of one year and inside a box where named.

    Scenes outside are left out before the median: the years exactly, the box with the
    neighbours its cells need (and one cell for rounding) and exactly afterwards.
    """
    rows = composite(v) if year is None else composite(v, year, year)
    rows = rows.filter(F.col("sensor").isin(list(res)))
    if box is None:
        return im.spectral_gradient(rows, RADIUS)
    near = im.clip_to_box(rows, box, res, margin=RADIUS + 1)
    return im.clip_to_box(im.spectral_gradient(near, RADIUS), box, res)


def sampled(v, points, years=YEARS):
    """Yearly gradient at the points; the stack is written once."""
    year = years[0] if len(years) == 1 else None
    stack = materialise(gradient(v, MODIS, year), "gradient")
    return im.sample_years(points, stack, POINT, years, MODIS).drop("sensor")


def land(v):
    return im.land_points(v.points(), v.water(), POINT, adapter.WATER_RES)


@query("d01_land_points", "SELECT * FROM land", dbl="x y")
def _(v):
    return land(v)


@query("d02_scene_selection", """
SELECT date, CAST(year(date) AS INTEGER) AS year, cx, cy, sensor, bands[1] AS first_band,
       bands[7] AS last_band FROM scenes WHERE year(date) IN (2019, 2020)""",
       dbl="first_band last_band")
def _(v):
    rows = im.select_scenes(v.scenes(), 2019, 2020)
    return rows.select("date", "year", "cx", "cy", "sensor", F.col("bands")[0].alias("first_band"),
                       F.col("bands")[6].alias("last_band"))


@query("d03_yearly_median", "SELECT * FROM composite", dbl="m1 m2 m3 m4 m5 m6 m7")
def _(v):
    return composite(v).select("sensor", "year", "cx", "cy",
                               *[F.col("bands")[i].alias(f"m{i + 1}") for i in range(7)])


@query("d04_spectral_gradient", "SELECT * FROM gradient WHERE sensor = 'MODIS'", dbl="gradient")
def _(v):
    return gradient(v, MODIS)


# Tiles of 4 cells, so that the neighbourhoods of the data's 16 columns cross tiles.
@query("d04_gradient_across_tiles", "SELECT * FROM gradient WHERE sensor = 'MODIS'", dbl="gradient")
def _(v):
    rows = composite(v).filter(F.col("sensor") == "MODIS")
    return im.spectral_gradient(rows, RADIUS, tile=4)


_SAMPLED = {"sampled": """
SELECT p.site_id, p.transect_id, p.pnt_pst, CAST(y.y AS INTEGER) AS year, g.gradient AS grad
FROM {points} p CROSS JOIN (SELECT unnest([2018, 2019, 2020]) AS y) y
LEFT JOIN gradient g ON g.sensor = 'MODIS' AND g.year = y.y
  AND g.cx = CAST(floor(p.x / 500) AS BIGINT) AND g.cy = CAST(floor(p.y / 500) AS BIGINT)"""}


@query("d05_sample_points", "SELECT * FROM sampled WHERE year = 2020", dbl="grad",
       views={"sampled": _SAMPLED["sampled"].format(points="points")})
def _(v):
    return sampled(v, v.points(), (2020,))


@query("d06_stacked_years", "SELECT * FROM sampled", dbl="grad",
       views={"sampled": _SAMPLED["sampled"].format(points="land")})
def _(v):
    return sampled(v, land(v))


@query("d06_rewritten_year", "SELECT * FROM sampled", dbl="grad",
       views={"sampled": _SAMPLED["sampled"].format(points="land")})
def _(v):
    """All years written with a spoiled one, that year run again, and all read."""
    points = land(v)
    path = scratch_path(v.spark, "stacked-years")
    stacked = sampled(v, points)
    spoiled = stacked.withColumn("grad", F.when(F.col("year") != 2019, F.col("grad")))
    tb.replace_partitions(spoiled, path, "year")
    tb.replace_partitions(sampled(v, points, (2019,)), path, "year")
    return v.spark.read.schema(stacked.schema).parquet(path)


_IN_BOX = " OR ".join(
    f"(sensor = '{s}' AND (cx + 0.5) * {r} BETWEEN {BOX[0]} AND {BOX[2]} "
    f"AND (cy + 0.5) * {r} BETWEEN {BOX[1]} AND {BOX[3]})" for s, r in RES.items())


@query("d07_two_sensors", f"SELECT * FROM gradient WHERE year = 2020 AND ({_IN_BOX})", dbl="gradient")
def _(v):
    return gradient(v, RES, 2020, BOX)
