"""Queries that write tables to the shared scratch folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline import schemas
from edgeline.operators import samples as sm
from edgeline.operators import sites as st
from edgeline.operators import stats
from edgeline.plans import images
from edgeline.plans import results as rs
from edgeline.plans.registry import query
from edgeline.session import materialise, scratch_path
from edgeline.sources import tables as tb


def _round_trip(v, df, name: str, fmt: str, schema=None, **write):
    path = tb.write_table(df, scratch_path(v.spark, name), fmt, **write)
    return tb.read_table(v.spark, path, schema or df.schema, fmt)


@query("a01_typed_csv", "SELECT * FROM registry", dbl="gis_area perimeter")
def _(v):
    return _round_trip(v, v.registry(), "registry", "csv", schemas.REGISTRY)


_DIGEST = """SELECT {keys}, count(*) AS n_rows, count(grad) AS n_values, sum(grad) AS total,
       min(pnt_pst) AS first_point, max(transect_id) AS last_transect FROM {source} GROUP BY ALL"""


def _digest(df, *keys: str):
    """What was read back, folded per site and year over the whole table."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("grad").alias("n_values"),
        F.sum("grad").alias("total"), F.min("pnt_pst").alias("first_point"),
        F.max("transect_id").alias("last_transect"))


@query("a02_stack_folder", _DIGEST.format(keys="site_id, year", source="gs"), dbl="total")
def _(v):
    # Two folders of files, read as one table.
    root = scratch_path(v.spark, "stacked")
    for part, side in (("inner", F.col("pnt_pst") < 0), ("outer", F.col("pnt_pst") >= 0)):
        tb.write_table(v.samples(ranges=True).filter(side), f"{root}/{part}", "csv",
                       compression="gzip")
    table = tb.read_table(v.spark, root, schemas.SAMPLES, "csv", glob="*.csv*", recursive=True)
    return _digest(table, "site_id", "year")


@query("a03_files_by_length", _DIGEST.format(
    keys="length_km, site_id, year", source="gs_all WHERE length_km = 15"), dbl="total")
def _(v):
    rows = v.samples_all(ranges=True)
    path = tb.write_table(rows, scratch_path(v.spark, "by_length"), "parquet", ["length_km"])
    table = tb.read_table(v.spark, path, rows.schema, "parquet")
    return _digest(table.filter(F.col("length_km") == 15), "length_km", "site_id", "year")


@query("a04_slim_rewrite", _DIGEST.format(keys="site_id, year", source="gs"), dbl="total")
def _(v):
    raw = v.samples().withColumn(
        "geom", F.concat_ws(" ", F.lit("POINT"), "transect_id", "pnt_pst"))
    slim = _round_trip(v, tb.slim_samples(raw, v.sample_parts()), "slim", "parquet", schemas.SAMPLES)
    return _digest(slim, "site_id", "year")


@query("a05_write_table", "SELECT * FROM ori_counts")
def _(v):
    return _round_trip(v, v.original_counts(), "original_counts", "csv", schemas.ORIGINAL_COUNTS)


@query("a06_sharded_export", "SELECT * FROM points", dbl="x y")
def _(v):
    return _round_trip(v, v.points(), "points", "csv", schemas.POINTS, max_rows=2000)


@query("a07_results_on_geometry", """
SELECT p.site_id, p.fid, p.ring, p.vtx, p.x, p.y, r.perc_evaluated_2020, r.edge_level_2020,
       r.slope AS trend, r.p_value
FROM (SELECT * REPLACE ('S' || fid AS site_id) FROM polygons) p
LEFT JOIN results r USING (site_id)""",
       dbl="x y perc_evaluated_2020 edge_level_2020 trend p_value")
def _(v):
    polygons = v.polygons().withColumn("site_id", F.concat(F.lit("S"), F.col("fid")))
    results = rs.levels(v).join(stats.site_trends(v.samples()), "site_id", "left").select(
        "site_id", "perc_evaluated_2020", "edge_level_2020", F.col("slope").alias("trend"),
        "p_value")
    return _round_trip(v, tb.attach(polygons, results), "results_shapes", "parquet")


@query("a08_dimension_read", "SELECT iso3 FROM country")
def _(v):
    return _round_trip(v, v.country(), "country", "csv", schemas.COUNTRY).select("iso3")


@query("a09_imagery_export", "SELECT * FROM sampled", dbl="grad",
       views={"sampled": images._SAMPLED["sampled"].format(points="land")})
def _(v):
    rows = images.sampled(v, images.land(v))
    return _round_trip(v, rows.select("site_id", "transect_id", "pnt_pst", "year", "grad"),
                       "imagery", "csv", schemas.SAMPLES)


@query("a10_raster_export", f"""
SELECT cx, cy, gradient AS value FROM gradient
WHERE year = 2020 AND sensor = 'MODIS' AND ({images._IN_BOX})""", dbl="value")
def _(v):
    cells = images.gradient(v, images.MODIS, 2020, images.BOX)
    return _round_trip(v, cells.select("cx", "cy", F.col("gradient").alias("value")), "raster",
                       "parquet", schemas.CELLS)


@query("a11_stage_audit", """
SELECT 'registry' AS stage, count(*) AS n_rows, count(DISTINCT site_id) AS n_ids,
       sum(gis_area) AS total FROM registry
UNION ALL SELECT 'terrestrial', count(*), count(DISTINCT site_id), sum(gis_area) FROM terrestrial
UNION ALL SELECT 'large', count(*), count(DISTINCT site_id), sum(gis_area) FROM terrestrial
  WHERE gis_area >= 200
UNION ALL SELECT 'complete', count(*), count(DISTINCT site_id), NULL FROM complete
  WHERE pnt_pst = 0 AND year = 2020""", dbl="total")
def _(v):
    audit, area = tb.StageAudit(v.spark), F.col("gis_area")
    registry = audit.watch(v.registry(), "registry", "site_id", area)
    land = audit.watch(st.terrestrial_sites(registry), "terrestrial", "site_id", area)
    materialise(audit.watch(st.minimum_area(land), "large", "site_id", area), "large-sites")
    complete = sm.complete_transects(v.samples().filter(F.col("year") == 2020))
    border = complete.filter(F.col("pnt_pst") == 0)
    written = materialise(audit.watch(border, "complete"), "complete-borders")
    audit.count_keys("complete", written, "site_id")
    return audit.table()
