"""Queries over gradient samples: completeness, edge rules, edge levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.operators import samples as sm
from edgeline.plans.registry import query


@query("e01_complete_transects", "SELECT * FROM complete", dbl="grad")
def _(v):
    return sm.complete_transects(v.samples())


@query("e02_stage_counts", "SELECT * FROM stage",
       ints="ntrsct ntrsct_2 ntrsct_2020_eva ntrsct_2001_eva")
def _(v):
    return sm.site_stage_counts(v.placed(), v.original_counts(),
                                sm.transect_flags(v.samples()))


@query("e03_border_difference", """
SELECT site_id, transect_id, pnt_pst, year, grad, border, diff FROM diffs
WHERE year IN (2001, 2020)""", dbl="grad border diff")
def _(v):
    return sm.border_differences(sm.complete_transects(
        v.samples().filter(F.col("year").isin(2001, 2020))).drop("n"))


@query("e04_passing_sides", """
SELECT site_id, transect_id, year, side, pnt_pst, diff, n_above FROM sides
WHERE year IN (2001, 2020)""", dbl="diff", ints="n_above")
def _(v):
    kept = sm.complete_transects(v.samples().filter(F.col("year").isin(2001, 2020)))
    return sm.passing_sides(sm.border_differences(kept)).select(
        "site_id", "transect_id", "year", "side", "pnt_pst", "diff", "n_above")


@query("e05_strict_edges", "SELECT * FROM edges")
def _(v):
    return sm.strict_edges(sm.complete_transects(v.samples()))


@query("e06_edge_level", "SELECT * FROM levels",
       dbl="perc_evaluated_2020 edge_level_2020 perc_evaluated_2001 edge_level_2001",
       ints="ntrsct ntrsct_2 ntrsct_2020_eva ntrsct_2001_eva ntrsct_2020_edge ntrsct_2001_edge")
def _(v):
    return sm.edge_levels(v.placed(), v.original_counts(), v.samples())


@query("e07_edge_level_with_attributes", """
SELECT * FROM levels LEFT JOIN (
  SELECT DISTINCT site_id, name, biome, iucn_cat, status_yr, iso3, gis_area
  FROM points_info) a USING (site_id)""",
       dbl="perc_evaluated_2020 edge_level_2020 perc_evaluated_2001 edge_level_2001 gis_area",
       ints="ntrsct ntrsct_2 ntrsct_2020_eva ntrsct_2001_eva ntrsct_2020_edge ntrsct_2001_edge")
def _(v):
    levels = sm.edge_levels(v.placed(), v.original_counts(), v.samples())
    return levels.join(sm.site_attributes(v.points_info()), "site_id", "left")


_WIDE = {"wide": """
SELECT site_id, transect_id, year,
       max(grad) FILTER (pnt_pst = -2) AS inner2, max(grad) FILTER (pnt_pst = -1) AS inner1,
       max(grad) FILTER (pnt_pst = 0) AS bd, max(grad) FILTER (pnt_pst = 1) AS outer1,
       max(grad) FILTER (pnt_pst = 2) AS outer2
FROM complete GROUP BY ALL"""}


@query("e12_any_pair_edges", """
SELECT *, CASE WHEN (bd > inner2 OR bd > inner1) AND (bd > outer1 OR bd > outer2) THEN 1
     WHEN NOT ((bd > inner2 OR bd > inner1) AND (bd > outer1 OR bd > outer2)) THEN 0 END AS edge
FROM wide""", dbl="inner2 inner1 bd outer1 outer2", views=_WIDE)
def _(v):
    return sm.complete_wide(v.samples()).withColumn("edge", sm.edge_flag())


@query("e13_outermost_pair_edges", """
SELECT site_id, transect_id, year,
     CASE WHEN bd > inner2 AND bd > outer2 THEN 1
          WHEN NOT (bd > inner2 AND bd > outer2) THEN 0 END AS edge FROM wide""", views=_WIDE)
def _(v):
    wide = sm.complete_wide(v.samples())
    return wide.select("site_id", "transect_id", "year",
                       sm.edge_flag("outermost").alias("edge"))
