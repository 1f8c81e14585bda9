"""Queries for filters, labels, keys and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.functions import labels
from edgeline.operators import rates, sites, stats
from edgeline.operators import samples as sm
from edgeline.plans import results as rs
from edgeline.plans.oracle import VIEWS
from edgeline.plans.registry import query
from edgeline.sources import adapter

VIEWS["registry"] = f"""
SELECT CAST(p_partkey AS VARCHAR) AS site_id,
       CASE WHEN p_partkey % 10 = 3 THEN 'Point' ELSE 'Polygon' END AS type,
       CAST(CASE p_partkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS marine,
       {"[" + ", ".join("NULL" if d is None else f"'{d}'" for d in adapter.DESIGNATIONS) + "]"}
         [p_partkey % 6 + 1] AS desig_eng,
       {"[" + ", ".join("NULL" if d is None else f"'{d}'" for d in adapter.STATUSES) + "]"}
         [(p_partkey // 2) % 5 + 1] AS status,
       p_retailprice - 880.0 + (p_partkey % 13) * 60 AS gis_area,
       CAST(p_size * 1000 + p_partkey % 1000 AS DOUBLE) AS perimeter
FROM part"""
VIEWS["terrestrial"] = f"""
SELECT * FROM registry WHERE type = 'Polygon' AND marine = 0
  AND desig_eng <> 'Marine Protected Area' AND desig_eng <> 'UNESCO-MAB Biosphere Reserve'
  AND status IN ('Designated', 'Established', 'Inscribed')
  AND coalesce(site_id NOT IN ({", ".join(f"'{i}'" for i in labels.MISFILED_MARINE_IDS)}), true)"""


@query("b01_terrestrial_filter", "SELECT * FROM terrestrial", dbl="gis_area perimeter")
def _(v):
    return sites.terrestrial_sites(v.registry())


@query("b02_minimum_area", "SELECT * FROM terrestrial WHERE gis_area >= 200",
       dbl="gis_area perimeter")
def _(v):
    return sites.minimum_area(sites.terrestrial_sites(v.registry()))


@query("b03_quantile_cut", """
SELECT * FROM (SELECT *, perimeter / gis_area AS pa_ratio FROM terrestrial WHERE gis_area >= 200)
WHERE pa_ratio < (SELECT quantile_cont(perimeter / gis_area, 0.75) FROM terrestrial
                  WHERE gis_area >= 200)""", dbl="gis_area perimeter pa_ratio")
def _(v):
    kept = sites.minimum_area(sites.terrestrial_sites(v.registry()))
    ratio = F.try_divide(F.col("perimeter"), F.col("gis_area"))
    return sites.below_quantile(kept.withColumn("pa_ratio", ratio), "pa_ratio")


@query("b04_semi_join", """
SELECT site_id, year, count(*) AS n_rows, sum(grad) AS total FROM gs WHERE site_id IN (
  SELECT site_id FROM levels WHERE perc_evaluated_2020 >= 0.3) GROUP BY ALL""", dbl="total")
def _(v):
    # Folding the samples first leaves one row per site and year to join.
    folded = v.samples().groupBy("site_id", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("grad").alias("total"))
    return sites.semi_filter(folded, rates.reported_sites(rs.levels(v)).select("site_id"),
                             "site_id")


@query("b05_anti_join", """
SELECT site_id, transect_id FROM placed WHERE (site_id, transect_id) NOT IN (
  SELECT site_id, transect_id FROM complete)""")
def _(v):
    done = sm.transect_flags(v.samples(), years=())
    return sites.anti_filter(v.placed(), done, list(sm.KEY))


@query("b06_null_tests", """
SELECT year, count(*) FILTER (grad IS NULL) AS n_null, count(*) FILTER (grad IS NOT NULL) AS n_value
FROM gs GROUP BY year""")
def _(v):
    grad = F.col("grad")
    return v.samples().groupBy("year").agg(F.count_if(grad.isNull()).alias("n_null"),
                                           F.count_if(grad.isNotNull()).alias("n_value"))


@query("b07_biome_groups", f"SELECT site_id, biome AS raw, {rs.biome_sql('global')} AS biome FROM sites")
def _(v):
    return v.sites().select("site_id", F.col("biome").alias("raw"),
                            labels.regroup_biome(F.col("biome"), "global").alias("biome"))


@query("b08_biome_groups_site", f"SELECT site_id, biome AS raw, {rs.biome_sql('site')} AS biome FROM sites")
def _(v):
    return v.sites().select("site_id", F.col("biome").alias("raw"),
                            labels.regroup_biome(F.col("biome"), "site").alias("biome"))


@query("b09_trend_class", f"""
SELECT site_id, slope, p_value, {rs.class_sql('global')} AS edge_change,
       {rs.class_sql('site')} AS edge_trend FROM trends""", dbl="slope p_value")
def _(v):
    slope, p = F.col("slope"), F.col("p_value")
    return stats.site_trends(v.samples()).select(
        "site_id", "slope", "p_value", labels.trend_class(slope, p).alias("edge_change"),
        labels.trend_class(slope, p, "site").alias("edge_trend"))


@query("b10_evaluated_share", """
SELECT site_id, perc_evaluated_2020 FROM levels WHERE perc_evaluated_2020 >= 0.3""",
       dbl="perc_evaluated_2020")
def _(v):
    return rates.reported_sites(rs.levels(v)).select("site_id", "perc_evaluated_2020")


@query("b11_category_exclusion", """
SELECT site_id, iucn_cat, status_yr FROM sites
WHERE iucn_cat NOT IN ('Not Reported', 'Not Assigned', 'Not Applicable') AND status_yr <> 0""")
def _(v):
    return (v.sites().filter(~F.col("iucn_cat").isin(labels.UNCATEGORISED_IUCN))
            .filter(F.col("status_yr") != 0).select("site_id", "iucn_cat", "status_yr"))


@query("b12_predicate_share", """
SELECT count(*) FILTER (edge_level_2020 > 0.5) / count(*) * 100 AS perc_majority_edge
FROM levels WHERE perc_evaluated_2020 >= 0.3""", dbl="perc_majority_edge")
def _(v):
    return rates.reported_sites(rs.levels(v)).agg(
        labels.share(F.col("edge_level_2020") > 0.5).alias("perc_majority_edge"))


@query("b13_composite_key", """
SELECT id, CAST(split_part(id, '_', 1) AS VARCHAR) AS site_id,
       CAST(split_part(id, '_', 2) AS BIGINT) AS transect_id
FROM (SELECT site_id || '_' || transect_id AS id FROM placed)""")
def _(v):
    keyed = v.placed().select(sites.join_key("site_id", "transect_id").alias("id"))
    return keyed.select("id", *sites.split_key("id", ["site_id", "transect_id"],
                                               ["string", "long"]))


@query("b14_select_rename", """
SELECT site_id, transect_id, pnt_pst AS point_position, x AS X, y AS Y, biome AS BIOME
FROM points_info""", dbl="X Y")
def _(v):
    return (v.points_info().drop("name", "iucn_cat", "status_yr", "iso3", "gis_area")
            .withColumnsRenamed({"pnt_pst": "point_position", "x": "X", "y": "Y",
                                 "biome": "BIOME"}))


@query("b15_null_to_zero", """
SELECT site_id, ntrsct, ntrsct_2, ntrsct_2020_eva, ntrsct_2001_eva,
       coalesce(ntrsct_2020_edge, 0) AS ntrsct_2020_edge,
       coalesce(perc_evaluated_2020, 0) AS perc_evaluated_2020,
       coalesce(edge_level_2020, 0) AS edge_level_2020,
       coalesce(ntrsct_2001_edge, 0) AS ntrsct_2001_edge,
       coalesce(perc_evaluated_2001, 0) AS perc_evaluated_2001,
       coalesce(edge_level_2001, 0) AS edge_level_2001 FROM levels""",
       dbl="perc_evaluated_2020 edge_level_2020 perc_evaluated_2001 edge_level_2001",
       ints="ntrsct ntrsct_2 ntrsct_2020_eva ntrsct_2001_eva ntrsct_2020_edge ntrsct_2001_edge")
def _(v):
    return sm.fill_missing_levels(rs.levels(v))


@query("b16_casts", """
SELECT site_id, CAST(status_yr AS DOUBLE) AS year_number, CAST(status_yr > 0 AS INTEGER) AS dated,
       try_cast(iucn_cat AS DOUBLE) AS category_number FROM sites""",
       dbl="year_number category_number")
def _(v):
    return v.sites().select(
        "site_id", F.col("status_yr").cast("string").cast("double").alias("year_number"),
        (F.col("status_yr") > 0).cast("int").alias("dated"),
        F.col("iucn_cat").try_cast("double").alias("category_number"))


@query("b17_ratio_columns", """
SELECT site_id, ntrsct_2 / nullif(ntrsct, 0) AS placed_share,
       ntrsct_2020_eva / nullif(ntrsct_2, 0) AS land_share FROM stage""",
       dbl="placed_share land_share")
def _(v):
    return rs.levels(v).select(
        "site_id", F.try_divide(F.col("ntrsct_2"), F.col("ntrsct")).alias("placed_share"),
        F.try_divide(F.col("ntrsct_2020_eva"), F.col("ntrsct_2")).alias("land_share"))


@query("b18_math", """
SELECT site_id, transect_id, pnt_pst, sqrt(x * x + y * y) AS radius, atan2(y, x) AS theta,
       sin(atan2(y, x) + pi() / 2) AS s, cos(atan2(y, x) + pi() / 2) AS c, ln(x + 1) AS log_x
FROM points""", dbl="radius theta s c log_x")
def _(v):
    theta = F.atan2("y", "x")
    return v.points().select(
        "site_id", "transect_id", "pnt_pst",
        F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("radius"),
        theta.alias("theta"), F.sin(theta + F.pi() / 2).alias("s"),
        F.cos(theta + F.pi() / 2).alias("c"), F.log(F.col("x") + 1).alias("log_x"))


@query("b19_ordered_categories", f"""
SELECT biome, nullif(list_position([{", ".join(f"'{b}'" for b in labels.BIOME_ORDER)}], biome), 0)
         AS position, n
FROM (SELECT {rs.biome_sql('global')} AS biome, count(*) AS n FROM sites GROUP BY 1)""",
       ints="position")
def _(v):
    grouped = v.sites().groupBy(labels.regroup_biome(F.col("biome")).alias("biome")).agg(
        F.count(F.lit(1)).alias("n"))
    return grouped.select("biome", labels.position_in(F.col("biome"), labels.BIOME_ORDER)
                          .alias("position"), "n")


@query("b20_conditional", """
SELECT site_id, CASE WHEN edge_level_2020 > edge_level_2001 THEN 'up'
       WHEN NOT edge_level_2020 > edge_level_2001 THEN 'not up' END AS direction FROM levels""")
def _(v):
    up = F.col("edge_level_2020") > F.col("edge_level_2001")
    return rs.levels(v).select("site_id", F.when(up, "up").when(~up, "not up").alias("direction"))


@query("b21_row_ids", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS lineid, 'S' || o_custkey AS site_id,
       o_orderkey AS transect_id FROM orders""")
def _(v):
    return sites.row_ids(v.placed(), "transect_id")
