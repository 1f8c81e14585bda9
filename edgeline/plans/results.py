"""The results chain: edge levels, attributes and trends per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.functions import labels
from edgeline.operators import rates, stats
from edgeline.operators import samples as sm
from edgeline.plans.oracle import VIEWS
from edgeline.sources.adapter import Views


def levels(v: Views) -> DataFrame:
    return sm.edge_levels(v.placed(), v.original_counts(), v.samples())


def all_results(v: Views, p_values: bool = True) -> DataFrame:
    """Edge levels with site attributes and per-site trends.

    The site table already holds one row per site, so the attributes come from
    it directly and the annotated points need not be read.
    """
    return (levels(v).join(v.sites(), "site_id", "left")
            .join(stats.site_trends(v.samples(), p_values=p_values), "site_id", "left"))


def reported(v: Views, variant: str = "global") -> DataFrame:
    """Reported sites with regrouped biome and trend class."""
    out = rates.reported_sites(all_results(v))
    return (out.withColumn("biome", labels.regroup_biome(F.col("biome"), variant))
            .withColumn("edge_change",
                        labels.trend_class(F.col("slope"), F.col("p_value"), variant)))


def reported_levels(v: Views, variant: str = "global") -> DataFrame:
    """Reported sites with biome, without the trends."""
    out = rates.reported_sites(levels(v)).join(v.sites(), "site_id", "left")
    return out.withColumn("biome", labels.regroup_biome(F.col("biome"), variant))


def reported_year_counts(v: Views) -> DataFrame:
    """Transects and edges per reported site and year, with the site's biome."""
    counts = rates.site_years(v.samples()).withColumnRenamed("n_any_pair", "n_edge")
    kept = rates.reported_site_years(counts, v.placed(), v.original_counts())
    biome = v.sites().select("site_id", labels.regroup_biome(F.col("biome")).alias("biome"))
    return kept.select("site_id", "year", "n", "n_edge").join(biome, "site_id", "left")


# ---- the same views as SQL -------------------------------------------------
def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def biome_sql(variant: str) -> str:
    grass = {"global": "Grassland & shrubland", "site": "Grassland-Shrubland"}[variant]
    tail = ("WHEN biome = 'N/A' OR biome IS NULL THEN 'Rock & Ice'" if variant == "global"
            else "WHEN biome = 'Mangroves' THEN 'Mangrove' WHEN biome = 'N/A' THEN 'Rock & Ice'")
    return f"""CASE WHEN biome IN ({_quoted(labels.DESERT)}) THEN 'Desert'
      WHEN biome IN ({_quoted(labels.TROPICAL)}) THEN 'Tropical-Forests'
      WHEN biome IN ({_quoted(labels.TEMPERATE)}) THEN 'Temperate-Forests'
      WHEN biome IN ({_quoted(labels.BOREAL)}) THEN 'Boreal-Forests'
      WHEN biome IN ({_quoted(labels.GRASSLAND)}) THEN '{grass}' {tail} ELSE biome END"""


def class_sql(variant: str) -> str:
    weak = {"global": "Not significantly", "site": "Not Significant"}[variant]
    return f"""CASE WHEN slope > 0 AND p_value < 0.05 THEN 'Significantly Increase'
      WHEN slope > 0 AND p_value >= 0.05 THEN '{weak} Increase'
      WHEN slope = 0 THEN 'Stable'
      WHEN slope < 0 AND p_value < 0.05 THEN 'Significantly Decrease'
      WHEN slope < 0 AND p_value >= 0.05 THEN '{weak} Decrease' ELSE 'unknown' END"""


def t_p_sql(t: str, df: str) -> str:
    """Two-sided t probability for whole degrees of freedom, as a finite sum."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = (f"list_sum(list_transform(range(0, CAST(({df} - 1) / 2 AS BIGINT)), lambda k: "
           f"exp(lgamma(k + 1) + lgamma(0.5) - lgamma(k + 1.5) - ln(2)) "
           f"* pow(cos({th}), 2 * k + 1)))")
    even = (f"list_sum(list_transform(range(0, CAST({df} / 2 AS BIGINT)), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos({th}), 2 * k)))")
    return (f"CASE WHEN CAST({df} AS BIGINT) % 2 = 1 THEN "
            f"1 - 2 / pi() * ({th} + sin({th}) * coalesce({odd}, 0)) "
            f"ELSE 1 - sin({th}) * {even} END")


def f_p_sql(f: str, d1: str, d2: str, steps: int = 20000) -> str:
    """Upper F probability by Simpson's rule on the beta density."""
    a, b, x = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * {f}))"
    t = f"(CAST(i AS DOUBLE) / {steps} * {x})"
    density = (f"CASE WHEN i = 0 THEN 0 ELSE exp(({a} - 1) * ln({t}) + ({b} - 1) * ln(1 - {t}) "
               f"+ lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) END")
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({density}) * ({weight}))) "
            f"* {x} / {steps} / 3")


def ols_sql(y: str, x: str, source: str, keys: str = "", extra: str = "") -> str:
    """Simple regression as one SELECT with the columns of ``stats.ols``."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT *, sqrt(sse / df_res / sxx) AS std_err, slope / nullif(sqrt(sse / df_res / sxx), 0) AS t_value,
  my - slope * mx AS intercept, sqrt(sse / df_res * (1.0 / n_obs + mx * mx / sxx)) AS intercept_se,
  (syy - sse) / nullif(syy, 0) AS r2,
  1 - (1 - (syy - sse) / nullif(syy, 0)) * (n_obs - 1) / df_res AS adj_r2,
  (syy - sse) / nullif(sse / df_res, 0) AS f_value, sqrt(sse / df_res) AS sigma
FROM (SELECT *, sxy / nullif(sxx, 0) AS slope, greatest(syy - sxy * sxy / nullif(sxx, 0), 0) AS sse,
        CASE WHEN n_obs > 2 THEN n_obs - 2 END AS df_res
  FROM (SELECT {lead}CAST(regr_count({y}, {x}) AS BIGINT) AS n_obs, regr_sxx({y}, {x}) AS sxx,
          regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
          regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my{extra}
        FROM {source} {group}))"""


VIEWS["trend_sums"] = ols_sql(
    "grad", "CAST(year AS DOUBLE)", "complete", "site_id",
    ", count(DISTINCT transect_id) AS n_transects").replace(
    "FROM complete", "FROM complete WHERE pnt_pst = 0")
VIEWS["trends"] = f"""
SELECT site_id, n_transects, slope, std_err, t_value, {t_p_sql('t_value', 'df_res')} AS p_value
FROM trend_sums"""
VIEWS["results"] = """
SELECT l.*, s.name, s.biome, s.iucn_cat, s.status_yr, s.iso3, s.gis_area,
       t.n_transects, t.slope, t.std_err, t.t_value, t.p_value
FROM levels l LEFT JOIN sites s USING (site_id) LEFT JOIN trends t USING (site_id)"""
VIEWS["reported"] = f"""
SELECT * REPLACE ({biome_sql('global')} AS biome), {class_sql('global')} AS edge_change
FROM results WHERE perc_evaluated_2020 >= 0.3"""
VIEWS["reported_site"] = f"""
SELECT * REPLACE ({biome_sql('site')} AS biome), {class_sql('site')} AS edge_change
FROM results WHERE perc_evaluated_2020 >= 0.3"""
VIEWS["wide"] = """
SELECT site_id, transect_id, year,
       max(grad) FILTER (pnt_pst = -2) AS inner2, max(grad) FILTER (pnt_pst = -1) AS inner1,
       max(grad) FILTER (pnt_pst = 0) AS bd, max(grad) FILTER (pnt_pst = 1) AS outer1,
       max(grad) FILTER (pnt_pst = 2) AS outer2
FROM complete GROUP BY ALL"""
VIEWS["flagged"] = """
SELECT w.*, l.biome, (bd > inner2 OR bd > inner1) AND (bd > outer1 OR bd > outer2) AS edge
FROM wide w JOIN reported l USING (site_id)"""
