"""Queries for regressions, tests, ANOVA and Tukey comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.functions import inference as inf
from edgeline.functions import labels
from edgeline.operators import rates, sites, stats
from edgeline.plans import results as rs
from edgeline.plans.edge_rates import NULL_DENSE, null_levels
from edgeline.plans.oracle import VIEWS
from edgeline.plans.registry import query

_OLS_COLS = ("n_obs slope std_err t_value intercept intercept_se r2 adj_r2 f_value sigma "
             "df_res p_value")
_OLS_DBL = "slope std_err t_value intercept intercept_se r2 adj_r2 f_value sigma p_value"


def _ols_view(source: str, y: str, x: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return (f"SELECT {lead}{_OLS_COLS.replace(' ', ', ')} FROM (SELECT *, "
            f"{rs.t_p_sql('t_value', 'df_res')} AS p_value FROM ({rs.ols_sql(y, x, source, keys)}))")


@query("f01_site_trends", "SELECT * FROM trends", dbl="slope std_err t_value p_value")
def _(v):
    return stats.site_trends(v.samples())


@query("f02_levels_with_trends", """
SELECT l.site_id, l.perc_evaluated_2020, l.edge_level_2020, l.perc_evaluated_2001,
       l.edge_level_2001, t.slope AS trend, t.p_value
FROM levels l LEFT JOIN trends t USING (site_id)""",
       dbl="perc_evaluated_2020 edge_level_2020 perc_evaluated_2001 edge_level_2001 trend p_value")
def _(v):
    joined = rs.levels(v).join(stats.site_trends(v.samples()), "site_id", "left")
    return joined.select("site_id", "perc_evaluated_2020", "edge_level_2020",
                         "perc_evaluated_2001", "edge_level_2001",
                         F.col("slope").alias("trend"), "p_value")


_ONE_T = """
SELECT *, {p} AS p_value FROM (
  SELECT avg({x}) AS mean, stddev_samp({x}) AS sd, count({x}) AS n,
         avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) AS t_value,
         CAST(count({x}) - 1 AS DOUBLE) AS df FROM {source})"""


@query("f03_trend_t_test", _ONE_T.format(x="slope", source="trends",
                                         p=rs.t_p_sql("t_value", "df")),
       dbl="mean sd t_value p_value")
def _(v):
    return stats.with_t_test(stats.one_sample_t(
        stats.site_trends(v.samples(), p_values=False), "slope"))


def _pairs(year: int) -> dict[str, str]:
    return {**NULL_DENSE, "pairs": f"""
SELECT edge_level_{year} AS a, edge_level_{year}_null2 AS b FROM null_levels
WHERE perc_evaluated_{year} >= 0.3"""}


_PAIRS = _pairs(2020)


def null_pairs(v, year: int):
    return null_levels(v).filter(F.col(f"perc_evaluated_{year}") >= 0.3)


@query("f04_paired_null_test_2001", _ONE_T.format(x="a - b", source="pairs",
                                                  p=rs.t_p_sql("t_value", "df")),
       dbl="mean sd t_value p_value", views=_pairs(2001))
def _(v):
    return stats.with_t_test(stats.paired_t(
        null_pairs(v, 2001), "edge_level_2001", "edge_level_2001_null2"))


@query("f04_paired_null_test", _ONE_T.format(x="a - b", source="pairs",
                                             p=rs.t_p_sql("t_value", "df")),
       dbl="mean sd t_value p_value", views=_PAIRS)
def _(v):
    kept = null_levels(v).filter(F.col("perc_evaluated_2020") >= 0.3)
    return stats.with_t_test(stats.paired_t(kept, "edge_level_2020", "edge_level_2020_null2"))


_WELCH = """
SELECT mean_a, mean_b, (mean_a - mean_b) / sqrt(va + vb) AS t_value,
  (va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df
FROM (SELECT avg(a) AS mean_a, avg(b) AS mean_b, var_samp(a) / count(a) AS va,
        var_samp(b) / count(b) AS vb, count(a) AS n_a, count(b) AS n_b FROM pairs)"""


@query("f04_welch_null_test", _WELCH, dbl="mean_a mean_b t_value df", views=_PAIRS)
def _(v):
    kept = null_levels(v).filter(F.col("perc_evaluated_2020") >= 0.3)
    return stats.welch_t(kept, "edge_level_2020", "edge_level_2020_null2")


@query("f04_welch_null_test_p", f"""
SELECT *, {rs.f_p_sql('(t_value * t_value)', '1', 'df')} AS p_value FROM ({_WELCH})""",
       dbl="mean_a mean_b t_value df p_value", views=_PAIRS)
def _(v):
    kept = null_levels(v).filter(F.col("perc_evaluated_2020") >= 0.3)
    return stats.with_t_test(stats.welch_t(kept, "edge_level_2020", "edge_level_2020_null2"))


VIEWS["rate_rows"] = """
SELECT 'Global' AS biome, year, perc_edge FROM global_rate
UNION ALL SELECT biome, year, perc_edge FROM biome_rate"""


def rate_rows(v):
    return rates.year_shares_with_total(rs.reported_year_counts(v), "biome")


_TABLE = "n_obs slope std_err t_value r2 adj_r2 f_value p_value"


@query("f05_rate_regressions", f"""
SELECT biome, {_TABLE.replace(' ', ', ')},
  CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**'
       WHEN p_value < 0.1 THEN '*' ELSE '' END AS stars
FROM rate_fit""", dbl="slope std_err t_value r2 adj_r2 f_value p_value",
       views={"rate_fit": _ols_view("rate_rows", "perc_edge", "CAST(year AS DOUBLE)", "biome")})
def _(v):
    fit = stats.ols(rate_rows(v), ["biome"], "perc_edge", F.col("year").cast("double"))
    return fit.select("biome", *_TABLE.split(), inf.stars(F.col("p_value")).alias("stars"))


@query("f06_trend_on_log_area", _ols_view("reported", "slope_", "ln(gis_area)").replace(
    "FROM reported", "FROM (SELECT slope AS slope_, gis_area FROM reported)"), dbl=_OLS_DBL)
def _(v):
    kept = rs.reported(v).withColumnRenamed("slope", "trend")
    return stats.ols(kept, [], "trend", F.log("gis_area")).select(*_OLS_COLS.split())


@query("f06_level_on_log_area", _ols_view("reported", "edge_level_2020", "ln(gis_area)"),
       dbl=_OLS_DBL)
def _(v):
    return stats.ols(rs.reported_levels(v), [], "edge_level_2020", F.log("gis_area")).select(
        *_OLS_COLS.split())


@query("f06_level_on_status_year", _ols_view(
    "reported", "edge_level_2020", "CAST(status_yr AS DOUBLE)").replace(
    "FROM reported", "FROM reported WHERE status_yr <> 0"), dbl=_OLS_DBL)
def _(v):
    kept = rs.reported_levels(v).filter(F.col("status_yr") != 0)
    return stats.ols(kept, [], "edge_level_2020", F.col("status_yr").cast("double")).select(
        *_OLS_COLS.split())


def _anova_sql(group: str, y: str, where: str = "true") -> str:
    return f"""
SELECT *, {rs.f_p_sql('f_value', 'df_between', 'df_within')} AS p_value
FROM (SELECT *, ss_between / df_between AS ms_between, ss_within / df_within AS ms_within,
        (ss_between / df_between) / (ss_within / df_within) AS f_value
  FROM (SELECT CAST(count(DISTINCT g) - 1 AS DOUBLE) AS df_between,
          CAST(count(*) - count(DISTINCT g) AS DOUBLE) AS df_within,
          sum((m - gm) * (m - gm)) AS ss_between, sum((y - m) * (y - m)) AS ss_within
        FROM (SELECT {group} AS g, {y} AS y, avg({y}) OVER (PARTITION BY {group}) AS m,
                avg({y}) OVER () AS gm
              FROM reported_site WHERE {group} IS NOT NULL AND {y} IS NOT NULL AND {where})))"""


_ANOVA_DBL = "ss_between ss_within ms_between ms_within f_value p_value"
_WITH_IUCN = "iucn_cat NOT IN ('Not Reported', 'Not Assigned', 'Not Applicable')"


def reported_iucn(v, trends: bool):
    rows = rs.reported(v, "site") if trends else rs.reported_levels(v, "site")
    return rows.filter(~F.col("iucn_cat").isin(labels.UNCATEGORISED_IUCN))


@query("f07_anova_trend_biome", _anova_sql("biome", "slope"), dbl=_ANOVA_DBL)
def _(v):
    return stats.anova(rs.reported(v, "site"), "biome", "slope")


@query("f07_anova_trend_iucn", _anova_sql("iucn_cat", "slope", _WITH_IUCN), dbl=_ANOVA_DBL)
def _(v):
    return stats.anova(reported_iucn(v, True), "iucn_cat", "slope")


@query("f07_anova_level_biome", _anova_sql("biome", "edge_level_2020"), dbl=_ANOVA_DBL)
def _(v):
    return stats.anova(rs.reported_levels(v, "site"), "biome", "edge_level_2020")


@query("f07_anova_level_iucn", _anova_sql("iucn_cat", "edge_level_2020", _WITH_IUCN),
       dbl=_ANOVA_DBL)
def _(v):
    return stats.anova(reported_iucn(v, False), "iucn_cat", "edge_level_2020")


_DIFFERENCES = """
SELECT b.g || '-' || a.g AS pair, b.m - a.m AS diff, sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)) AS se,
       abs(b.m - a.m) / sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)) AS q_value, k, df_within
FROM cells a JOIN cells b ON a.g < b.g,
     (SELECT count(*) AS k, CAST(sum(n) - count(*) AS DOUBLE) AS df_within,
             sum(v) / (sum(n) - count(*)) AS ms FROM cells)"""


def _levels_view(group: str, y: str, where: str = "true") -> dict[str, str]:
    return {"cells": f"""
SELECT {group} AS g, count({y}) AS n, avg({y}) AS m, var_pop({y}) * count({y}) AS v
FROM reported_site WHERE {group} IS NOT NULL AND {y} IS NOT NULL AND {where} GROUP BY 1"""}


@query("f08_tukey_differences", _DIFFERENCES, dbl="diff se q_value",
       views=_levels_view("biome", "slope"))
def _(v):
    return stats.tukey(rs.reported(v, "site"), "biome", "slope", p_values=False)


@query("f08_tukey_differences_trend_iucn", _DIFFERENCES, dbl="diff se q_value",
       views=_levels_view("iucn_cat", "slope", _WITH_IUCN))
def _(v):
    return stats.tukey(reported_iucn(v, True), "iucn_cat", "slope", p_values=False)


@query("f08_tukey_differences_level_biome", _DIFFERENCES, dbl="diff se q_value",
       views=_levels_view("biome", "edge_level_2020"))
def _(v):
    return stats.tukey(rs.reported_levels(v, "site"), "biome", "edge_level_2020", p_values=False)


@query("f08_tukey_differences_level_iucn", _DIFFERENCES, dbl="diff se q_value",
       views=_levels_view("iucn_cat", "edge_level_2020", _WITH_IUCN))
def _(v):
    return stats.tukey(reported_iucn(v, False), "iucn_cat", "edge_level_2020", p_values=False)


# Upper probability of the studentized range by a double sum over the normal value z and the
# scale u; both integrands fade like a normal density, so equal steps converge fast.
_CDF = lambda x: (f"(CASE WHEN {x} < -8.6 THEN 0 ELSE 0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * sign({x}) * list_sum(list_transform("
                  f"range(0, 110), lambda t: CASE WHEN {x} = 0 THEN 0 ELSE exp((2 * t + 1) * ln(abs({x})) "
                  f"- (t + 1) * ln(2) - lgamma(t + 1.5) + ln(pi()) / 2) END)) END)")
_RANGE_VIEWS = {
    "z_grid": f"""
SELECT z, exp(-z * z / 2) / sqrt(2 * pi()) * 0.17 AS wz, {_CDF('z')} AS cz
FROM (SELECT -8.5 + 0.17::DOUBLE * unnest(range(0, 101)) AS z)""",
    "u_grid": """
SELECT u, h * exp(ln(2) + f / 2 * ln(f / 2) - lgamma(f / 2) + (f - 1) * ln(u) - f * u * u / 2) AS wu
FROM (SELECT f, (9 / sqrt(2 * f) + 9 / sqrt(2 * f) + 9 / f) / 80 AS h,
        1 - 9 / sqrt(2 * f) + unnest(range(0, 81)) * (9 / sqrt(2 * f) + 9 / sqrt(2 * f) + 9 / f) / 80 AS u
      FROM (SELECT DISTINCT df_within AS f FROM tukey_pairs)) WHERE u > 0"""}


def _upper(q: str, source: str, keys: str) -> str:
    return f"""
SELECT {keys}, greatest(0, least(1, 1 - sum(wu * k * wz * pow(greatest(cz - {_CDF('x')}, 0), k - 1)))) AS p
FROM (SELECT {keys}, k, wu, wz, cz, z - {q} * u AS x FROM {source}, u_grid, z_grid)
GROUP BY {keys}"""


# The quantile by halving: the margin of every pair is the same multiple of its error.
_HSD = f"""
WITH RECURSIVE halved AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, k FROM (SELECT DISTINCT k FROM tukey_pairs)
  UNION ALL
  SELECT h.i + 1, CASE WHEN p > 0.05 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN p > 0.05 THEN hi ELSE (lo + hi) / 2 END, k
  FROM ({_upper('((lo + hi) / 2)', 'halved', 'i, lo, hi, k').replace('i, lo, hi, k, k,', 'i, lo, hi, k,')}) h WHERE h.i < 44)
SELECT t.*, t.diff - m * t.se AS lwr, t.diff + m * t.se AS upr, r.p AS p_adj
FROM tukey_pairs t JOIN ({_upper('q_value', 'tukey_pairs', 'pair, q_value, k').replace('q_value, k, k,', 'q_value, k,')}) r
  USING (pair), (SELECT (lo + hi) / 2 AS m FROM halved ORDER BY i DESC LIMIT 1)"""


def _hsd_views(group: str, y: str, where: str = "true") -> dict[str, str]:
    return {**_levels_view(group, y, where), "tukey_pairs": _DIFFERENCES, **_RANGE_VIEWS}


_HSD_DBL = "diff se q_value lwr upr p_adj"


@query("f08_tukey_hsd_biome", _HSD, dbl=_HSD_DBL, views=_hsd_views("biome", "slope"))
def _(v):
    return stats.tukey(rs.reported(v, "site"), "biome", "slope")


@query("f08_tukey_hsd_iucn", _HSD, dbl=_HSD_DBL,
       views=_hsd_views("iucn_cat", "edge_level_2020", _WITH_IUCN))
def _(v):
    return stats.tukey(reported_iucn(v, False), "iucn_cat", "edge_level_2020")


@query("f08_tukey_hsd_trend_iucn", _HSD, dbl=_HSD_DBL, views=_hsd_views("iucn_cat", "slope", _WITH_IUCN))
def _(v):
    return stats.tukey(reported_iucn(v, True), "iucn_cat", "slope")


@query("f08_tukey_hsd_level_biome", _HSD, dbl=_HSD_DBL, views=_hsd_views("biome", "edge_level_2020"))
def _(v):
    return stats.tukey(rs.reported_levels(v, "site"), "biome", "edge_level_2020")


def _residuals_sql(group: str, y: str, where: str = "true") -> str:
    known = f"{group} IS NOT NULL AND {y} IS NOT NULL AND {where}"
    return f"""
SELECT site_id, grp, y - m AS resid, (y - m) / sqrt(ms * (1 - 1.0 / n)) AS std_resid
FROM (SELECT site_id, {group} AS grp, {y} AS y, avg({y}) OVER w AS m, count({y}) OVER w AS n
      FROM reported_site WHERE {known} WINDOW w AS (PARTITION BY {group})),
     (SELECT sum(v) / (sum(n) - count(*)) AS ms FROM (
        SELECT var_pop({y}) * count({y}) AS v, count({y}) AS n
        FROM reported_site WHERE {known} GROUP BY {group}))
WHERE n > 1"""


# The normal quantile by Newton steps on the series of its integral.
_PHI = ("(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * sign(z) * list_sum(list_transform(range(0, 120), "
        "lambda k: exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))))")
_NEWTON = (f"list_reduce(range(0, 60), lambda z, i: CASE WHEN p = 0.5 THEN 0.0::DOUBLE ELSE z - ({_PHI} - p) "
           "/ (exp(-z * z / 2) / sqrt(2 * pi())) END, CASE WHEN p < 0.5 THEN -0.01 ELSE 0.01 END::DOUBLE)")


@query("f09_residual_quantiles", f"""
SELECT site_id, grp, resid, std_resid, rank, {_NEWTON} AS theoretical
FROM (SELECT *, (rank - 0.5) / count(*) OVER () AS p FROM (
  SELECT *, row_number() OVER (ORDER BY std_resid, md5(site_id)[1:4], site_id) AS rank
  FROM ({_residuals_sql('biome', 'edge_level_2020')})))""", dbl="resid std_resid theoretical")
def _(v):
    return stats.residual_quantiles(rs.reported_levels(v, "site"), "biome", "edge_level_2020",
                                    "site_id")


@query("f09_residuals_trend_biome", _residuals_sql("biome", "slope"), dbl="resid std_resid")
def _(v):
    return stats.residual_quantiles(rs.reported(v, "site"), "biome", "slope",
                                    "site_id").drop("rank", "theoretical")


@query("f09_residuals_trend_iucn", _residuals_sql("iucn_cat", "slope", _WITH_IUCN),
       dbl="resid std_resid")
def _(v):
    return stats.residual_quantiles(reported_iucn(v, True), "iucn_cat", "slope",
                                    "site_id").drop("rank", "theoretical")


@query("f09_standardised_residuals", _residuals_sql("biome", "edge_level_2020"),
       dbl="resid std_resid")
def _(v):
    return stats.residual_quantiles(rs.reported_levels(v, "site"), "biome", "edge_level_2020",
                                    "site_id").drop("rank", "theoretical")


@query("f10_area_summary", """
SELECT min(gis_area) AS min, quantile_cont(gis_area, 0.25) AS q1, median(gis_area) AS median,
       avg(gis_area) AS mean, quantile_cont(gis_area, 0.75) AS q3, max(gis_area) AS max
FROM reported""", dbl="min q1 median mean q3 max")
def _(v):
    return stats.six_numbers(rs.reported_levels(v), "gis_area")


@query("f11_descriptive", """
SELECT count(*) AS n_sites, count(DISTINCT iso3) - 3 AS n_countries,
       count(DISTINCT coalesce(biome, '')) AS n_biomes, min(gis_area) AS min_area,
       max(gis_area) AS max_area, median(gis_area) AS median_area,
       stddev_samp(gis_area) AS sd_area, min(ntrsct_2020_eva) AS min_transects,
       max(ntrsct_2020_eva) AS max_transects, median(ntrsct_2020_eva) AS median_transects,
       stddev_samp(ntrsct_2020_eva) AS sd_transects FROM reported_site""",
       dbl="min_area max_area median_area sd_area median_transects sd_transects",
       ints="min_transects max_transects")
def _(v):
    return stats.describe_sites(rs.reported_levels(v, "site"))


@query("f12_confidence_band", """
SELECT r.biome, r.year, f.intercept + f.slope * r.year AS fit, se AS se_fit,
       f.intercept + f.slope * r.year - 2.10092204024096 * se AS lwr,
       f.intercept + f.slope * r.year + 2.10092204024096 * se AS upr
FROM (SELECT rr.biome, rr.year, rf.sigma * sqrt(1.0 / rf.n_obs + (rr.year - rf.mx)
        * (rr.year - rf.mx) / rf.sxx) AS se FROM rate_rows rr JOIN rate_fit rf USING (biome)) r
JOIN rate_fit f USING (biome)""", dbl="fit se_fit lwr upr",
       views={"rate_fit": rs.ols_sql("perc_edge", "CAST(year AS DOUBLE)", "rate_rows", "biome")})
def _(v):
    return stats.confidence_band(rate_rows(v), ["biome"], "perc_edge", "year")


@query("f13_country_join", """
SELECT s.site_id, s.iso3, c.country FROM sites s
LEFT JOIN (SELECT iso3, min(country) AS country FROM country GROUP BY 1) c USING (iso3)""")
def _(v):
    return sites.with_country(v.sites(), v.country()).select("site_id", "iso3", "country")


@query("f14_significant_shares", """
SELECT count(*) FILTER (edge_change = 'Significantly Increase') / count(*) * 100 AS perc_increase,
       count(*) FILTER (edge_change = 'Significantly Decrease') / count(*) * 100 AS perc_decrease
FROM reported""", dbl="perc_increase perc_decrease")
def _(v):
    change = F.col("edge_change")
    return rs.reported(v).agg(
        labels.share(change == "Significantly Increase").alias("perc_increase"),
        labels.share(change == "Significantly Decrease").alias("perc_decrease"))
