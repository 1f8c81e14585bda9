"""Queries for rates by year, biome and length, histograms, and the null model."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeline.functions import labels
from edgeline.operators import nullmodel, rates
from edgeline.operators import samples as sm
from edgeline.plans import results as rs
from edgeline.plans.oracle import VIEWS
from edgeline.plans.registry import query
from edgeline.session import materialise
from edgeline.sources import adapter

LEVEL_NAMES = ["edge_level_2001", "edge_level_2020"]


def n_side_column():
    """Points per side of each transect length, as a column over ``length_km``."""
    pairs = [F.lit(value) for km, n_side, _ in adapter.LENGTHS for value in (km, n_side)]
    return F.create_map(*pairs)[F.col("length_km")]


VIEWS["levels_long"] = """
SELECT site_id, 'edge_level_2001' AS "group", edge_level_2001 AS value FROM levels
  WHERE perc_evaluated_2020 >= 0.3
UNION ALL SELECT site_id, 'edge_level_2020', edge_level_2020 FROM levels
  WHERE perc_evaluated_2020 >= 0.3"""


@query("e08_levels_long", "SELECT * FROM levels_long", dbl="value")
def _(v):
    return rates.levels_long(rates.reported_sites(rs.levels(v)), LEVEL_NAMES)


_HISTOGRAM = """
SELECT "group", bin, count(*) AS n, lo + (hi - lo) / 50 * bin AS bin_lo,
       lo + (hi - lo) / 50 * (bin + 1) AS bin_hi
FROM (SELECT l."group", b.lo, b.hi,
        CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin
      FROM levels_long l JOIN (SELECT "group", min(value) AS lo, max(value) AS hi
                               FROM levels_long GROUP BY 1) b ON l."group" = b."group"
      WHERE value IS NOT NULL)
GROUP BY "group", bin, lo, hi"""


@query("e09_level_histogram", _HISTOGRAM, dbl="bin_lo bin_hi")
def _(v):
    return rates.histograms(rates.reported_sites(rs.levels(v)), LEVEL_NAMES)


def _feistel(value: str) -> str:
    """Four rounds on digits to the base a, with multipliers m and offsets o per site-year."""
    left, right = f"({value} // a)", f"({value} % a)"
    for i in range(4):
        left, right = right, f"(({left} + (({right} * m{i} + o{i}) % 2147483647)) % a)"
    return f"{left} * a + {right}"


def _shuffled(mode: str) -> str:
    digits = lambda kind, i: (f"CAST('0x' || substr(md5(site_id || '_' || year || '_1_{kind}'), "
                              f"{1 + 7 * i}, 7) AS BIGINT)")
    keys = ", ".join(f"{digits('m', i)} + 1 AS m{i}, {digits('o', i)} AS o{i}" for i in range(4))
    drawn = f"""WITH RECURSIVE numbered AS (
      SELECT site_id, year, transect_id, grad, i, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, {keys}
      FROM (SELECT site_id, year, transect_id, grad,
              row_number() OVER (PARTITION BY site_id, year ORDER BY transect_id) AS i,
              count(*) OVER (PARTITION BY site_id, year) AS n
            FROM complete WHERE pnt_pst = 0 AND year IN (2001, 2020))),
    walk AS (
      SELECT *, {_feistel('(i - 1)')} AS place FROM numbered
      UNION ALL SELECT * REPLACE ({_feistel('place')} AS place) FROM walk WHERE place >= n)
    SELECT site_id, year, transect_id, grad, i, place + 1 AS slot FROM walk WHERE place < n"""
    if mode == "literal":
        return f"""SELECT site_id, year, slot AS transect_id, transect_id AS source_id, grad
      FROM ({drawn})"""
    return f"""WITH drawn AS MATERIALIZED ({drawn})
      SELECT d.site_id, d.year, s.transect_id, d.transect_id AS source_id, d.grad
      FROM drawn d JOIN drawn s ON s.site_id = d.site_id AND s.year = d.year AND s.i = d.slot"""


def _null_views(mode: str) -> dict[str, str]:
    return {
        "shuffled": _shuffled(mode),
        "null_diffs": """
SELECT o.site_id, o.transect_id, o.year, o.pnt_pst, b.grad - o.grad AS diff
FROM complete o LEFT JOIN shuffled b
  ON o.site_id = b.site_id AND o.transect_id = b.transect_id AND o.year = b.year
WHERE o.pnt_pst <> 0 AND o.year IN (2001, 2020)""",
        "null_sides": """
SELECT site_id, transect_id, year, pnt_pst < 0 AS inner_side FROM null_diffs GROUP BY ALL
HAVING count(*) = count(diff) AND count(*) FILTER (diff > 0) > 0""",
        "null_edges": """
SELECT site_id, transect_id, year FROM null_sides GROUP BY ALL HAVING count(*) = 2""",
        "null_levels": """
SELECT l.site_id, perc_evaluated_2020, perc_evaluated_2001,
  coalesce(edge_level_2020, 0) AS edge_level_2020, coalesce(n20.n, 0) AS ntrsct_null_2020,
  coalesce(n20.n, 0) / nullif(ntrsct_2020_eva, 0) AS edge_level_2020_null2,
  coalesce(edge_level_2001, 0) AS edge_level_2001, coalesce(n01.n, 0) AS ntrsct_null_2001,
  coalesce(n01.n, 0) / nullif(ntrsct_2001_eva, 0) AS edge_level_2001_null2
FROM levels l
LEFT JOIN (SELECT site_id, count(*) AS n FROM null_edges WHERE year = 2020 GROUP BY 1) n20
  USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS n FROM null_edges WHERE year = 2001 GROUP BY 1) n01
  USING (site_id)""",
    }


NULL_DENSE, NULL_LITERAL = _null_views("dense"), _null_views("literal")
_NULL_DBL = ("perc_evaluated_2020 perc_evaluated_2001 edge_level_2020 edge_level_2020_null2 "
             "edge_level_2001 edge_level_2001_null2")


def complete_two_years(v):
    """Complete samples of both years, written once for the steps that read them."""
    rows = v.samples().filter(F.col("year").isin(2001, 2020))
    return materialise(sm.complete_transects(rows).drop("n"), "complete_two_years")


def null_levels(v, mode: str = "dense"):
    # The measured levels need the same two years, so they read the written samples.
    complete = complete_two_years(v)
    levels = sm.edge_levels(v.placed(), v.original_counts(), complete)
    return nullmodel.null_edge_levels(complete, levels, mode=mode)


@query("e10_shuffled_borders", "SELECT * FROM shuffled", dbl="grad", views=NULL_DENSE)
def _(v):
    return nullmodel.shuffled_borders(complete_two_years(v), [2001, 2020])


@query("e10_shuffled_borders_literal", "SELECT * FROM shuffled", dbl="grad", views=NULL_LITERAL)
def _(v):
    return nullmodel.shuffled_borders(complete_two_years(v), [2001, 2020], mode="literal")


@query("e11_null_edge_level", "SELECT * FROM null_levels", dbl=_NULL_DBL, views=NULL_DENSE)
def _(v):
    return null_levels(v)


@query("e11_null_edge_level_literal", "SELECT * FROM null_levels", dbl=_NULL_DBL,
       views=NULL_LITERAL)
def _(v):
    return null_levels(v, "literal")


def _null_long(year: int) -> dict[str, str]:
    pair = (f"edge_level_{year}", f"edge_level_{year}_null2")
    return {**NULL_DENSE, "levels_long": " UNION ALL ".join(
        f"""SELECT site_id, '{name}' AS "group", {name} AS value FROM null_levels
        WHERE perc_evaluated_{year} >= 0.3""" for name in pair)}


def _null_reported(v, year: int):
    """Reported sites of a year with their measured and null level, and the level names."""
    kept = null_levels(v).filter(F.col(f"perc_evaluated_{year}") >= 0.3)
    return kept, [f"edge_level_{year}", f"edge_level_{year}_null2"]


@query("e08_levels_long_null_2020", "SELECT * FROM levels_long", dbl="value",
       views=_null_long(2020))
def _(v):
    return rates.levels_long(*_null_reported(v, 2020))


@query("e08_levels_long_null_2001", "SELECT * FROM levels_long", dbl="value",
       views=_null_long(2001))
def _(v):
    return rates.levels_long(*_null_reported(v, 2001))


@query("e09_null_histogram_2020", _HISTOGRAM, dbl="bin_lo bin_hi", views=_null_long(2020))
def _(v):
    return rates.histograms(*_null_reported(v, 2020))


@query("e09_null_histogram_2001", _HISTOGRAM, dbl="bin_lo bin_hi", views=_null_long(2001))
def _(v):
    return rates.histograms(*_null_reported(v, 2001))


@query("e14_transect_totals", """
SELECT count(DISTINCT (site_id, transect_id)) AS n_transects, count(*) / 20 AS n_by_years,
       count(DISTINCT site_id) AS n_sites FROM flagged""", dbl="n_by_years")
def _(v):
    # Distinct transects of a site are counted per site first, then summed.
    wide = sm.complete_wide(v.samples())
    per_site = (wide.groupBy("site_id", "transect_id").agg(F.count(F.lit(1)).alias("rows"))
                .groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")))
    kept = per_site.join(rates.reported_sites(rs.levels(v)).select("site_id"), "site_id",
                         "left_semi")
    return kept.agg(F.sum("n").alias("n_transects"), (F.sum("rows") / 20).alias("n_by_years"),
                    F.count(F.lit(1)).alias("n_sites"))


@query("e15_counts_by_biome", """
SELECT biome, count(*) FILTER (year = 2020) AS n_transects, count(DISTINCT site_id) AS n_sites
FROM flagged GROUP BY biome""")
def _(v):
    counts = rs.reported_year_counts(v)
    per_site = counts.groupBy("biome", "site_id").agg(
        F.sum(F.when(F.col("year") == 2020, F.col("n")).otherwise(0)).alias("n"))
    return per_site.groupBy("biome").agg(F.sum("n").alias("n_transects"),
                                         F.count(F.lit(1)).alias("n_sites"))


VIEWS["global_rate"] = """
SELECT year, count(*) FILTER (edge) AS n_edge,
       count(*) FILTER (edge) / ((SELECT count(*) FROM flagged) / 20) AS perc_edge
FROM flagged GROUP BY year HAVING count(*) FILTER (edge) > 0"""
VIEWS["biome_rate"] = """
SELECT f.biome, f.year, f.n_edge, d.n, f.n_edge / d.n AS perc_edge
FROM (SELECT biome, year, count(*) AS n_edge FROM flagged WHERE edge GROUP BY ALL) f
LEFT JOIN (SELECT biome, count(*) AS n FROM flagged WHERE year = 2020 GROUP BY 1) d USING (biome)"""


@query("e16_global_year_share", "SELECT * FROM global_rate", dbl="perc_edge")
def _(v):
    return rates.global_year_share(rs.reported_year_counts(v))


@query("e17_biome_year_share", "SELECT * FROM biome_rate", dbl="perc_edge")
def _(v):
    return rates.group_year_share(rs.reported_year_counts(v), ["biome"])


@query("e17_biome_year_share_per_year", """
SELECT biome, year, count(*) FILTER (edge) AS n_edge, count(*) AS n,
       count(*) FILTER (edge) / count(*) AS perc_edge
FROM flagged GROUP BY ALL HAVING count(*) FILTER (edge) > 0""", dbl="perc_edge")
def _(v):
    return rates.group_year_share(rs.reported_year_counts(v), ["biome"], "per_year")


VIEWS["class_counts"] = """
SELECT biome, count(*) FILTER (edge_change = 'Significantly Decrease') AS significantly_decrease,
  count(*) FILTER (edge_change = 'Not significantly Decrease') AS not_significantly_decrease,
  count(*) FILTER (edge_change = 'Significantly Increase') AS significantly_increase,
  count(*) FILTER (edge_change = 'Not significantly Increase') AS not_significantly_increase,
  count(*) FILTER (edge_change NOT IN ('Stable', 'unknown')) AS total
FROM reported GROUP BY biome"""


@query("e18_class_counts", "SELECT * FROM class_counts")
def _(v):
    return rates.class_counts(rs.reported(v))


@query("e18_class_shares", """
SELECT biome, 'Significantly Decrease' AS variable, 1 AS position,
       significantly_decrease / nullif(total, 0) AS value FROM class_counts
UNION ALL SELECT biome, 'Not significantly Decrease', 2,
       not_significantly_decrease / nullif(total, 0) FROM class_counts
UNION ALL SELECT biome, 'Significantly Increase', 3,
       significantly_increase / nullif(total, 0) FROM class_counts
UNION ALL SELECT biome, 'Not significantly Increase', 4,
       not_significantly_increase / nullif(total, 0) FROM class_counts""", dbl="value")
def _(v):
    return rates.class_shares(rs.reported(v))


# ---- transect length sensitivity ------------------------------------------
_SIDES = " ".join(f"WHEN {km} THEN {n}" for km, n, _ in adapter.LENGTHS)
VIEWS["len_complete"] = f"""
SELECT g.* FROM gs_all g JOIN (
  SELECT length_km, site_id, transect_id FROM gs_all WHERE year = 2020 GROUP BY ALL
  HAVING count(*) = 2 * (CASE length_km {_SIDES} END) + 1) c
USING (length_km, site_id, transect_id)"""
VIEWS["len_wide"] = f"""
SELECT length_km, site_id, transect_id, year, max(grad) FILTER (pnt_pst = 0) AS bd,
  max(grad) FILTER (pnt_pst = -(CASE length_km {_SIDES} END)) AS inn,
  max(grad) FILTER (pnt_pst = (CASE length_km {_SIDES} END)) AS outr
FROM len_complete GROUP BY ALL"""
VIEWS["len_sides"] = """
SELECT o.length_km, o.site_id, o.transect_id, o.year, o.pnt_pst < 0 AS inner_side
FROM len_complete o LEFT JOIN (SELECT * FROM len_complete WHERE pnt_pst = 0) b
  USING (length_km, site_id, transect_id, year)
WHERE o.pnt_pst <> 0 AND o.year IN (2001, 2020)
GROUP BY ALL HAVING count(*) = count(b.grad - o.grad)
  AND count(*) FILTER (b.grad - o.grad > 0) > 0"""
VIEWS["len_levels"] = """
SELECT e.length_km, o.site_id, o.ntrsct, p.n AS ntrsct_2,
  coalesce(e20, 0) AS ntrsct_2020_eva, coalesce(e01, 0) AS ntrsct_2001_eva,
  x20 AS ntrsct_2020_edge, coalesce(e20, 0) / nullif(o.ntrsct, 0) AS perc_evaluated_2020,
  x20 / nullif(e20, 0) AS edge_level_2020,
  x01 AS ntrsct_2001_edge, coalesce(e01, 0) / nullif(o.ntrsct, 0) AS perc_evaluated_2001,
  x01 / nullif(e01, 0) AS edge_level_2001
FROM ori_counts o
JOIN (SELECT site_id, count(*) AS n FROM placed GROUP BY 1) p USING (site_id)
CROSS JOIN (SELECT unnest([5, 10, 15]) AS length_km) e
LEFT JOIN (SELECT length_km, site_id, count(*) FILTER (year = 2020) AS e20,
             count(*) FILTER (year = 2001) AS e01
           FROM len_complete WHERE pnt_pst = 0 GROUP BY ALL) ev USING (length_km, site_id)
LEFT JOIN (SELECT length_km, site_id, nullif(count(*) FILTER (year = 2020), 0) AS x20,
             nullif(count(*) FILTER (year = 2001), 0) AS x01
           FROM (SELECT length_km, site_id, transect_id, year FROM len_sides GROUP BY ALL
                 HAVING count(*) = 2) GROUP BY ALL) ed USING (length_km, site_id)"""
VIEWS["len_flagged"] = f"""
SELECT w.*, bd > inn AND bd > outr AS edge, {rs.biome_sql('global')} AS group_biome
FROM len_wide w JOIN (SELECT length_km, site_id FROM len_levels WHERE perc_evaluated_2020 >= 0.3) l
  USING (length_km, site_id) LEFT JOIN sites s USING (site_id)"""


def length_levels(v):
    """Edge levels of all transect lengths in one plan."""
    km = F.array(*[F.lit(k) for k, _, _ in adapter.LENGTHS])
    placed = v.placed().select("*", F.explode(km).alias("length_km"))
    return sm.edge_levels(placed, v.original_counts(), v.samples_all(),
                          n_points=2 * n_side_column() + 1, by=["length_km"])


def length_counts(v, years=None):
    """Transects and edges per length, reported site and year, with biome."""
    by = ["length_km"]
    counts = rates.site_years(v.samples_all(), n_side_column(), by, years=years).withColumnRenamed(
        "n_outermost", "n_edge")
    kept = rates.reported_site_years(counts, v.placed(), v.original_counts(), by)
    biome = v.sites().select("site_id", labels.regroup_biome(F.col("biome")).alias("biome"))
    return kept.select(*by, "site_id", "year", "n", "n_edge").join(biome, "site_id", "left")


@query("e19_share_by_length", """
SELECT length_km, count(*) FILTER (edge AND year = 2020) AS n_edge, count(*) / 20 AS ntrnsc,
       count(*) FILTER (edge AND year = 2020) / (count(*) / 20) AS perc_edge
FROM len_flagged GROUP BY 1""", dbl="ntrnsc perc_edge")
def _(v):
    out = length_counts(v).groupBy("length_km").agg(
        F.sum(F.when(F.col("year") == 2020, F.col("n_edge")).otherwise(0)).alias("n_edge"),
        (F.sum("n") / 20).alias("ntrnsc"))
    return out.withColumn("perc_edge", F.try_divide(F.col("n_edge"), F.col("ntrnsc")))


@query("e20_length_biome_table", """
SELECT length_km, group_biome AS biome, count(*) FILTER (edge) AS n_edge, count(*) AS n,
       count(*) FILTER (edge) / count(*) AS perc_edge
FROM len_flagged WHERE year = 2020 GROUP BY ALL HAVING count(*) FILTER (edge) > 0""",
       dbl="perc_edge")
def _(v):
    shares = rates.group_year_share(length_counts(v, [2020]), ["length_km", "biome"])
    return shares.drop("year")


@query("e21_edge_level_by_length", "SELECT * FROM len_levels WHERE length_km <> 10",
       dbl="perc_evaluated_2020 edge_level_2020 perc_evaluated_2001 edge_level_2001",
       ints="ntrsct ntrsct_2 ntrsct_2020_eva ntrsct_2001_eva ntrsct_2020_edge ntrsct_2001_edge")
def _(v):
    return length_levels(v).filter(F.col("length_km") != 10)
