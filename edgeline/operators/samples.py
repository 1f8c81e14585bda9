"""Completeness, differences and edge rules over yearly gradient samples.

Rows are (site_id, transect_id, pnt_pst, year, grad); pnt_pst is negative
inside the border, 0 on it and positive outside. The per-transect work is one
conditional aggregation with map-side combine instead of self-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("site_id", "transect_id")
REF_YEAR = 2020


def complete_transects(samples: DataFrame, n_points: int | Column = 5,
                       ref_year: int = REF_YEAR, keys: Sequence[str] = KEY) -> DataFrame:
    """Keep all years of the transects with exactly ``n_points`` rows in the
    reference year, and carry that count as ``n``.

    The counts, one row per transect, are hashed, so the samples are not sorted.
    """
    counts = (samples.filter(F.col("year") == ref_year).groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_points))
    return samples.join(counts.hint("shuffle_hash"), list(keys))


def border_differences(samples: DataFrame, years: Sequence[int] | None = None,
                       keys: Sequence[str] = KEY) -> DataFrame:
    """Border gradient minus the gradient of every other point of its transect.

    A missing border row or a missing gradient gives a NULL difference.
    """
    if years is not None:
        samples = samples.filter(F.col("year").isin(list(years)))
    w = Window.partitionBy(*keys, "year")
    border = F.max(F.when(F.col("pnt_pst") == 0, F.col("grad"))).over(w)
    return (samples.withColumn("border", border).filter(F.col("pnt_pst") != 0)
            .withColumn("diff", F.col("border") - F.col("grad")))


def passing_sides(differences: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of the sides where the border exceeds at least one point.

    A NULL difference makes the side's sum NULL and drops the side.
    """
    side = F.when(F.col("pnt_pst") < 0, "inner").otherwise("outer")
    w = Window.partitionBy(*keys, "year", "side")
    above = F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).over(w)
    unknown = F.count_if(F.col("diff").isNull()).over(w)
    return (differences.withColumn("side", side)
            .withColumn("n_above", above).withColumn("n_unknown", unknown)
            .filter((F.col("n_unknown") == 0) & (F.col("n_above") > 0))
            .drop("n_unknown"))


def _side_columns(at: Column, tag: str) -> list[Column]:
    pnt, grad = F.col("pnt_pst"), F.col("grad")
    inner, outer = at & (pnt < 0), at & (pnt > 0)
    return [
        F.max(F.when(at & (pnt == 0), grad)).alias(f"bd_{tag}"),
        F.count_if(at & (pnt == 0)).alias(f"eva_{tag}"),
        F.min(F.when(inner, grad)).alias(f"inner_{tag}"),
        F.count_if(inner & grad.isNull()).alias(f"inner_null_{tag}"),
        F.min(F.when(outer, grad)).alias(f"outer_{tag}"),
        F.count_if(outer & grad.isNull()).alias(f"outer_null_{tag}"),
    ]


def _strict_edge(tag: str) -> Column:
    bd = F.col(f"bd_{tag}")
    return F.coalesce(
        (bd > F.col(f"inner_{tag}")) & (F.col(f"inner_null_{tag}") == 0)
        & (bd > F.col(f"outer_{tag}")) & (F.col(f"outer_null_{tag}") == 0), F.lit(False))


def transect_flags(samples: DataFrame, years: Sequence[int] = (2001, 2020),
                   n_points: int | Column = 5, ref_year: int = REF_YEAR,
                   keys: Sequence[str] = KEY) -> DataFrame:
    """One row per complete transect with ``eva_<year>`` and ``edge_<year>``.

    The border exceeds some point of a side exactly when it exceeds the side's
    minimum, so the strict rule needs a minimum and a NULL count per side. Only
    the requested years are read and the data is shuffled once.
    """
    wanted = sorted({*years, ref_year})
    aggs = [F.count_if(F.col("year") == ref_year).alias("n")]
    for year in years:
        aggs += _side_columns(F.col("year") == year, str(year))
    grouped = (samples.filter(F.col("year").isin(wanted)).groupBy(*keys).agg(*aggs)
               .filter(F.col("n") == n_points))
    return grouped.select(
        *keys, "n",
        *[(F.col(f"eva_{y}") > 0).alias(f"eva_{y}") for y in years],
        *[_strict_edge(str(y)).alias(f"edge_{y}") for y in years])


def strict_edges(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Distinct (transect, year) that are edges under the strict rule."""
    by = [*keys, "year"]
    grouped = samples.groupBy(*by).agg(*_side_columns(F.lit(True), "y"))
    return grouped.filter(_strict_edge("y")).select(*by)


def site_stage_counts(placed: DataFrame, original: DataFrame, flags: DataFrame,
                      years: Sequence[int] = (2020, 2001)) -> DataFrame:
    """Transects per site at each stage: raw, placed, evaluated. Missing is 0."""
    placed_n = placed.groupBy("site_id").agg(F.count(F.lit(1)).alias("ntrsct_2"))
    evaluated = flags.groupBy("site_id").agg(
        *[F.count_if(f"eva_{y}").alias(f"ntrsct_{y}_eva") for y in years])
    names = ["ntrsct", "ntrsct_2"] + [f"ntrsct_{y}_eva" for y in years]
    return (original.join(placed_n, "site_id")     # inner: only placed sites count
            .join(evaluated, "site_id", "left").na.fill(0, names)
            .select("site_id", *names))


def edge_levels(placed: DataFrame, original: DataFrame, samples: DataFrame,
                years: Sequence[int] = (2020, 2001), n_points: int | Column = 5,
                ref_year: int = REF_YEAR, by: Sequence[str] = ()) -> DataFrame:
    """Per-site edge counts, evaluated share and edge level for each year.

    A site without any edge has NULL edges and NULL level, as in the export.
    ``by`` adds grouping columns that placed and samples share, such as the
    transect length; the original counts are per site only.
    """
    flags = transect_flags(samples, years, n_points, ref_year, [*by, *KEY])
    counts = []
    for y in years:
        counts += [F.count_if(f"eva_{y}").alias(f"ntrsct_{y}_eva"),
                   F.nullif(F.count_if(f"edge_{y}"), F.lit(0)).alias(f"ntrsct_{y}_edge")]
    site = [*by, "site_id"]
    per_site = flags.groupBy(*site).agg(*counts)
    placed_n = placed.groupBy(*site).agg(F.count(F.lit(1)).alias("ntrsct_2"))
    eva = [f"ntrsct_{y}_eva" for y in years]
    out = (original.join(placed_n, "site_id").join(per_site, site, "left")
           .na.fill(0, ["ntrsct", "ntrsct_2", *eva]))
    cols = [*site, "ntrsct", "ntrsct_2", *eva]
    for y in years:
        e, n = F.col(f"ntrsct_{y}_edge"), F.col(f"ntrsct_{y}_eva")
        cols += [e, F.try_divide(n, F.col("ntrsct")).alias(f"perc_evaluated_{y}"),
                 F.try_divide(e, n).alias(f"edge_level_{y}")]
    return out.select(*cols)


def fill_missing_levels(levels: DataFrame) -> DataFrame:
    """The zero-filled view of ``edge_levels`` that feeds the figures."""
    numeric = [n for n, t in levels.dtypes if t in ("bigint", "double", "int")]
    return levels.na.fill(0, numeric)


def site_attributes(points_info: DataFrame) -> DataFrame:
    """Distinct site attributes from the annotated points."""
    dropped = {"transect_id", "pnt_pst", "x", "y"}
    return points_info.select(*[c for c in points_info.columns if c not in dropped]).distinct()


def wide_transects(samples: DataFrame, n_side: int = 2, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per transect and year: inner<n>..inner1, bd, outer1..outer<n>."""
    aggs = []
    for i in range(-n_side, n_side + 1):
        name = "bd" if i == 0 else f"{'inner' if i < 0 else 'outer'}{abs(i)}"
        aggs.append(F.max(F.when(F.col("pnt_pst") == i, F.col("grad"))).alias(name))
    return samples.groupBy(*keys, "year").agg(*aggs, F.count(F.lit(1)).alias("n_rows"))


def complete_wide(samples: DataFrame, n_points: int | Column = 5, n_side: int = 2,
                  ref_year: int = REF_YEAR, keys: Sequence[str] = KEY) -> DataFrame:
    """``wide_transects`` of the complete transects.

    The samples are folded to one row per transect-year before the completeness
    semi-join, so the join moves a fifth of the rows.
    """
    ids = (samples.filter(F.col("year") == ref_year).groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_points)
           .select(*keys))
    return wide_transects(samples, n_side, keys).drop("n_rows").join(ids, list(keys), "left_semi")


def edge_flag(rule: str = "any_pair", n_side: int = 2) -> Column:
    """Edge indicator on wide rows with three-valued logic: 1, 0 or NULL.

    ``any_pair``: the border exceeds some inner and some outer point.
    ``outermost``: it exceeds both points of the outermost pair.
    """
    bd = F.col("bd")
    if rule == "any_pair":
        inner = outer = F.lit(False)
        for i in range(n_side, 0, -1):
            inner, outer = inner | (bd > F.col(f"inner{i}")), outer | (bd > F.col(f"outer{i}"))
        hit = inner & outer
    elif rule == "outermost":
        hit = (bd > F.col(f"inner{n_side}")) & (bd > F.col(f"outer{n_side}"))
    else:
        raise ValueError(f"unknown edge rule {rule!r}")
    return F.when(hit, 1).when(~hit, 0)
