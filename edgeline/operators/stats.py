"""Regressions, t-tests, ANOVA and Tukey comparisons.

Every statistic starts from mergeable grouped sums (``regr_*``, moments), so
one pass with map-side combine feeds a closed form on the small result. Python
sees only those result rows, for p-values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import inference as inf
from edgeline.operators.ranking import quantile_values, rank_rows
from edgeline.operators.samples import REF_YEAR
from edgeline.session import materialise

#: Factor levels in a block, on average at most.
PAIR_BLOCK = 512


def ols(df: DataFrame, keys: Sequence[str], y: str, x: Column, extra: Sequence[Column] = (),
        p_values: bool = True) -> DataFrame:
    """Simple linear regression of y on x per group; rows with a NULL drop out."""
    xy = (F.col(y), x)
    sums = df.groupBy(*keys).agg(
        F.regr_count(*xy).alias("nobs"), F.regr_sxx(*xy).alias("sxx"),
        F.regr_syy(*xy).alias("syy"), F.regr_sxy(*xy).alias("sxy"),
        F.regr_avgx(*xy).alias("mx"), F.regr_avgy(*xy).alias("my"), *extra)
    n, sxx, syy, sxy = (F.col(c) for c in ("nobs", "sxx", "syy", "sxy"))
    slope = F.try_divide(sxy, sxx)
    sse = F.greatest(syy - F.try_divide(sxy * sxy, sxx), F.lit(0.0))
    df_res = F.when(n > 2, n - 2)
    sigma2 = F.try_divide(sse, df_res)
    se = F.sqrt(F.try_divide(sigma2, sxx))
    r2 = F.try_divide(syy - sse, syy)
    kept = [c for c in sums.columns if c not in
            ("nobs", "sxx", "syy", "sxy", "mx", "my")]
    out = sums.select(
        *kept, n.alias("n_obs"), slope.alias("slope"), se.alias("std_err"),
        F.try_divide(slope, se).alias("t_value"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.sqrt(sigma2 * (F.try_divide(F.lit(1.0), n)
                         + F.try_divide(F.col("mx") * F.col("mx"), sxx))).alias("intercept_se"),
        r2.alias("r2"), (1 - (1 - r2) * (n - 1) / df_res).alias("adj_r2"),
        F.try_divide(syy - sse, sigma2).alias("f_value"), F.sqrt(sigma2).alias("sigma"),
        df_res.alias("df_res"), F.col("mx").alias("mean_x"), sxx.alias("sxx"))
    if not p_values:
        return out
    return out.withColumn("p_value", inf.t_p_value("t_value", F.col("df_res").cast("double")))


def site_trends(samples: DataFrame, n_points: int = 5, ref_year: int = REF_YEAR,
                p_values: bool = True) -> DataFrame:
    """Linear trend of the border gradient per site over the complete transects."""
    keys = ["site_id", "transect_id"]
    counts = (samples.filter(F.col("year") == ref_year).groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_points).select(*keys))
    border = samples.filter(F.col("pnt_pst") == 0).join(counts, keys, "left_semi")
    out = ols(border, ["site_id"], "grad", F.col("year").cast("double"),
              extra=[F.count_distinct("transect_id").alias("n_transects")], p_values=p_values)
    cols = ["site_id", "n_transects", "slope", "std_err", "t_value"]
    return out.select(*cols, *(["p_value"] if p_values else []))


def one_sample_t(df: DataFrame, value: str) -> DataFrame:
    row = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                 F.count(value).alias("n"))
    se = F.try_divide(F.col("sd"), F.sqrt("n"))
    return (row.withColumn("t_value", F.try_divide(F.col("mean"), se))
            .withColumn("df", (F.col("n") - 1).cast("double")))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    return one_sample_t(df.select((F.col(a) - F.col(b)).alias("d")), "d")


def welch_t(df: DataFrame, a: str, b: str) -> DataFrame:
    row = df.agg(*[f(c).alias(f"{n}_{s}") for c, s in ((a, "a"), (b, "b")) for f, n in
                   ((F.avg, "mean"), (F.var_samp, "var"), (F.count, "n"))])
    va, vb = (F.try_divide(F.col(f"var_{s}"), F.col(f"n_{s}")) for s in "ab")
    df_w = F.try_divide((va + vb) * (va + vb),
                        F.try_divide(va * va, F.col("n_a") - 1)
                        + F.try_divide(vb * vb, F.col("n_b") - 1))
    return row.select("mean_a", "mean_b",
                      F.try_divide(F.col("mean_a") - F.col("mean_b"),
                                   F.sqrt(va + vb)).alias("t_value"), df_w.alias("df"))


def with_t_test(row: DataFrame) -> DataFrame:
    return row.withColumn("p_value", inf.t_p_value("t_value", "df"))


def _group_moments(df: DataFrame, group: str, y: str) -> DataFrame:
    return (df.filter(F.col(y).isNotNull() & F.col(group).isNotNull())
            .groupBy(F.col(group).alias("grp"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
                 (F.var_pop(y) * F.count(F.lit(1))).alias("ssw")))


def _error_terms(moments: DataFrame) -> DataFrame:
    """One row with group count, error degrees of freedom and mean square."""
    out = moments.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
                      F.sum("ssw").alias("ss_within"))
    df_w = (F.col("total") - F.col("k")).cast("double")
    return out.select("k", "total", df_w.alias("df_within"), "ss_within",
                      F.try_divide(F.col("ss_within"), df_w).alias("ms_within"))


def anova(df: DataFrame, group: str, y: str, p_values: bool = True) -> DataFrame:
    """One-way analysis of variance from group moments."""
    moments = _group_moments(df, group, y)
    # Around the grand mean, so that a large mean does not cancel the spread.
    grand = moments.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    apart = F.col("mean") - F.col("grand")
    row = moments.withColumn("grand", grand).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
        F.sum("ssw").alias("ss_within"),
        F.sum(F.col("n") * apart * apart).alias("ss_between"))
    df_b = (F.col("k") - 1).cast("double")
    df_w = (F.col("total") - F.col("k")).cast("double")
    msb, msw = F.try_divide(F.col("ss_between"), df_b), F.try_divide(F.col("ss_within"), df_w)
    out = row.select(df_b.alias("df_between"), df_w.alias("df_within"), "ss_between",
                     "ss_within", msb.alias("ms_between"), msw.alias("ms_within"),
                     F.try_divide(msb, msw).alias("f_value"))
    if not p_values:
        return out
    return out.withColumn("p_value", inf.f_p_value("f_value", "df_between", "df_within"))


def tukey(df: DataFrame, group: str, y: str, alpha: float = 0.05,
          p_values: bool = True) -> DataFrame:
    """Honest significant differences for unequal group sizes.

    The result has one row per pair of factor levels by definition. The table of group
    means is cut into blocks of levels and every two blocks meet in a task of their own, so
    no task and no row holds all levels.
    """
    moments = materialise(_group_moments(df, group, y), "group-moments")
    terms = _error_terms(moments)
    blocks = F.ceil(terms.select("k").scalar() / PAIR_BLOCK).cast("int")
    placed = moments.withColumn("blocks", F.greatest(blocks, F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("grp"), F.col("blocks")).cast("int"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("grp", "mean", "n")]
    left = placed.select(*side("a"), F.col("block").alias("ba"),
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bb"))
    right = placed.select(*side("b"), F.col("block").alias("bb"),
                          F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ba"))
    pairs = left.join(right, ["ba", "bb"]).filter("grp_b > grp_a").drop("ba", "bb")
    fields = F.struct("k", "df_within", "ms_within").alias("e")
    pairs = pairs.withColumn("e", terms.select(fields).scalar())
    se = F.sqrt(F.col("e.ms_within") / 2 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    out = pairs.select(
        F.concat_ws("-", "grp_b", "grp_a").alias("pair"),
        (F.col("mean_b") - F.col("mean_a")).alias("diff"), se.alias("se"),
        F.try_divide(F.abs(F.col("mean_b") - F.col("mean_a")), se).alias("q_value"),
        F.col("e.k").alias("k"), F.col("e.df_within").alias("df_within"))
    if not p_values:
        return out
    k = F.col("k").cast("double")
    margin = inf.tukey_quantile(F.lit(alpha), k, F.col("df_within")) * F.col("se")
    return (out.withColumn("margin", margin)
            .withColumn("p_adj", inf.tukey_p_value(F.col("q_value"), k, F.col("df_within")))
            .withColumn("lwr", F.col("diff") - F.col("margin"))
            .withColumn("upr", F.col("diff") + F.col("margin")).drop("margin"))


def residual_quantiles(df: DataFrame, group: str, y: str, key: str) -> DataFrame:
    """Standardised group residuals, their ranks and the normal quantiles of these.

    Residuals are ranked along sampled ranges, ties by a hash of the key and the key, so
    neither an outlier nor a common value fills a task. ``key`` must be unique. A group of
    one row has no standardised residual and is left out.
    """
    moments = _group_moments(df, group, y)
    terms = _error_terms(moments).select(F.col("ms_within"))
    rows = (df.filter(F.col(y).isNotNull()).select(F.col(key), F.col(group).alias("grp"),
                                                    F.col(y).alias("y"))
            .join(moments.select("grp", "n", "mean"), "grp").withColumn("ms", terms.scalar()))
    resid = F.col("y") - F.col("mean")
    rows = rows.select(key, "grp", resid.alias("resid"), F.try_divide(
        resid, F.sqrt(F.col("ms") * (1 - 1.0 / F.col("n")))).alias("std_resid"))
    rows = rows.filter(F.col("std_resid").isNotNull())
    tie = F.substring(F.md5(F.col(key).cast("binary")), 1, 4)
    ranked = rank_rows(rows, [F.col("std_resid"), tie, F.col(key)], "rank", "total")
    return ranked.select(key, "grp", "resid", "std_resid", "rank",
                         inf.probit((F.col("rank") - 0.5) / F.col("total")).alias("theoretical"))


def six_numbers(df: DataFrame, value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum in one row."""
    kept = materialise(df.select(value), "six-numbers")
    mid = quantile_values(kept, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q1, median, q3 = (F.lit(mid[n]).cast("double").alias(n) for n in ("q1", "median", "q3"))
    return kept.agg(F.min(value).alias("min"), F.avg(value).alias("mean"),
                    F.max(value).alias("max")).select("min", q1, median, "mean", q3, "max")


def confidence_band(points: DataFrame, keys: Sequence[str], y: str, x: str,
                    level: float = 0.95) -> DataFrame:
    """Fitted line and confidence band at the observed x values of each group."""
    keys = list(keys)
    fit = ols(points, keys, y, F.col(x).cast("double"), p_values=False)
    quantile = inf.t_quantile(F.lit(1 - level), F.col("df_res").cast("double"))
    fit = fit.withColumn("tq", quantile)
    at = points.select(*keys, x).join(
        fit.select(*keys, "slope", "intercept", "sigma", "n_obs", "mean_x", "sxx", "tq"), keys)
    centred = F.col(x) - F.col("mean_x")
    se = F.col("sigma") * F.sqrt(1.0 / F.col("n_obs") + centred * centred / F.col("sxx"))
    line = F.col("intercept") + F.col("slope") * F.col(x)
    return at.select(*keys, x, line.alias("fit"), se.alias("se_fit"),
                     (line - F.col("tq") * se).alias("lwr"), (line + F.col("tq") * se).alias("upr"))


def describe_sites(sites: DataFrame) -> DataFrame:
    """Counts, ranges, medians and spreads of area and transects in one row.

    Three ISO codes stand for disputed or joint areas and are taken off.
    """
    sites = materialise(sites.select("iso3", "biome", "gis_area", "ntrsct_2020_eva"), "sites")
    out = sites.agg(
        F.count(F.lit(1)).alias("n_sites"), (F.count_distinct("iso3") - 3).alias("n_countries"),
        F.count_distinct(F.coalesce("biome", F.lit(""))).alias("n_biomes"),
        *[f(c).alias(f"{n}_{s}") for c, s in (("gis_area", "area"),
                                              ("ntrsct_2020_eva", "transects"))
          for f, n in ((F.min, "min"), (F.max, "max"), (F.stddev_samp, "sd"))])
    for c, s in (("gis_area", "area"), ("ntrsct_2020_eva", "transects")):
        median = quantile_values(sites, c, {"m": 0.5})["m"]
        out = out.withColumn(f"median_{s}", F.lit(median).cast("double"))
    return out
