"""Edge rates by year, biome and transect length.

Transect rows are folded to (site, year) counts before any site attribute is
joined, so the attribute join moves sites and not transects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.functions.labels import CLASS_ORDER
from edgeline.operators.samples import KEY, REF_YEAR


def reported_sites(levels: DataFrame, threshold: float = 0.3, year: int = REF_YEAR) -> DataFrame:
    """Sites where enough of the border could be evaluated."""
    return levels.filter(F.col(f"perc_evaluated_{year}") >= threshold)


def site_years(samples: DataFrame, n_side: int | Column = 2, by: Sequence[str] = (),
               ref_year: int = REF_YEAR, years: Sequence[int] | None = None) -> DataFrame:
    """Counts per site and year under every edge rule, from one fold of the samples.

    A transect-year keeps its border gradient, the least gradient and the NULLs of each
    side, and the outermost pair. All rules follow from these: the border exceeds some
    point of a side exactly when it exceeds the side's least known gradient (``any_pair``),
    ``strict`` asks for no NULL besides, ``outermost`` compares the last pair. A transect
    counts if it has ``2 * n_side + 1`` rows in the reference year, which a window over
    its few years tells, so the samples are neither read nor moved a second time. With
    ``years`` only these and the reference year are read and counted.

    Columns: ``by``, site_id, year, n (transects), n_evaluated (with a border row),
    n_any_pair, n_strict, n_outermost.
    """
    keys, pnt, grad = [*by, *KEY], F.col("pnt_pst"), F.col("grad")
    if years is not None:
        # Stated here: a filter behind the window would not reach the scan.
        samples = samples.filter(F.col("year").isin(sorted({*years, ref_year})))
    samples = samples.withColumn("n_side", n_side if isinstance(n_side, Column) else F.lit(n_side))
    sides = [(name, at, far) for name, at, far in (
        ("inner", pnt < 0, pnt == -F.col("n_side")), ("outer", pnt > 0, pnt == F.col("n_side")))]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max("n_side").alias("n_side"),
            F.max(F.when(pnt == 0, grad)).alias("bd"), F.count_if(pnt == 0).alias("n_bd")]
    for name, at, far in sides:
        aggs += [F.min(F.when(at, grad)).alias(f"{name}_least"),
                 F.count_if(at & grad.isNull()).alias(f"{name}_nulls"),
                 F.max(F.when(far, grad)).alias(f"{name}_far")]
    years = samples.groupBy(*keys, "year").agg(*aggs)
    reference = F.max(F.when(F.col("year") == ref_year, F.col("n_rows")))
    whole = (years.withColumn("n_ref", reference.over(Window.partitionBy(*keys)))
             .filter(F.col("n_ref") == 2 * F.col("n_side") + 1))
    bd = F.col("bd")
    some = (bd > F.col("inner_least")) & (bd > F.col("outer_least"))
    strict = some & (F.col("inner_nulls") == 0) & (F.col("outer_nulls") == 0)
    return whole.groupBy(*by, "site_id", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_bd") > 0).alias("n_evaluated"),
        F.count_if(some).alias("n_any_pair"), F.count_if(strict).alias("n_strict"),
        F.count_if((bd > F.col("inner_far")) & (bd > F.col("outer_far"))).alias("n_outermost"))


def reported_site_years(counts: DataFrame, placed: DataFrame, original: DataFrame,
                        by: Sequence[str] = (), threshold: float = 0.3,
                        ref_year: int = REF_YEAR) -> DataFrame:
    """Rows of ``site_years`` of the placed sites whose border was evaluated to at least
    ``threshold`` in the reference year. A window over a site's years finds the share."""
    site = Window.partitionBy(*by, "site_id")
    evaluated = F.max(F.when(F.col("year") == ref_year, F.col("n_evaluated"))).over(site)
    borders = original.join(placed.select("site_id").distinct(), "site_id", "left_semi")
    return (counts.withColumn("evaluated", evaluated).join(borders, "site_id")
            .filter(F.try_divide(F.col("evaluated"), F.col("ntrsct")) >= threshold)
            .select(*counts.columns))


def site_year_counts(flagged: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Transects and edges per site and year from rows with an ``edge`` flag."""
    return flagged.groupBy(*by, "year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("edge") == 1).alias("n_edge"))


def global_year_share(counts: DataFrame, n_years: int = 20) -> DataFrame:
    """Edge share per year over a constant transect count (rows / years)."""
    yearly = counts.groupBy("year").agg(F.sum("n").alias("n"), F.sum("n_edge").alias("n_edge"))
    # At most one row per calendar year reaches this window.
    total = F.sum("n").over(Window.partitionBy()) / n_years
    return (yearly.withColumn("ntrnsc", total).filter(F.col("n_edge") > 0)
            .select("year", "n_edge", (F.col("n_edge") / F.col("ntrnsc")).alias("perc_edge")))


def group_year_share(counts: DataFrame, group: Sequence[str], denominator: str = "reference",
                     ref_year: int = REF_YEAR) -> DataFrame:
    """Edge share per year and group.

    The denominator is the group's count in the reference year, or with
    ``per_year`` the count of the same year.
    """
    group = list(group)
    yearly = counts.groupBy(*group, "year").agg(F.sum("n").alias("n_year"),
                                                F.sum("n_edge").alias("n_edge"))
    if denominator == "per_year":
        out = yearly.withColumn("n", F.col("n_year"))
    elif denominator == "reference":
        w = Window.partitionBy(*group)
        out = yearly.withColumn(
            "n", F.max(F.when(F.col("year") == ref_year, F.col("n_year"))).over(w))
    else:
        raise ValueError(f"unknown denominator {denominator!r}")
    return (out.filter(F.col("n_edge") > 0)
            .select(*group, "year", "n_edge", "n",
                    F.try_divide(F.col("n_edge"), F.col("n")).alias("perc_edge")))


def year_shares_with_total(counts: DataFrame, group: str, total: str = "Global",
                           n_years: int = 20, ref_year: int = REF_YEAR) -> DataFrame:
    """Yearly edge share of every group and of the whole, from one aggregation.

    The whole uses its rows over all years divided by ``n_years`` as denominator,
    a group its count in the reference year.
    """
    labelled = counts.select("year", "n", "n_edge",
                             F.explode(F.array(F.lit(total), F.col(group))).alias(group))
    yearly = labelled.groupBy(group, "year").agg(F.sum("n").alias("n"),
                                                 F.sum("n_edge").alias("n_edge"))
    w = Window.partitionBy(group)      # one row per calendar year
    over_years = F.sum("n").over(w) / n_years
    reference = F.max(F.when(F.col("year") == ref_year, F.col("n"))).over(w)
    below = F.when(F.col(group) == total, over_years).otherwise(reference.cast("double"))
    return (yearly.withColumn("d", below).filter(F.col("n_edge") > 0)
            .select(group, "year", F.try_divide(F.col("n_edge"), F.col("d")).alias("perc_edge")))


def class_counts(classed: DataFrame, group: str = "biome", cls: str = "edge_change") -> DataFrame:
    """Sites per group in each trend class, wide; the total leaves out the
    stable and unknown classes."""
    wide = classed.groupBy(group).agg(
        *[F.count_if(F.col(cls) == c).alias(_column(c)) for c in CLASS_ORDER])
    total = sum((F.col(_column(c)) for c in CLASS_ORDER), F.lit(0).cast("long"))
    return wide.withColumn("total", total)


def class_shares(classed: DataFrame, group: str = "biome", cls: str = "edge_change") -> DataFrame:
    """Share of each trend class per group, long, with the class order."""
    wide = class_counts(classed, group, cls)
    long = wide.select(group, "total", F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.lit(i + 1).alias("position"),
                 F.col(_column(c)).alias("n")) for i, c in enumerate(CLASS_ORDER)])))
    return long.select(group, "variable", "position",
                       F.try_divide(F.col("n"), F.col("total")).alias("value"))


def _column(label: str) -> str:
    return label.lower().replace(" ", "_")


def levels_long(levels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Wide level columns to (site_id, group, value)."""
    return levels.unpivot("site_id", list(names), "group", "value")


def histograms(levels: DataFrame, names: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width histogram of each column between its own minimum and maximum."""
    ends = levels.agg(F.struct(*[
        F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in names]).alias("b"))
    marked = levels.select(*names).withColumn("b", ends.scalar())
    slots = []
    for n in names:
        lo, hi = F.col(f"b.{n}.lo"), F.col(f"b.{n}.hi")
        slot = F.least(F.floor(F.try_divide(F.col(n) - lo, hi - lo) * bins), F.lit(bins - 1))
        slots.append(F.struct(F.lit(n).alias("group"), F.coalesce(slot, F.lit(0)).alias("bin"),
                              F.col(n).alias("value"), lo.alias("lo"), hi.alias("hi")))
    rows = marked.select(F.inline(F.array(*slots))).filter(F.col("value").isNotNull())
    out = rows.groupBy("group", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    return out.select("group", "bin", "n", (F.col("lo") + width * F.col("bin")).alias("bin_lo"),
                      (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_hi"))


def outermost_edges(samples: DataFrame, n_side: Column, ref_year: int = REF_YEAR) -> DataFrame:
    """Single-pair edge flags for several transect lengths in one pass.

    ``n_side`` gives the outermost position per row; a transect is kept when it
    has all ``2 * n_side + 1`` points in the reference year.
    """
    keys = ["length_km", *KEY]
    samples = samples.withColumn("n_side", n_side)
    pnt, grad = F.col("pnt_pst"), F.col("grad")
    ids = (samples.filter(F.col("year") == ref_year).groupBy(*keys, "n_side")
           .agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") == 2 * F.col("n_side") + 1).select(*keys))
    rows = samples.groupBy(*keys, "year").agg(
        F.max(F.when(pnt == 0, grad)).alias("bd"),
        F.max(F.when(pnt == -F.col("n_side"), grad)).alias("inn"),
        F.max(F.when(pnt == F.col("n_side"), grad)).alias("out"))
    hit = (F.col("bd") > F.col("inn")) & (F.col("bd") > F.col("out"))
    return (rows.join(ids, keys, "left_semi")
            .select(*keys, "year", F.when(hit, 1).when(~hit, 0).alias("edge")))
