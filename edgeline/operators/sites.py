"""Registry filters, keys, and attribute joins on site tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import labels
from edgeline.operators.ranking import quantile_values, rank_rows


def terrestrial_sites(registry: DataFrame) -> DataFrame:
    """Terrestrial polygon sites with a kept status.

    A NULL designation fails the ``!=`` tests; a NULL id stays, because the
    exclusion list is a membership test that is false on NULL.
    """
    kept = ((F.col("type") == "Polygon") & (F.col("marine") == 0)
            & F.col("status").isin(labels.KEPT_STATUS))
    for designation in labels.DROPPED_DESIGNATIONS:
        kept = kept & (F.col("desig_eng") != designation)
    misfiled = F.coalesce(F.col("site_id").isin(labels.MISFILED_MARINE_IDS), F.lit(False))
    return registry.filter(kept & ~misfiled)


def minimum_area(sites: DataFrame, km2: float = 200.0) -> DataFrame:
    return sites.filter(F.col("gis_area") >= km2)


def below_quantile(df: DataFrame, value: str, prob: float = 0.75) -> DataFrame:
    """Rows strictly below an exact quantile of the column."""
    cut = quantile_values(df, value, {"cut": prob})["cut"]
    # A constant, so the filter reaches the scan; of no value nothing is below.
    return df.filter(F.col(value) < F.lit(cut).cast("double"))


def semi_filter(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(ids, on, "left_semi")


def anti_filter(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(ids, on, "left_anti")


def join_key(*parts: str | Column) -> Column:
    """Composite text key."""
    return F.concat_ws("_", *parts)


def split_key(key: str | Column, names: Sequence[str], types: Sequence[str]) -> list[Column]:
    pieces = F.split(key, "_")
    return [pieces[i].cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types))]


def row_ids(df: DataFrame, order: str, name: str = "lineid") -> DataFrame:
    """Consecutive ids in the order of a column of different values, however sparse."""
    return rank_rows(df, [F.col(order)], name)


def with_country(sites: DataFrame, country: DataFrame) -> DataFrame:
    """Left join of the country dimension, one row per site.

    The dimension is reduced to one row per key first, so no site row is
    duplicated and no site has to be de-duplicated afterwards.
    """
    one = country.groupBy("iso3").agg(F.min("country").alias("country"))
    return sites.join(one, "iso3", "left")
