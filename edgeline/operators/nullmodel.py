"""Permutation null model: border points are shuffled among a site's transects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.operators.ranking import number_rows
from edgeline.operators.samples import strict_edges
from edgeline.session import materialise

# Transect ids of a site-year are numbered in ranges of this length.
ID_BLOCK = 65_536
# Feistel rounds, the prime of their arithmetic, and hex digits of a multiplier or offset.
ROUNDS, PRIME, DIGITS = 4, (1 << 31) - 1, 7
# Steps of the walk back below n. Up to n = 200 no walk is longer; beyond, a step fails
# with a probability below 2 / sqrt(n) + 1 / n.
WALK = 32


def round_keys(seed: int) -> Column:
    """Multiplier and offset of every round for one site-year, from two digests."""
    def digits(kind: str) -> Column:
        return F.md5(F.concat_ws("_", "site_id", "year", F.lit(seed), F.lit(kind)).cast("binary"))

    def number(kind: str, i: int) -> Column:
        return F.conv(F.substring(digits(kind), 1 + DIGITS * i, DIGITS), 16, 10).cast("long")

    return F.struct(*[c for i in range(ROUNDS) for c in (
        (number("m", i) + 1).alias(f"m{i}"), number("o", i).alias(f"o{i}"))])


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Place of ``index`` in a keyed permutation of 0 .. n - 1, without a sort.

    A Feistel network on pairs of digits to the base a, the least with a * a >= n, permutes
    0 .. a * a - 1; a value that falls on n or more is put through it again until it does
    not, which keeps the walk a permutation of 0 .. n - 1.
    """
    a = F.ceil(F.sqrt(n.cast("double")))

    def once(value: Column) -> Column:
        left, right = F.floor(value / a), value % a
        for i in range(ROUNDS):
            mixed = (right * keys[f"m{i}"] + keys[f"o{i}"]) % PRIME
            left, right = right, (left + mixed) % a
        return left * a + right

    first = once(index)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first,
                        lambda v, _: F.when(v >= n, once(v)).otherwise(v))
    place = F.when(first < n, first).otherwise(again)
    return F.when(place < n, place).otherwise(
        F.raise_error(F.lit("a permutation's walk did not end")).cast("long"))


def shuffled_borders(complete: DataFrame, years: Sequence[int], seed: int = 1,
                     mode: str = "dense") -> DataFrame:
    """Assign every border sample of a site-year to another transect slot.

    The transects of a site-year are numbered once, and a keyed permutation of these
    numbers names the slots, so reruns and lost tasks give the same result. ``literal``
    uses the slot itself as transect id, which leaves gaps where ids do not run from 1;
    ``dense`` uses the transect that holds that number, one join of the written rows.
    """
    if mode not in ("dense", "literal"):
        raise ValueError(f"unknown null-model mode {mode!r}")
    border = (complete.filter(F.col("year").isin(list(years)) & (F.col("pnt_pst") == 0))
              .select("site_id", "year", "transect_id", "grad"))
    sizes = (border.groupBy("site_id", "year").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("keys", round_keys(seed)))
    numbered = number_rows(border, ["site_id", "year"],
                           [[F.floor(F.col("transect_id") / ID_BLOCK)]],
                           [F.col("transect_id")], "i")
    slot = permuted(F.col("i") - 1, F.col("n"), F.col("keys")) + 1
    drawn = numbered.join(sizes, ["site_id", "year"]).select(
        "site_id", "year", "transect_id", "grad", "i", slot.alias("slot"))
    if mode == "literal":
        return drawn.select("site_id", "year", F.col("slot").alias("transect_id"),
                            F.col("transect_id").alias("source_id"), "grad")
    drawn = materialise(drawn, "shuffled-borders")
    slots = drawn.select("site_id", "year", "transect_id", F.col("i").alias("slot"))
    return (slots.join(drawn.select("site_id", "year", F.col("transect_id").alias("source_id"),
                                    "slot", "grad"), ["site_id", "year", "slot"])
            .select("site_id", "year", "transect_id", "source_id", "grad"))


def null_samples(complete: DataFrame, years: Sequence[int], seed: int = 1,
                 mode: str = "dense") -> DataFrame:
    """Samples whose border rows are replaced by the shuffled ones."""
    cols = ["site_id", "transect_id", "pnt_pst", "year", "grad"]
    others = complete.filter(F.col("year").isin(list(years)) & (F.col("pnt_pst") != 0))
    border = shuffled_borders(complete, years, seed, mode).withColumn("pnt_pst", F.lit(0))
    return others.select(*cols).unionByName(border.select(*cols))


def null_edge_levels(complete: DataFrame, levels: DataFrame, years: Sequence[int] = (2020, 2001),
                     seed: int = 1, mode: str = "dense") -> DataFrame:
    """Measured and null edge level per site, missing levels as zero."""
    edges = strict_edges(null_samples(complete, years, seed, mode))
    per_site = edges.groupBy("site_id").agg(
        *[F.count_if(F.col("year") == y).alias(f"ntrsct_null_{y}") for y in years])
    joined = levels.join(per_site, "site_id", "left").na.fill(
        0, [f"ntrsct_null_{y}" for y in years] + [f"edge_level_{y}" for y in years])
    return joined.select(
        "site_id", *[f"perc_evaluated_{y}" for y in years],
        *[c for y in years for c in (
            F.col(f"edge_level_{y}"), F.col(f"ntrsct_null_{y}"),
            F.try_divide(F.col(f"ntrsct_null_{y}"), F.col(f"ntrsct_{y}_eva"))
            .alias(f"edge_level_{y}_null2"))])
