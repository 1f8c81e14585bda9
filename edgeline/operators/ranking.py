"""Exact numbering and quantiles that never gather a whole group in one task.

A window over a large group sorts that group in one task. ``number_rows`` first cuts
the group into blocks by value, so that one task sees one block; ``rank_rows`` numbers
a whole table along Spark's own range partitions; ``quantile_values`` narrows counted
brackets until a rank is proven to lie in one of a few values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.session import materialise

# At most four in this many rows stay in the bracket that the sketch proposes.
SKETCH_ACCURACY = 100_000
# Rows of a bracket that are fetched as they are, and equal steps that a larger one is cut to.
FEW, STEPS = 4096, 32
# Bits of ``monotonically_increasing_id`` that count rows inside a partition.
ID_BITS = 33


def number_rows(df: DataFrame, groups: Sequence[str], levels: Sequence[Sequence[Column]],
                order: Sequence[Column], out: str) -> DataFrame:
    """1-based row number inside ``groups`` by ``order``, computed block by block.

    ``levels`` are block keys from coarse to fine; their lexicographic order must
    agree with ``order``, and neither they nor the groups may be NULL. Block sizes
    are counted with map-side combine, running totals of the counts give each block
    its offset, and rows are numbered inside their block only.
    """
    groups = list(groups)
    names: list[list[str]] = []
    for i, level in enumerate(levels):
        names.append([f"__b{i}_{j}" for j in range(len(level))])
        df = df.withColumns(dict(zip(names[-1], level)))
    keys = groups + [n for level in names for n in level]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))

    # Offsets: one running total per level over the block counts.
    offsets = None
    for i, level in enumerate(names):
        prefix = groups + [n for done in names[:i] for n in done]
        w = (Window.partitionBy(*prefix).orderBy(*level)
             .rowsBetween(Window.unboundedPreceding, -1))
        sizes = counts.groupBy(*prefix, *level).agg(F.sum("__n").alias("__n"))
        step = sizes.select(*prefix, *level,
                            F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(f"__off{i}"))
        offsets = step if offsets is None else offsets.join(step, prefix)
    total = sum((F.col(f"__off{i}") for i in range(len(names))), F.lit(0).cast("long"))
    offsets = offsets.select(*keys, total.alias("__off"))

    # The window and the join hash on the same keys, so the rows move once.
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (df.withColumn("__rn", inside).join(offsets, keys)
            .withColumn(out, F.col("__off") + F.col("__rn"))
            .drop("__rn", "__off", *[n for level in names for n in level]))


def id_levels(column: Column) -> list[list[Column]]:
    """Two block levels for a whole-number id, for numbering a whole table."""
    return [[F.floor(column / (1 << 32))], [F.floor(column / (1 << 16))]]


def rank_rows(df: DataFrame, order: Sequence[Column], out: str, total: str | None = None
              ) -> DataFrame:
    """1-based rank of every row of the table by ``order``, which must tell all rows apart.

    Spark samples the order and deals rows to ranges of it, whatever their values, so
    outliers and sparse ids make no large task. Rows are written with their place inside
    their range; the ranges' sizes, one number for each partition, give the offsets.
    ``total`` names a column for the number of rows.
    """
    order = list(order)
    names = [f"__o{i}" for i in range(len(order))]
    placed = (df.withColumns(dict(zip(names, order))).repartitionByRange(*names)
              .sortWithinPartitions(*names).drop(*names)
              .withColumn("__at", F.monotonically_increasing_id()))
    placed = materialise(placed, "ranked")
    part = F.shiftright("__at", ID_BITS)
    sizes = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    before, running = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(running)
        running += sizes.get(p, 0)
    offset = F.get(F.lit(before), part.cast("int")) if before else F.lit(0).cast("long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    placed = placed.withColumn(out, offset + inside + 1)
    if total is not None:
        placed = placed.withColumn(total, F.lit(running).cast("long"))
    return placed.drop("__at")


def _interpolate(prob: float, n: Column) -> tuple[Column, Column, Column]:
    """1-based ranks around the linear-interpolation position, and the weight."""
    pos = (n - 1) * F.lit(prob)
    low = F.floor(pos)
    return low + 1, F.ceil(pos) + 1, pos - low


def _quantiles_by_rank(values: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from (keys, value, count, below, n) rows, one per distinct value.

    A row marked as a gap's end proves its last rank only.
    """
    w = Window.partitionBy(*keys).orderBy("__v")
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("__c"))
    aggs = []
    for name, prob in probs.items():
        r0, r1, weight = _interpolate(prob, F.col("__n"))
        held = lambda r: F.when((F.col("__lo") < r) & (F.col("__hi") >= r)
                                & (~F.col("__end") | (F.col("__hi") == r)), F.col("__v"))
        aggs += [F.max(held(r0)).alias(f"{name}__0"), F.max(held(r1)).alias(f"{name}__1"),
                 F.max(weight).alias(f"{name}__w")]
    out = ranked.groupBy(*keys).agg(*aggs)
    # A rank that no single value holds lies in a gap: the sketch broke its bound.
    wrong = F.raise_error(F.lit("a quantile lies outside its sketch's bracket")).cast("double")
    held = lambda n, i: F.coalesce(F.col(f"{n}__{i}"), wrong)
    value = lambda n: held(n, 0) + (held(n, 1) - held(n, 0)) * F.col(f"{n}__w")
    return out.select(*keys, *[value(n).alias(n) for n in probs])


def _bracketed(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
               accuracy: int) -> DataFrame:
    """Exact quantiles from one bounded sketch and one recount near its answers.

    ``percentile_approx`` guarantees a rank error below n/accuracy, so an exact
    value lies between the sketch values two such steps below and above, or next
    to them. Rows inside a bracket are counted by distinct value. Rows between
    brackets collapse to one counted row per gap that keeps its smallest and
    largest value; no other rank of a gap can be asked for.
    """
    slack = 2.0 / accuracy
    asked = [p for prob in probs.values()
             for p in (max(0.0, prob - slack), min(1.0, prob + slack))]
    ends = F.percentile_approx(value, F.array(*[F.lit(p) for p in asked]), F.lit(accuracy))
    df = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__x"))
    bounds = df.withColumnRenamed("__x", value).groupBy(*keys).agg(
        F.struct(ends.alias("e"), F.count(F.lit(1)).alias("n")).alias("__b"))
    marked = df.join(bounds, keys)
    x, inside, gap = F.col("__x"), F.lit(False), F.lit(0)
    for i in range(0, len(asked), 2):
        lo, hi = F.col("__b.e")[i], F.col("__b.e")[i + 1]
        inside = inside | ((x >= lo) & (x <= hi))
        gap = gap + (x > lo).cast("int") + (x > hi).cast("int")
    counted = (marked.withColumn("__gap", F.when(~inside, gap))
               .withColumn("__k", F.when(F.col("__gap").isNull(), x))
               .groupBy(*keys, "__gap", "__k")
               .agg(F.count(F.lit(1)).alias("__m"), F.max("__b.n").alias("__n"),
                    F.min("__x").alias("__min"), F.max("__x").alias("__max")))
    entry = lambda v, c, end: F.struct(v.alias("__v"), c.alias("__c"), F.lit(end).alias("__end"))
    one = F.array(entry(F.col("__min"), F.col("__m"), False))
    two = F.array(entry(F.col("__min"), F.lit(1).cast("long"), False),
                  entry(F.col("__max"), F.col("__m") - 1, True))
    split = F.col("__gap").isNotNull() & (F.col("__m") > 1)
    entries = counted.select(*keys, "__n", F.inline(F.when(split, two).otherwise(one)))
    return _quantiles_by_rank(entries, keys, probs)


@dataclass
class _Bracket:
    """Rows from ``low`` to ``high`` hold the asked ranks; ``below`` rows are smaller."""
    low: float
    high: float
    below: int
    count: int
    ranks: list[int]


def _sketch(column: DataFrame, brackets: list[_Bracket], accuracy: int) -> list[list[float]]:
    """Values near the asked ranks of every bracket, by one bounded sketch each."""
    x = F.col("x")
    aggs = []
    for i, b in enumerate(brackets):
        near = [min(1.0, max(0.0, (r - b.below) / b.count + d))
                for r in b.ranks for d in (-2.0 / accuracy, 2.0 / accuracy)]
        inside = F.when((x >= b.low) & (x <= b.high), x)
        aggs.append(F.percentile_approx(inside, F.array(*map(F.lit, near)), F.lit(accuracy))
                    .alias(f"s{i}"))
    row = column.agg(*aggs).collect()[0]
    return [list(v or []) for v in row]


def _bin(x: Column, ends: Sequence[float], first: int = 0) -> Column:
    """Odd for a value equal to an end, even for one between two, by a tree of comparisons."""
    if not ends:
        return F.lit(2 * first)
    mid = len(ends) // 2
    return (F.when(x < ends[mid], _bin(x, ends[:mid], first))
            .when(x == ends[mid], F.lit(2 * (first + mid) + 1))
            .otherwise(_bin(x, ends[mid + 1:], first + mid + 1)))


def _narrowed(column: DataFrame, brackets: list[_Bracket], accuracy: int) -> list[_Bracket]:
    """Each rank's bracket inside its present one, by one exact count of bins.

    Bins end at the sketch's values, at equal steps, and at the bracket's own ends. The
    count decides which bin holds a rank, so a sketch that is wrong costs a pass and no
    more; as the two ends are bins of their own, every pass leaves fewer values.
    """
    ends = set()
    for b, near in zip(brackets, _sketch(column, brackets, accuracy)):
        steps = [b.low + (b.high - b.low) * (i / STEPS) for i in range(1, STEPS)]
        ends |= {e for e in [b.low, b.high, *near, *steps] if b.low <= e <= b.high}
    ends = sorted(ends)
    x = F.col("x")
    within = F.lit(False)
    for b in brackets:
        within = within | ((x >= b.low) & (x <= b.high))
    bins = {r.bin: r for r in column.filter(within).groupBy(_bin(x, ends).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    out = []
    for b in brackets:
        upto = b.below
        for k in sorted(k for k, r in bins.items() if b.low <= r.low and r.high <= b.high):
            held = [r for r in b.ranks if upto < r <= upto + bins[k].n]
            if held:
                out.append(_Bracket(bins[k].low, bins[k].high, upto, bins[k].n, held))
            upto += bins[k].n
    return out


def quantile_values(df: DataFrame, value: str, probs: dict[str, float],
                    accuracy: int = SKETCH_ACCURACY) -> dict[str, float | None]:
    """Exact linear-interpolation quantiles (R type 7) of a column, NULL and NaN left out.

    Brackets narrow until they hold few rows or one value; every step counts them, so a
    rank is proven inside its bracket before a value is read. The column is written
    once; the driver sees a fixed number of bins and at most ``FEW`` values a bracket.
    """
    column = materialise(df.select(F.col(value).cast("double").alias("x")).filter(
        "x IS NOT NULL AND NOT isnan(x)"), "quantile-column")
    whole = column.agg(F.count("x").alias("n"), F.min("x").alias("low"),
                       F.max("x").alias("high")).collect()[0]
    if not whole.n:
        return dict.fromkeys(probs)
    places = {name: (whole.n - 1) * p for name, p in probs.items()}
    ranks = sorted({f(at) + 1 for at in places.values() for f in (math.floor, math.ceil)})
    brackets = [_Bracket(whole.low, whole.high, 0, whole.n, ranks)]
    at: dict[int, float] = {}
    small: list[_Bracket] = []
    while brackets:
        at.update({r: b.low for b in brackets if b.low == b.high for r in b.ranks})
        brackets = [b for b in brackets if b.low < b.high]
        small += [b for b in brackets if b.count <= FEW]
        brackets = [b for b in brackets if b.count > FEW]
        if brackets:
            brackets = _narrowed(column, brackets, accuracy)
    if small:
        x, within = F.col("x"), F.lit(False)
        for b in small:
            within = within | ((x >= b.low) & (x <= b.high))
        rows = sorted((r.x, r.n) for r in column.filter(within).groupBy("x").agg(
            F.count(F.lit(1)).alias("n")).collect())
        for b in small:
            upto = b.below
            for v, n in rows:
                if b.low <= v <= b.high:
                    at.update({r: v for r in b.ranks if upto < r <= upto + n})
                    upto += n
    low = {name: at[math.floor(p) + 1] for name, p in places.items()}
    high = {name: at[math.ceil(p) + 1] for name, p in places.items()}
    return {name: low[name] + (high[name] - low[name]) * (p - math.floor(p))
            for name, p in places.items()}


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact linear-interpolation quantiles per group (R type 7).

    A whole column goes through ``quantile_values`` at once and comes back as one row of
    constants. Groups, whatever their size, go through a sketch bracket and a recount.
    """
    if keys:
        return _bracketed(df, list(keys), value, probs, accuracy)
    found = quantile_values(df, value, probs, accuracy)
    return df.sparkSession.range(1).select(
        *[F.lit(v).cast("double").alias(n) for n, v in found.items()])


def running_totals(df: DataFrame, groups: Sequence[str], block: Column, order: Column,
                   value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` inside ``groups``, block by block.

    Adds ``out`` (sum up to and including the row) and ``<out>_total`` (sum of
    the group). Blocks bound what one task sorts.
    """
    groups = list(groups)
    df = df.withColumn("__block", block).withColumn("__val", value)
    keys = [*groups, "__block"]
    w = Window.partitionBy(*groups)
    before = w.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.sum("__val").alias("__s")).select(
        *keys, F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__off"),
        F.sum("__s").over(w).alias(f"{out}_total"))
    inside = (Window.partitionBy(*keys).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("__local", F.sum("__val").over(inside)).join(offsets, keys)
            .withColumn(out, F.col("__off") + F.col("__local"))
            .drop("__block", "__val", "__local", "__off"))
