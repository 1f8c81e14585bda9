"""Mixing sources to target weights by fitting a subset sum of document lengths.

Targets: every source gets its share of all words by weight; a source stops at
``MOST`` times its own words and what it leaves is shared by weight among the rest,
which is one water level found from running totals over the sources.

Fit: documents are counted by exact length. A source takes all its documents as
often as the target holds its size; the budget that remains is filled by length
counts: a proportional part of every length, then the largest lengths that fit,
and the last words by bounded-knapsack dynamic programming over the sums that
lengths still unused can reach. Only (source, length, count) rows take part in
that, so a task holds one source's distinct lengths, not its documents.

Selection: of every source and length the documents first in seeded hash order are
taken once more. Ranks are counted block by block, so a hot length is never sorted
in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeline.llm.tables import word_count
from edgeline.operators.ranking import number_rows

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20
#: Sums that the dynamic programming covers; larger lengths are taken before it starts.
REACH = 1 << 15


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) per source of a (source, source_size) table.

    Sources are ordered by code point with NULL last and weigh ``weights`` in turn.
    One task sees one row per source. With no words at all every target is 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
                            ).withColumn("cap", most * F.col("source_size").cast("double"))
    level_at = F.col("cap") / F.col("w")         # water level that fills a source
    by_level = Window.orderBy(level_at, F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (total - full) / open_weight).withColumn("fills", level_at)
    # The level is the first that does not fill the next source.
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(everything)
    return rows.withColumn("level", level["level"]).select(
        "source", "source_size",
        F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words sum to ``budget``.

    Exact whenever the open lengths reach the last words; otherwise the nearest sum
    below. ``budget`` is at most the sum of all.
    """
    order = np.argsort(-lengths, kind="stable")
    size, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * count).sum())
    taken = np.zeros(len(size), dtype=np.int64)
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    # A proportional part of every length leaves less than one document of each.
    taken = np.array([int(c) * budget // total for c in count], dtype=np.int64)
    left = budget - int((size * taken).sum())
    # The largest lengths that fit, as long as the rest is beyond the table below.
    for i in range(len(size)):
        if left <= REACH:
            break
        more = min(int(count[i] - taken[i]), max(0, (left - REACH // 2)) // max(int(size[i]), 1))
        taken[i] += more
        left -= more * int(size[i])
    taken, left = _knapsack(size, count, taken, left)
    out = np.empty_like(taken)
    out[order] = taken
    return out


def _knapsack(size, count, taken, left):
    """Adds lengths that sum to ``left`` or the nearest reachable sum below it."""
    left = int(left)
    usable = [i for i in range(len(size)) if 0 < size[i] <= left and taken[i] < count[i]]
    reached, steps = 1, []                       # bit s: sum s can be reached
    mask = (1 << (left + 1)) - 1
    for i in usable:
        room, part = min(int(count[i] - taken[i]), left // int(size[i])), 1
        while room > 0:                          # a count in binary parts
            part = min(part, room)
            new = (reached | reached << int(size[i]) * part) & mask
            if new != reached:
                steps.append((i, part, reached))
                reached = new
            room -= part
            part *= 2
        if reached >> left & 1:
            break
    best = reached.bit_length() - 1
    at = best
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= int(size[i]) * part
    return taken, left - best


def plan(counts: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, rounds, extra): whole passes, and documents to take once more."""
    goals = goals.withColumnRenamed("source", "__source")
    joined = counts.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole, goal = int(rows.source_size.iloc[0]), int(round(rows.target.iloc[0]))
        rounds = min(goal // whole, most) if whole else 0
        extra = (np.zeros(len(rows), dtype=np.int64) if rounds >= most else
                 fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), goal - rounds * whole))
        return rows.assign(rounds=rounds, extra=extra)[
            ["source", "size", "source_size", "target", "rounds", "extra"]]

    return joined.groupBy("source").applyInPandas(
        run, "source string, size long, source_size long, target double, rounds long, extra long")


def _placed(docs: DataFrame, text: str, weights: tuple[int, ...], most: int, seed: int
            ) -> DataFrame:
    """``docs`` with its size, source size, target and repeats under private names."""
    key = F.col("doc_id")
    rows = docs.withColumns({"__size": word_count(F.col(text)),
                             "__h": F.xxhash64(F.coalesce(key, F.lit(-1)), F.lit(seed))})
    slim = docs.select("source", word_count(F.col(text)).alias("size"))
    counts = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    chosen = plan(counts, targets(sums, weights, most), most)
    of = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__s")
    chosen = chosen.select(of, *[F.col(c).alias(f"__{c}") for c in (
        "size", "source_size", "target", "rounds", "extra")])
    ranked = number_rows(rows.select("*", of), ["__s", "__size"], [[F.shiftright("__h", 52)]],
                         [F.col("__h"), key], "__rank")
    joined = ranked.join(chosen, ["__s", "__size"])
    repeats = F.col("__rounds") + (F.col("__rank") <= F.col("__extra")).cast("long")
    return (joined.withColumn("__repeats", repeats)
            .select(*docs.columns, "__size", "__source_size", "__target", "__repeats"))


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, seed: int = SEED) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``taken`` to every row of ``docs``.

    ``taken`` is the words of a document times its repeats in the mix, 0 to ``most``
    times. Texts without words take part with size 0 and are taken 0 words. Equal
    rows of one id and length are interchangeable, so reruns agree. Columns of these four
    names are replaced, any others stay.
    """
    out = _placed(docs, text, weights, most, seed)
    return out.withColumns({"size": F.col("__size"), "source_size": F.col("__source_size"),
                            "target": F.col("__target"),
                            "taken": F.col("__size") * F.col("__repeats")}).drop(
        "__size", "__source_size", "__target", "__repeats")


def mixed(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS,
          most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` with words as often as it is taken, unchanged."""
    out = _placed(docs, text, weights, most, seed).filter(
        (F.col("__size") > 0) & (F.col("__repeats") > 0))
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__repeats"))))
            .select(*docs.columns))
