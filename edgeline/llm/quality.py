"""Quality rules: base measures and a hashed n-gram log-likelihood ratio.

Two-word n-grams are hashed to buckets; the first word of a text stands alone. Two
multinomials with add-one counts are estimated over the buckets, one from trusted
documents and one from the whole corpus. A document's log ratio is the mean log ratio
of the two over its n-grams: it is kept when that is at least ``threshold``.

There are two features, ``WHOLE`` of whole words and ``ENDS`` of their last ``ENDING``
characters, which keep inflection, case, punctuation and attached signs. Each has its
own buckets and multinomials; with both the log ratio is the sum of their means.

Everything is a column expression: one pass counts buckets with map-side combine,
the scoring pass looks the weights up in one array of fixed size and moves no row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.tables import let, word_list

BUCKETS = 1 << 13
#: Labelled good documents that stand for the trusted target, in hash order.
TRUSTED_ROWS = 20_000
#: Mean log ratio per n-gram from which a document is kept.
THRESHOLD = -0.2
SYMBOLS = "[#*$%&|<>]"
ENDING = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio")
#: Features: characters of a word's end (None for the whole word) and number of buckets.
ENDS = (ENDING, BUCKETS)
WHOLE = (None, BUCKETS)
WINDOW = 8
_GAPS = " \t\n\x0b\x0c\r"


def grams(words: Column, feature: tuple[int | None, int] = ENDS, first: int = 0) -> Column:
    """Bucket of every word with the one before it, repeats included, from ``first`` on."""
    ending, buckets = feature
    ends = words if ending is None else F.transform(
        words, lambda w: F.substring(w, -ending, ending))
    return let(ends, lambda es: F.transform(es, lambda e, i: F.lit(first) + F.pmod(
        F.xxhash64(e, F.get(es, i - 1)), F.lit(buckets)).cast("int")))


def placed(features: tuple) -> list[tuple[tuple[int | None, int], int]]:
    """Every feature with its first bucket in the common table."""
    sizes = [buckets for _, buckets in features]
    return [(f, sum(sizes[:i])) for i, f in enumerate(features)]


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that the text holds twice or more.

    Windows are compared by their 64-bit hash. Only where two are equal are they
    sorted with their places; the words they cover are the sum of the steps between
    places, each at most one window long.
    """
    def windows(one: Column) -> Column:
        # The hash of 8 words from those of 4 and 4, and so on.
        return joined(joined(joined(one, 1), 2), 4)

    def joined(one: Column, step: int) -> Column:
        count = lambda hs: F.greatest(F.size(hs) - step, F.lit(0))
        return let(one, lambda hs: F.zip_with(
            F.slice(hs, 1, count(hs)), F.slice(hs, 1 + step, count(hs)),
            lambda a, b: F.xxhash64(a, b)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.when(
            i + 1 < F.size(places), F.least(F.get(places, i + 1) - p, F.lit(WINDOW)))
            .otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(ranked: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(
            ranked, lambda s, i: same(s, F.get(ranked, i - 1)) | same(s, F.get(ranked, i + 1))),
            lambda s: s["at"]))

    def count(ws: Column) -> Column:
        ranked = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(
            let(let(ranked, places), covered))

    hashes = windows(F.transform(words, lambda w: F.xxhash64(w)))
    return let(hashes, count).cast("long")


def base_measures(text: Column, words: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text.

    ``words`` is the text's word list. An empty or NULL text has none of anything.
    """
    text = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(_GAPS))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(full, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def weights(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS,
            features: tuple = (ENDS,)) -> DataFrame:
    """One row, one array: the log ratio of every bucket of every feature.

    Trusted documents are those labelled quality 1, at most ``trusted_rows`` of them
    in hash order; the broadcast of their ids is bounded by that number. The corpus
    counts cover every document. Without a trusted document all weights are 0, so
    nothing is rejected by them.
    """
    trusted = (labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
               .select(F.col("doc_id").alias("__id"), F.lit(1).alias("__trusted")))
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted), F.col("doc_id") == F.col("__id"), "left")
    every = lambda ws: F.concat(*[grams(ws, f, first) for f, first in placed(features)])
    counts = (flagged.select("__trusted", F.explode(let(word_list(F.col("text")), every)).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("good")))
    # The table of all buckets has a fixed size.
    spans = F.array(*[F.struct(F.lit(first).alias("first"), F.lit(f[1]).alias("size"))
                      for f, first in placed(features)])
    table = (docs.sparkSession.range(1).select(F.inline(spans))
             .select("first", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("b"),
                     "size").join(counts, "b", "left"))
    totals = table.groupBy("first").agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"),
                                        F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"))
    share = lambda n, total: (F.coalesce(F.col(n), F.lit(0)) + 1.0) / (F.col(total) + F.col("size"))
    ratio = F.log(share("good", "all_good") / share("raw", "all_raw"))
    each = table.join(totals, "first").select(
        "b", F.when(F.col("all_good") > 0, ratio).otherwise(0.0).alias("w"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))),
                                lambda s: s["w"]).alias("w"))


def log_ratio(words: Column, table: Column, features: tuple = (ENDS,)) -> Column:
    """Mean weight over the n-grams of a word list, added over features; 0 for an empty one."""
    mean = lambda bs: F.when(F.size(bs) > 0, F.aggregate(
        bs, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(bs)).otherwise(0.0)
    means = [let(grams(words, f, first), mean) for f, first in placed(features)]
    return functools.reduce(lambda a, b: a + b, means)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
          features: tuple = (ENDS,)) -> DataFrame:
    """Adds the base measures, ``base_failed``, ``log_ratio`` and ``kept`` to every row.

    A document fails the base rules with fewer than 20 words or with more than 30 %
    of them in repeated windows. ``docs`` may hold any other columns; rows that
    repeat are judged one by one.
    """
    out = docs.withColumn("__weights", weights(docs, labels, features=features).scalar())
    # One struct from one word list: the text is split once.
    measured = let(word_list(F.col("text")), lambda ws: F.struct(*[
        c.alias(n) for n, c in {**base_measures(F.col("text"), ws),
                                "log_ratio": log_ratio(ws, F.col("__weights"), features)}.items()]))
    # Generated, so that a later filter cannot repeat the measures once per use.
    out = out.withColumn("__m", F.explode(F.array(measured)))
    out = out.withColumns({n: F.col("__m")[n] for n in MEASURES}).drop("__weights", "__m")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold)))
