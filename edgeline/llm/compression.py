"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from texts labelled good, one from texts labelled bad. A text
is cut into pieces of ``PIECE`` bytes, so that it is the dictionary and not the text's
own past that shortens a piece, and every piece is compressed under both. The evidence
is the difference of the two sizes over their sum, between -1 and 1; a logistic curve
fitted on labelled texts that built no dictionary turns it into a probability.

The sample is bounded: ``rows`` labelled documents a class in hash order, ``pieces``
of their pieces a class for the dictionaries. Every document is scored, in one pass
that moves no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.tables import fold, materialise

PIECE = 1024
LEVEL = 3
DICTIONARY_BYTES = 112_640
#: Labelled documents a class that the model is fitted on.
ROWS = 6_000
#: Pieces a class that a dictionary is built from.
PIECES = 10_000
#: One labelled document in so many is kept for the calibration.
CALIBRATION = 3
#: A compressed frame that holds nothing takes this many bytes.
_FRAME = 9


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.bias, -700, 700)))


def held_out(rows: DataFrame) -> Column:
    return fold(rows["doc_id"], 5) == 0


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where the pieces are too few to train one, their text."""
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(size, total // 2), pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor under a dictionary; under none where that is shorter than 8 bytes."""
    known = zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None
    if known is not None:
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False,
                                    write_content_size=False, write_dict_id=False)


def difference(text: str | None, good: zstandard.ZstdCompressor,
               bad: zstandard.ZstdCompressor) -> float:
    """Bytes under the bad less those under the good dictionary, over their sum; 0 for
    an empty or NULL text."""
    data = memoryview((text or "").encode("utf-8", "surrogatepass"))
    sizes = [0, 0]
    for start in range(0, len(data), PIECE):
        piece = data[start:start + PIECE]
        for i, by in enumerate((good, bad)):
            sizes[i] += max(len(by.compress(piece)) - _FRAME, 1)
    total = sum(sizes)
    return (sizes[1] - sizes[0]) / total if total else 0.0


def with_difference(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """Adds the normalised size difference of every whole text as ``out``."""
    contents = (model.good, model.bad)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = map(compressor, contents)
        for texts in batches:
            yield pd.Series([difference(t, good, bad) for t in texts], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(run, "double")(text))


def _sampled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``rows`` labelled ids a class, and the labelled ids of each class.

    An id labelled both ways or without a label is not used.
    """
    each = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("good"))
            .filter("low = good"))
    counts = {r.good: r.n for r in each.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = F.xxhash64("doc_id", F.lit(11))
    chosen = [each.filter(F.col("good") == c).orderBy(by_hash, "doc_id").limit(rows) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("__id"), "good")
    # At most twice ``rows`` ids are broadcast; the documents are read once and not moved.
    texts = (docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
             .filter(F.length("text") > 0)
             .select("good", "text", by_hash.alias("h"),
                     (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(CALIBRATION)) == 0)
                     .alias("calibrates")))
    return materialise(texts, "labelled_texts"), counts


def _pieces(texts: DataFrame, good: int, most: int) -> list[bytes]:
    """At most ``most`` different pieces of one class, in hash order."""
    cut = F.expr(f"transform(sequence(0, (octet_length(b) - 1) div {PIECE}), "
                 f"i -> substring(b, cast(1 + i * {PIECE} as int), {PIECE}))")
    pieces = (texts.filter((F.col("good") == good) & ~F.col("calibrates"))
              .select(F.col("text").cast("binary").alias("b"))
              .select(F.explode(cut).alias("piece")).distinct())
    return [bytes(r.piece) for r in pieces.orderBy(F.xxhash64("piece"), "piece")
            .limit(most).collect()]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3
             ) -> tuple[float, float]:
    """Slope and bias of a weighted logistic regression on one feature, by Newton steps.

    The ridge on the standardised slope keeps it finite where the classes separate.
    """
    mean, scale = x.mean(), x.std() or 1.0
    design = np.column_stack([(x - mean) / scale, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (weight * (p - y)) + ridge * weight.sum() * w * [1, 0]
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design
        curve += ridge * weight.sum() * np.diag([1.0, 1e-9]) + 1e-12 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        # Short steps, so that a flat start cannot throw the bias away.
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, pieces: int = PIECES) -> Model:
    """Dictionaries and calibration from ``labels`` (doc_id, quality 1 or 0) and ``docs``.

    The calibration weighs each class by its share of all labelled ids. Where a class
    has no text to calibrate on, every score is the smoothed share of good labels.
    Ties in hash order are broken by id or content, so reruns agree.
    """
    texts, counts = _sampled(docs, labels, rows)
    model = Model(dictionary(_pieces(texts, 1, pieces)), dictionary(_pieces(texts, 0, pieces)),
                  0.0, 0.0)
    measured = (with_difference(texts.filter("calibrates"), model, "d")
                .orderBy("h", "d").limit(2 * rows).select("good", "d").collect())
    x = np.array([r.d for r in measured])
    y = np.array([float(r.good) for r in measured])
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    model.bias = math.log((n_good + 1) / (n_bad + 1))
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, n_good / y.sum(), n_bad / (len(y) - y.sum()))
        slope, bias = logistic(x, y, weight / weight.mean())
        if slope > 0:      # else the sample says nothing about the difference
            model.slope, model.bias = slope, bias
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``difference`` and ``score``, the probability of a good text, to every row.

    A NULL or empty text has difference 0 and so the score of no evidence. Repeated
    rows are scored one by one, equal texts alike; columns of these names are replaced.
    """
    out = with_difference(docs, model, "difference", text)
    evidence = F.lit(model.slope) * F.col("difference") + F.lit(model.bias)
    return out.withColumn("score", 1.0 / (1.0 + F.exp(-evidence)))
