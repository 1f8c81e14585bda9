"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams of one to three
characters (a blended spectrum) that both contain, presence only, divided by the
geometric mean of their own counts. N-grams are hashed to a fixed number of
buckets. Nystroem: kernel values against landmark texts, whitened with the
landmarks' own kernel matrix, are the features of a one-versus-rest kernel ridge
regression. Scoring multiplies a batch's presence matrix with the landmarks and
the result with the regression weights.

Fitting uses a bounded sample: ``per_language`` labelled rows of every language,
taken in hash order, of which the first ``landmarks`` per language are landmarks.
Everything that reaches the driver is one bit vector per sampled row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.llm.tables import fold

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")
_MULTIPLIERS = np.array([2654435761, 40503, 2246822519], dtype=np.uint64)
_BATCH = 256


def presence(text: str | None) -> np.ndarray | None:
    """Buckets of the n-grams of a whole text; None if it holds no letter."""
    letters = _NO_LETTER.sub(" ", text.lower()).strip() if text else ""
    # Numbers such as a circled one pass the pattern and are no letters.
    if not any(c.isalpha() for c in letters):
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    seen = np.zeros(BUCKETS, dtype=bool)
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for k in range(max(ORDERS)):
        if k >= len(codes):
            break
        mixed = (mixed[:len(codes) - k] + codes[k:]) * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint64(15)
        if k + 1 in ORDERS:
            seen[(mixed + np.uint64(k)) % np.uint64(BUCKETS)] = True
    return seen


def _packed(texts: pd.Series) -> pd.Series:
    seen = [presence(t) for t in texts]
    return pd.Series([None if s is None else np.packbits(s).tobytes() for s in seen])


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray          # rows of presence bits
    weights: np.ndarray            # landmarks x languages

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Regression values of presence rows, by two matrix products."""
        if not len(self.languages):
            return np.zeros((len(rows), 0), dtype=np.float32)
        return _kernel(rows, self.landmarks) @ self.weights


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    own = np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))
    return (a @ b.T) / np.maximum(own, 1)


def fit(docs: DataFrame, train: Column, per_language: int = 256, landmarks: int = 32,
        ridge: float = 1e-2) -> Model:
    """Model from ``text`` and ``lang`` of the rows where ``train`` holds.

    Rows without a language, an id or a letter are not used and take no place in the
    sample; of rows that share language and id one is used. With no usable row the
    model knows no language and predicts ``und``. Ties in hash order are broken by
    id, so reruns agree.
    """
    bits = F.pandas_udf(_packed, "binary")
    usable = docs.filter(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                         & F.col("text").rlike(r"\p{L}"))
    ranked = (usable
              .select("lang", "doc_id", F.xxhash64(F.col("doc_id"), F.lit(7)).alias("h"))
              .withColumn("r", F.row_number().over(
                  Window.partitionBy("lang").orderBy("h", "doc_id")))
              .filter(F.col("r") <= per_language))
    ids = [row.doc_id for row in ranked.collect()]
    sample = (usable.filter(F.col("doc_id").isin(ids))
              .select("lang", "doc_id", bits("text").alias("bits"))
              .groupBy("lang", "doc_id").agg(F.min("bits").alias("bits"))
              .filter(F.col("bits").isNotNull()).collect())
    sample.sort(key=lambda r: (r.lang, r.doc_id))
    languages = sorted({r.lang for r in sample})
    if not languages:
        return Model([], np.zeros((0, BUCKETS), dtype=bool), np.zeros((0, 0)))
    rows = np.unpackbits(np.frombuffer(b"".join(r.bits for r in sample), dtype=np.uint8)
                         .reshape(len(sample), -1), axis=1).astype(bool)
    y = np.array([languages.index(r.lang) for r in sample])
    chosen = np.concatenate([np.flatnonzero(y == i)[:landmarks] for i in range(len(languages))])
    marks = rows[chosen]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = _kernel(rows, marks).astype(np.float64) @ whiten
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]     # languages weigh the same
    target = (y[:, None] == np.arange(len(languages))).astype(np.float64)
    gram = (z * share[:, None]).T @ z + ridge * np.eye(z.shape[1])
    weights = whiten @ np.linalg.solve(gram, (z * share[:, None]).T @ target)
    return Model(languages, marks, weights.astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``; map-only, whole texts.

    A NULL text or one without a letter is ``und`` with score 0; any other text gets the
    language of the largest regression value, ties to the first by name. The score is
    the winner's share of the positive values, 0 if there are none.
    """
    packed = np.packbits(model.landmarks, axis=1)
    names, weights = model.languages, model.weights

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(names, np.unpackbits(packed, axis=1).astype(np.float32)
                    if len(names) else packed, weights)
        for texts in batches:
            lang, score = [], []
            for start in range(0, len(texts), _BATCH):
                seen = [presence(t) for t in texts.iloc[start:start + _BATCH]]
                known = [s for s in seen if s is not None]
                got = iter(own.scores(np.array(known)) if known else ())
                for s in seen:
                    values = None if s is None else next(got)
                    if values is None or not len(values):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                    else:
                        best = int(values.argmax())
                        lang.append(names[best])
                        share = np.maximum(values, 0)
                        score.append(float(min(1.0, share[best] / share.sum()))
                                     if share[best] > 0 else 0.0)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    out = docs.withColumn("__lang", F.pandas_udf(run, "lang_pred string, score double")(text))
    return (out.withColumns({"lang_pred": F.col("__lang.lang_pred"),
                             "score": F.col("__lang.score")}).drop("__lang"))


def held_out(docs: DataFrame) -> Column:
    return fold(docs["doc_id"], 4) == 2
