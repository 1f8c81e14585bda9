"""A corpus pipeline: language, quality, near-duplicates, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. Models and statistics are learned from the stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.llm import bpe, language, mixing, quality, simhash
from edgeline.llm.tables import materialise, table

#: Share of the winning language below which a document counts as unidentified.
LEAST_LANGUAGE_SCORE = 0.4


def _beside(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, with the whole row beside them under a private name,
    so that no column of a document meets one that the operator adds."""
    return docs.select(F.struct(*docs.columns).alias("__row"), *names)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no language claims clearly."""
    model = language.fit(docs, F.lit(True))
    known = language.predict(_beside(docs, "text"), model).filter(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return known.select("__row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the log-likelihood ratio reject."""
    return (quality.judge(_beside(docs, "doc_id", "text"), table(spark, sf_dir, "labels"),
                          features=(quality.WHOLE, quality.ENDS)).filter("kept")
            .select("__row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near fingerprints."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those not taken go."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, encoded and decoded again: doc_id, source, n_tokens,
    the packed ids and the SHA-256 of the text that they decode to."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.PATTERN, keep=["doc_id", "source"])
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                      "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("token_ids", encode_tokens),
]

#: Kernel regression, tiled comparison and the knapsack have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
