"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeline.llm import (bpe, codes, compression, conversations, html_text, language, lm, mixing,
                          quality, separators, simhash, spots, toxicity)
from edgeline.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out(docs))
    return language.predict(docs, model).select(
        "doc_id", language.held_out(docs).alias("held_out"), "lang_pred", "score")


@query("op3_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                        features=(quality.WHOLE, quality.ENDS))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "log_ratio")


@query("op4_toxicity")
def toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(docs))
    return toxicity.score(docs, grammar).select(
        "doc_id", toxicity.held_out(docs).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_bpe_codec")
def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op6_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_tokens(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.PATTERN)


@query("op8_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm.score(docs, ~lm.held_out(docs))
    return out.select("doc_id", lm.held_out(out).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


@query("op10_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op11_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression.fit(docs, labels.filter(~compression.held_out(labels)))
    return compression.score(docs, model).select(
        "doc_id", compression.held_out(docs).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query("op13_vector_codes")
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _lloyd_sql(rounds: int = 4) -> str:
    """The same rounds in SQL, every part against every entry each time."""
    assign = """a{i} AS MATERIALIZED (
  SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT rid, t.p, e, list_inner_product(t.v, t.v) - 2 * list_inner_product(t.v, b.v)
      + list_inner_product(b.v, b.v) AS d FROM parts t JOIN b{i} b ON t.p = b.p)
  GROUP BY ALL)"""
    move = """b{j} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS v FROM (
      SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (
        SELECT t.p, a.best.e AS e, unnest(t.v) AS x, generate_subscripts(t.v, 1) AS i
        FROM a{i} a JOIN parts t USING (rid, p)) GROUP BY ALL) GROUP BY ALL) m USING (p, e))"""
    steps = [part for i in range(rounds) for part in
             (assign.format(i=i), move.format(i=i, j=i + 1))] + [assign.format(i=rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS w FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, p, w[p * (len(w) // 4) + 1:(p + 1) * (len(w) // 4)] AS v
  FROM kept, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= 256),
{", ".join(steps)},
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code,
    CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
   FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds}))
    AS codebooks_sha256
FROM coded JOIN kept USING (rid)"""


ORACLES["op13_vector_codes"] = _lloyd_sql()
