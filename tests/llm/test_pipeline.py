"""The registered queries and the pipeline."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import SF

import __spark_entry__ as contract
from edgeline.llm import bpe
from edgeline.llm.queries import QUERIES
from edgeline.llm.tables import materialise, table

OPS = [n for n in QUERIES if n != "pipeline"]


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in OPS} >= {*range(1, 14)}
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", OPS)
def test_query_gives_every_row(spark, name):
    out = QUERIES[name](spark, SF)
    source = {"op6": "pages", "op12": "conversations", "op13": "embeddings"}.get(
        name.split("_")[0], "documents")
    key = out.columns[0]
    if name.startswith("op7"):
        assert out.count() > 0
        return
    got = sorted(r[0] for r in out.select(key).collect())
    want = table(spark, SF, source).select(key)
    assert got == sorted(r[0] for r in (want.distinct() if source == "conversations" else want).collect())


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= before and ids
        if name != "mixture":
            assert len(ids) == len(set(ids))
    out = {(r.doc_id, r.n_tokens): r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    codec = bpe.Automaton(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    codec.ready()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, _ in out} == set(texts)
    for (i, n), ids in out.items():
        assert n == len(np.frombuffer(ids, "<u4")) and codec.decode(bytes(ids)) == texts[i]


def test_stages_leave_other_columns_alone(spark):
    """Further columns named like those that operators add come out as they went in."""
    more = {c: -7 for c in ("score", "taken", "target", "source_size", "rounds", "extra", "size",
                            "kept", "n_words", "log_ratio", "lang_pred", "base_failed", "fp", "node")}
    docs = table(spark, SF, "documents").selectExpr("*", *[f"{v} AS {c}" for c, v in more.items()])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0
        assert docs.filter(" OR ".join(f"{c} <> {v}" for c, v in more.items())).count() == 0


def test_pipeline_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0
