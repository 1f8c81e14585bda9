"""Token counts of documents in flat token files, by scanning for separators.

A flat file is a sequence of 16-bit token ids in which every document is followed by
the end-of-document id; nothing tells where documents begin. A file is read in
blocks. Inside a block the separators are found by one vectorised comparison, which
gives the tokens before the first, between neighbours, and after the last. A prefix
scan over the block summaries of a file then carries open documents across block
ends, however many blocks they span, and numbers the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeline.llm import bpe
from edgeline.llm.tables import materialise

END = 50256
BLOCK = 1 << 18
_FLAT = "file long, block long, ids binary, doc_ids array<long>"


def flat_files(docs: DataFrame, path: str, pattern: str, end: int = END,
               block: int = BLOCK) -> DataFrame:
    """(file, block, ids, doc_ids): the documents of each task as one flat file.

    ``doc_ids`` only names the documents that were begun since the block before, for
    reports; it holds no lengths. A separator spelled out in a text is encoded as
    ordinary text. NULL and empty texts are a separator alone. No row is shuffled.
    """
    auto = bpe.Automaton(path, pattern)
    auto.special = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto.ready()
        held, size, begun, number, file = [], 0, [], 0, 0
        stop = np.array([end], dtype="<u2")
        for batch in batches:
            for file, doc_id, packed in zip(batch.file, batch.doc_id, auto.encode_all(batch.text)):
                ids = np.frombuffer(packed, dtype="<u4").astype("<u2")
                begun.append(None if doc_id is None else int(doc_id))
                held += [ids, stop]
                size += len(ids) + 1
                if size >= block:
                    flat = np.concatenate(held)
                    cuts = range(0, len(flat) // block * block, block)
                    yield pd.DataFrame([(file, number + k, flat[at:at + block].tobytes(),
                                         [] if k else begun) for k, at in enumerate(cuts)],
                                       columns=["file", "block", "ids", "doc_ids"])
                    number += len(cuts)
                    held, begun = [flat[len(cuts) * block:]], []
                    size = len(held[0])
        if size or begun:
            yield pd.DataFrame([(file, number, np.concatenate(held).tobytes(), begun)],
                               columns=["file", "block", "ids", "doc_ids"])

    # Ids pass as text: beside a NULL a batch of numbers would turn to floats.
    rows = docs.select(F.spark_partition_id().cast("long").alias("file"),
                       F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, _FLAT)


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, number, n_tokens) per document of (file, block, ids) rows.

    The separator is not counted. Tokens after a file's last separator form no
    document. Files without a row give none.
    """
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, block, data in zip(b.file, b.block, b["ids"]):
                ids = np.frombuffer(data, dtype="<u2")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                out.append((file, block, len(at), len(ids) - (at[-1] + 1 if len(at) else 0),
                            lengths.tolist()))
            yield pd.DataFrame(out, columns=["file", "block", "ends", "tail", "lengths"])

    seen = blocks.select("file", "block", "ids").mapInPandas(
        found, "file long, block long, ends long, tail long, lengths array<long>")
    # Blocks since a separator share a run; their tails are the open document.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    seen = seen.withColumn("run", F.sum((F.col("ends") > 0).cast("long")).over(upto))
    in_run = (Window.partitionBy("file", "run").orderBy("block")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = seen.withColumn("open", F.sum("tail").over(in_run))
    seen = seen.withColumns({
        "carry": F.coalesce(F.lag("open").over(upto), F.lit(0)),
        "first": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    return (seen.select("file", "first", "carry", F.posexplode("lengths").alias("k", "len"))
            .select("file", (F.col("first") + F.col("k")).alias("number"),
                    (F.col("len") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0))
                    .alias("n_tokens")))


def count_tokens(docs: DataFrame, path: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, by way of written flat files."""
    files = materialise(flat_files(docs, path, pattern, block=block), "flat-files")
    counts = scan(files)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = (files.select("file", "block", "doc_ids")
             .withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
             .select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
             .select("file", (F.col("first") + F.col("k")).alias("number"), "doc_id"))
    return names.join(counts, ["file", "number"]).select("doc_id", "n_tokens")
