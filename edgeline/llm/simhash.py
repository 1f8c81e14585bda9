"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's shingles.
Distinct fingerprints are laid out in tiles. A tile holds fingerprints with the
same bit counts in each quarter of the 64 bits and has a bounded number of rows; the
sum of the differences of the four counts is a lower bound of the differing bits,
so tile pairs beyond the radius are skipped. What is left is compared exactly, by
exclusive-or and bit counts over whole tiles. There are at most 17^4 count classes
whatever the input, so their sizes are a small table.

The work is exact and grows with the square of the number of distinct
fingerprints; for radius 2 the quarters leave about one pair in eighty to compare.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.tables import materialise, whole
from edgeline.operators.cells import star_contract

SHINGLE = 3
RADIUS = 2
#: Fingerprints in a tile, on average at most.
TILE = 8192
_QUARTERS = 4


def _pieces(text: str | None, shingle: int) -> list[bytes]:
    """Shingles of a text in order; one of all words where it has fewer than a shingle.

    bytes.lower and bytes.split know A to Z and the six ASCII white spaces only,
    which is the definition of case and words here.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return []
    if len(words) < shingle:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def _hashes(pieces: Collection[bytes], lane: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, 42 + lane) for p in pieces),
                       dtype=np.uint64, count=len(pieces))


def _majority(hashed: np.ndarray) -> bytes:
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashed), 1 << 16):
        part = hashed[start:start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashed), bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int = SHINGLE, lanes: int = 1) -> bytes:
    """64-bit fingerprints, little-endian, one per lane; 0 for a text without a word."""
    pieces = _pieces(text, shingle)
    return b"".join(_majority(_hashes(pieces, lane)) for lane in range(lanes))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                 lanes: int = 1) -> DataFrame:
    """Adds ``fp`` (binary, 8 bytes a lane) to every row; map-only."""
    udf = F.pandas_udf(lambda s: pd.Series([fingerprint(t, shingle, lanes) for t in s],
                                           dtype=object), "binary")
    return docs.withColumn("fp", udf(F.col(text)))


def _near_steps(radius: int, quarters: bool) -> list[list[int]]:
    """Steps between count classes within reach, each pair of classes once."""
    if not quarters:
        return [[0], [1]]
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * _QUARTERS), -1)
    steps = grid.reshape(-1, _QUARTERS)
    steps = steps[np.abs(steps).sum(axis=1) <= radius]
    return [s.tolist() for s in steps if s.tolist() >= [0] * _QUARTERS]


def _array(cell: pa.Scalar, dtype: str) -> np.ndarray:
    """The numbers packed in a binary cell, not copied."""
    return np.frombuffer(cell.as_buffer(), dtype=dtype)


def _links(left: np.ndarray, right: np.ndarray,
           radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two tiles within the radius, some rows of the left at a time."""
    step = max(1, (1 << 21) // max(len(right), 1))
    for start in range(0, len(left), step):
        apart = np.zeros((min(step, len(left) - start), len(right)), dtype=np.uint8)
        for lane in range(left.shape[1]):
            apart += np.bitwise_count(left[start:start + step, None, lane] ^ right[None, :, lane])
        i, j = np.nonzero(apart <= radius)
        yield i + start, j


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that connect the same nodes as the pairs (a, b), one per node at most."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return np.column_stack([nodes[label[keep]], nodes[keep]])


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links that connect every two nodes whose fingerprints are within the radius.

    ``nodes`` has one row per distinct fingerprint: ``node`` (long) and ``fp``. A tile
    pair returns links that span its matches, so a dense group does not give all its
    pairs.
    """
    quarters = radius < 4
    keys = [f"q{q}" for q in range(_QUARTERS if quarters else 1)]

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.bitwise_count(np.frombuffer(b"".join(batch.fp), dtype="<u2"))
            bits = bits.reshape(len(batch), -1).astype(np.int32)
            if quarters:
                bits = bits.reshape(len(batch), -1, _QUARTERS).sum(axis=1)
            else:
                bits = bits.sum(axis=1, keepdims=True) // (radius + 1)
            yield pd.concat([batch, pd.DataFrame(bits, columns=keys, index=batch.index)], axis=1)

    tagged = nodes.select("node", "fp").mapInPandas(
        counts, "node long, fp binary, " + ", ".join(f"{k} int" for k in keys))
    tagged = materialise(tagged, "simhash-nodes")
    sizes = (tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("blocks", F.ceil(F.col("n") / tile).cast("int")).drop("n"))
    # At most 17^4 classes for one lane, fewer otherwise: a proven bound for the broadcasts.
    placed = tagged.join(F.broadcast(sizes), keys).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = placed.groupBy(*keys, "block").agg(F.collect_list("node").alias("ns"),
                                               F.collect_list("fp").alias("fps"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, fps = batch.column("ns"), batch.column("fps")
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[row.column(k) for k in (*keys, "block")],
                     pa.array([ns[i].values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()],
                              pa.binary()),
                     pa.array([b"".join(fps[i].values.to_pylist())], pa.binary())],
                    names=[*keys, "block", "ns", "fps"])

    tiles = materialise(tiles.mapInArrow(
        pack, ", ".join(f"{k} int" for k in keys) + ", block int, ns binary, fps binary"),
        "simhash-tiles")

    steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _near_steps(radius, quarters)])
    left = tiles.withColumn("s", F.explode(steps)).select(
        *keys, "block", "ns", "fps", *[(F.col(k) + F.col("s")[i]).alias(f"o{k}")
                                       for i, k in enumerate(keys)])
    other = sizes.select(*[F.col(k).alias(f"o{k}") for k in keys], F.col("blocks").alias("oblocks"))
    left = (left.join(F.broadcast(other), [f"o{k}" for k in keys])
            .withColumn("oblock", F.explode(F.sequence(F.lit(0), F.col("oblocks") - 1))))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"o{k}"))
    left = left.filter(~same | (F.col("block") <= F.col("oblock")))
    right = tiles.select(*[F.col(k).alias(f"o{k}") for k in keys], F.col("block").alias("oblock"),
                         F.col("ns").alias("ons"), F.col("fps").alias("ofps"))
    pairs = left.join(right, [*[f"o{k}" for k in keys], "oblock"]).select(
        "ns", "fps", "ons", "ofps")

    lanes_of = lambda ns, fps: _array(fps, "<u8").reshape(len(_array(ns, "<i8")), -1)

    arrow = lambda out: pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])],
                                                   names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), dtype=np.int64)]
            for ns, fps, ons, ofps in zip(*batch.columns):
                a, b = _array(ns, "<i8"), _array(ons, "<i8")
                matched = ((a[i], b[j]) for i, j in _links(lanes_of(ns, fps), lanes_of(ons, ofps), radius))
                left, right = map(np.concatenate, zip(*matched))
                found.append(_spanning(left, right))
            yield arrow(np.concatenate(found))

    return pairs.mapInArrow(compare, "a long, b long").filter("a <> b")


def classes(marked: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(node, low, component_id) per distinct fingerprint of ``marked``.

    ``marked`` has ``fp`` and its 64-bit name ``node``. ``low`` is the smallest key
    with the fingerprint and ``component_id`` the smallest reachable over near
    fingerprints. A NULL key counts as larger than all others; where no key of a
    class is known the id is NULL.
    """
    nodes = materialise(marked.groupBy("node").agg(F.min(key).alias("low"), F.first("fp").alias("fp")),
                        "simhash-distinct")
    roots = materialise(star_contract(links(nodes, radius)), "simhash-roots")
    named = nodes.join(roots, "node", "left").select(
        "node", "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lowest, "root").select("node", "low", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``.

    Equal fingerprints are folded to one node first; nodes are linked, connected and
    joined back, so no text and no group of copies moves as a whole. Texts without a
    word share the fingerprint 0. Repeated rows get the same id.
    """
    marked = fingerprints(docs.select(key, text), text, shingle).drop(text)
    marked = materialise(marked.withColumn("node", F.xxhash64("fp")), "simhash-fingerprints")
    ids = classes(marked, key, radius).select("node", "component_id")
    # The bytes are little-endian: reversed pairs of digits give the number.
    digits = F.lower(F.hex("fp"))
    number = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return (marked.join(ids.hint("merge"), "node")
            .select(key, number.alias("fingerprint"), "component_id"))


def text_hash() -> Column:
    return F.xxhash64(whole())


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one stays of every class.

    Classes are those of ``near_duplicates``. It is the row with the smallest id of its
    class, a NULL id counts as larger than all others; ties go to the smallest hash of
    the text, then of the row. Ids need not be unique: rows of one id with texts of
    different classes all stay. Texts without a word are one class.
    """
    columns = docs.columns
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"),
                    text_hash().alias("th"), F.xxhash64(*columns).alias("row"))
    marked = fingerprints(docs.select(name.alias("name"), "text"), "text", shingle).drop("text")
    marked = materialise(marked.withColumn("node", F.xxhash64("fp")), "simhash-fingerprints")
    first = classes(marked, "name", radius).select("component_id").distinct().select(
        F.col("component_id.id").alias("__id"), F.col("component_id.th").alias("__text"),
        F.col("component_id.row").alias("__hash"))
    rows = docs.withColumns({"__th": text_hash(), "__row": F.xxhash64(*columns)})
    kept = rows.join(first, (F.col("__th") == F.col("__text")) & (F.col("__row") == F.col("__hash"))
                     & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # What is equal in all three is one row repeated.
    return kept.dropDuplicates(["doc_id", "__th", "__row"]).select(*columns)
