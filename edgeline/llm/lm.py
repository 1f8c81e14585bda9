"""Language-model scoring by deleted interpolation.

Two-word, one-word and uniform maximum-likelihood estimates are mixed; the mixture
weights depend on how often the context occurs (a bucket per doubling) and are
learned by expectation-maximisation on held-out counts: every training document is
scored with its own counts taken out of the corpus counts.

Counting and lookup are one exchange. Documents form chunks of neighbouring ids.
A chunk asks once for each distinct word and word pair it holds, as a sorted array
of 64-bit hashes, and sends its own training counts along; requests are dealt by
hash, added up over all chunks, and the totals go back to the chunks that asked.
So what moves is one hash per distinct pair and chunk, not a row per word, and a
frequent word is one entry of each chunk.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.tables import fold, materialise

#: Neighbouring ids in a chunk, characters of a chunk of rows dealt by hash, characters from
#: which a text is dealt so, and keys that one counting task adds up at most.
CHUNK_IDS = 4000
CHUNK_CHARS = 4_000_000
LONG_CHARS = 100_000
KEYS_PER_TASK = 3_000_000
BUCKETS = 32
#: Estimates are binned by this part of a factor of ten while weights are learned.
BIN = 0.05
EM_ROUNDS = 60
_START = np.uint64(0x9E3779B97F4A7C15)
_END = b"\n"                             # no word holds a line end
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in order, then that of the end."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    words.append(_END)
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), dtype=np.uint64,
                       count=len(words))


def pair_keys(words: np.ndarray) -> np.ndarray:
    """Hash of every token with the one before it; the first follows the start."""
    before = np.concatenate([[_START], words[:-1]])
    mixed = (before ^ (before >> np.uint64(29))) * _MIX + words
    return (mixed ^ (mixed >> np.uint64(32))) * _START


def chunk_of(doc_id: Column, text: Column, size: int) -> Column:
    """Chunk of a row; rows without an id or with a long text are dealt by a hash of the text.

    So what a chunk of neighbouring ids holds is bounded in characters too.
    ``size`` is the number of characters of all texts.
    """
    dealt = F.pmod(F.xxhash64(text), F.lit(math.ceil((size + 1) / CHUNK_CHARS)))
    near = F.when(F.coalesce(F.length(text), F.lit(0)) < LONG_CHARS, F.floor(doc_id / CHUNK_IDS))
    return F.coalesce(near, -1 - dealt)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Counting task of every key: equal ranges of keys, so that neighbours stay together."""
    return (keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)


def _pack(values: np.ndarray) -> bytes:
    """Non-negative numbers by byte planes, without the planes that are empty."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = next((k for k in range(8, 0, -1) if planes[k - 1].any()), 0)
    return zlib.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first, then steps of as many bytes as the largest needs."""
    steps = np.diff(keys).astype("<u8")
    wide = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return (bytes([wide]) + keys[:1].astype("<u8").tobytes()
            + steps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes())


def _unpack_sorted(data: bytes) -> np.ndarray:
    wide, first = data[0], np.frombuffer(data, dtype="<u8", count=1, offset=1)
    steps = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, wide or 1)
    out = np.zeros((len(steps), 8), dtype=np.uint8)
    out[:, :wide] = steps
    return np.cumsum(np.concatenate([first, out.view("<u8").ravel()]), dtype=np.uint64)


def _asks(parts: int):
    """One row per chunk and counting task: sorted keys and their training counts.

    The start is counted with the words, as the context of first tokens.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, bool]]] = {}
        size = 0

        def flush():
            for chunk, docs in held.items():
                keys, counts = [], []
                for words, train in docs:
                    own = np.concatenate([words, pair_keys(words), [_START]])
                    keys.append(own)
                    counts.append(np.full(len(own), train, dtype=np.int64))
                unique, at = np.unique(np.concatenate(keys), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate(counts)).astype("<i8")
                part = part_of(unique, parts)
                order = np.argsort(part, kind="stable")
                unique, counts, part = unique[order], counts[order], part[order]
                ends = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                yield pd.DataFrame([(p, chunk, _pack_sorted(unique[a:b]), _pack(counts[a:b]))
                                    for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a],
                                   columns=["part", "chunk", "keys", "counts"])
            held.clear()

        for batch in batches:
            for chunk, text, train in zip(batch.chunk, batch.text, batch.train):
                words = tokens(text)
                held.setdefault(chunk, []).append((words, train))
                size += len(words)
                if size > KEYS_PER_TASK:
                    yield from flush()
                    size = 0
        yield from flush()
    return run


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of one counting task: per chunk, in the order of its sorted distinct keys."""
    keys = [_unpack_sorted(k) for k in rows["keys"]]
    counts = np.concatenate([_unpack(c, len(k)) for c, k in zip(rows["counts"], keys)])
    ends = np.cumsum([len(k) for k in keys])[:-1]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(unique)).astype("<i8")
    asked: dict[int, list[np.ndarray]] = {}
    for chunk, own in zip(rows.chunk, np.split(at, ends)):
        asked.setdefault(chunk, []).append(own)
    # A chunk that asked in several rows gets one answer.
    out = []
    for chunk, own in asked.items():
        own = np.unique(np.concatenate(own)) if len(own) > 1 else own[0]
        out.append((chunk, rows.part.iloc[0], len(own), _pack(totals[own])))
    return pd.DataFrame(out, columns=["chunk", "part", "n", "totals"])


_COUNTED = "doc_id string, train boolean, n long, start long, c2 binary, c12 binary, held binary"


def _counted(parts: int):
    """Corpus counts of every token of a chunk and of its pair, packed per document.

    The count of a context is that of the token before. A chunk's first row also
    holds the binned estimates of its training documents, each without its own
    counts.
    """
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = [tokens(t) for t in docs.text]
        pairs = [pair_keys(w) for w in texts]
        keys, at = np.unique(np.concatenate([*texts, *pairs, [_START]]), return_inverse=True)
        # Answers come by counting task, in the order of their keys.
        totals = np.empty(len(keys), dtype=np.int64)
        totals[np.argsort(part_of(keys, parts), kind="stable")] = np.concatenate(
            [_unpack(t, n) for _, n, t in sorted(zip(answers.part, answers["n"], answers.totals))])
        ends = np.cumsum([len(w) for w in texts])
        of_words, of_pairs = totals[at[:ends[-1]]], totals[at[ends[-1]:-1]]
        start = int(totals[at[-1]])
        rows, held = [], [np.zeros(0, dtype=np.int64)]
        for doc_id, train, words, pair, end in zip(docs.doc_id, docs.train, texts, pairs, ends):
            c2, c12 = (c[end - len(words):end] for c in (of_words, of_pairs))
            if train:
                held.append(_deleted(words, pair, start, c2, c12))
            rows.append((doc_id, train, len(words), start, _pack(c2), _pack(c12), None))
        code, times = np.unique(np.concatenate(held), return_counts=True)
        rows[0] = (*rows[0][:-1], zlib.compress(np.column_stack([code, times]).astype("<i8")
                                                .tobytes(), 1))
        return pd.DataFrame(rows, columns=["doc_id", "train", "n", "start", "c2", "c12", "held"])
    return run


def _times(values: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[at]


def bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context by its count: 0, 1, 2-3, 4-7, and so on."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _contexts(start: int, c2: np.ndarray) -> np.ndarray:
    return np.concatenate([[start], c2[:-1]])


def _deleted(words, pairs, start, c2, c12) -> np.ndarray:
    """(bucket, binned pair estimate, binned word count) codes of a document without itself."""
    own = _times(words)
    c1 = _contexts(start - 1, c2 - own)
    c2, c12 = c2 - own, c12 - _times(pairs)
    level = lambda x: np.where(x > 0, np.round(np.log10(np.maximum(x, 1e-12)) / BIN) + 400, 0)
    pair = level(np.where(c1 > 0, c12 / np.maximum(c1, 1), 0.0))
    return ((np.minimum(bucket(c1), BUCKETS - 1) * 1024 + pair) * 1024
            + level(c2 * 1.0)).astype(np.int64)


def learn_weights(cells: list[tuple[int, int]], total: int, words: int) -> np.ndarray:
    """Mixture weights (pair, word, uniform) per bucket, by expectation-maximisation.

    ``cells`` are binned held-out codes with their numbers. A bucket without any
    takes the weights of the one below it.
    """
    code = np.array([c for c, _ in cells], dtype=np.int64)
    n = np.array([k for _, k in cells], dtype=float)
    size = lambda level: np.where(level > 0, 10.0 ** ((level - 400) * BIN), 0.0)
    of = code >> 20
    p = np.column_stack([size(code >> 10 & 1023), size(code & 1023) / max(total, 1),
                         np.full(len(code), 1.0 / (words + 1))])
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.9, 0.1)
    for b in range(BUCKETS):
        here = of == b
        if not n[here].sum():
            weights[b] = weights[b - 1] if b > 1 else weights[b]
            continue
        w = weights[b]
        for _ in range(EM_ROUNDS):
            part = p[here] * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * n[here, None]).sum(axis=0) / n[here].sum()
        # An unknown word must keep some probability.
        weights[b] = np.maximum(w, (0.0, 1e-6, 1e-6)) / np.maximum(w, (0.0, 1e-6, 1e-6)).sum()
    return weights


def score(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    NULL and empty texts are the end token alone. Repeated rows are scored and
    counted one by one. With no training row every count is 0 and only the uniform
    part remains. ``docs`` may have any other columns.
    """
    # Ids pass through Python as text: beside a NULL a batch of numbers would turn to floats.
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", train.alias("train"),
                       chunk_of(F.col("doc_id"), F.col("text"), size).alias("chunk"))
    parts = max(8, math.ceil(size / 4 / KEYS_PER_TASK))
    asks = rows.mapInPandas(_asks(parts), "part long, chunk long, keys binary, counts binary")
    answers = asks.groupBy("part").applyInPandas(
        _add_up, "chunk long, part long, n long, totals binary")
    counted = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _counted(parts), _COUNTED)
    counted = materialise(counted, "lm-counts")

    # Totals of the training tokens: N, and V by the words' own counts.
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b[b.train]
            words = sum(np.sum(1.0 / _unpack(c, n)) for c, n in zip(known.c2, known["n"]))
            yield pd.DataFrame({"code": [-1], "n": [known["n"].sum()], "v": [float(words)]})
            for packed in b["held"].dropna():
                cells = np.frombuffer(zlib.decompress(packed), dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"code": cells[:, 0], "n": cells[:, 1], "v": 0.0})

    held = (counted.select("train", "n", "c2", "held")
            .mapInPandas(summed, "code long, n long, v double")
            .groupBy("code").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())
    total = next((r.n for r in held if r.code < 0), 0)
    # Every training token adds one over its count: the sum is the number of words.
    words = round(next((r.v for r in held if r.code < 0), 0.0))
    weights = learn_weights([(r.code, r.n) for r in held if r.code >= 0], total, words)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, start, *packed in zip(b["n"], b.start, b.c2, b.c12):
                c2, c12 = (_unpack(p, n) for p in packed)
                c1 = _contexts(start, c2)
                w = weights[np.minimum(bucket(c1), BUCKETS - 1)]
                p = (w[:, 0] * c12 / np.maximum(c1, 1) + w[:, 1] * c2 / max(total, 1)
                     + w[:, 2] / (words + 1))
                out.append((n, int((c2 > 0).sum()),
                            float(np.log10((c2 + 1) / (total + words + 1)).sum()),
                            float(np.log10(p).sum())))
            got = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
            got.insert(0, "doc_id", b.doc_id.to_numpy())
            yield got

    return (counted.select("doc_id", "n", "start", "c2", "c12")
            .mapInPandas(final, "doc_id string, n_tokens long, n_known long, base_score double, "
                                "score double")
            .withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
            .withColumn("train_tokens", F.lit(total).cast("long")))


def held_out(docs: DataFrame) -> Column:
    return fold(docs["doc_id"], 7) == 2
