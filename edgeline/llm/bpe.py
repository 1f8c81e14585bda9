"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over token labels that
accepts exactly the canonical tokenizations. It starts as one state with a loop
for every base byte. The gadget of a merge (u, v) -> uv takes the state s that
u-arcs enter: where s has a v-arc, u-arcs are led to a copy of s without that
arc, and every state with a u-arc gets a uv-arc into the state that v-arcs
entered. All arcs of a label enter one state, so one gadget adds one state.

The states that arcs of one label have entered form a chain of copies, each without
one arc more. A chain is stored as {label left out: merge that copied} and labels as
(left part, right part, born at merge), which is the whole transition table: an arc
is looked up by walking back to the older of chain and label. A piece is encoded from left
to right along arcs, longest first; every byte position is entered by exactly one
canonical path. The distinct pieces of many texts are encoded side by side, one arc a
round, with transitions looked up for whole arrays; only long pieces go alone. Decoding emits the bytes of the arc labels.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arcs that a task remembers, bytes of a piece that is encoded beside others, pieces encoded
#: side by side, and characters encoded at a time. Only speed depends on them.
REMEMBERED = 500_000
SHORT = 64
ABREAST = 1 << 15
CHARS = 1_000_000
#: Rows that ``encode`` returns at a time.
ROWS_OUT = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return ({chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)})


class _Table:
    """Numbers by non-negative 64-bit keys, for arrays of keys: open addressing."""

    def __init__(self, bits: int):
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int32)
        self.shift, self.last, self.used = np.uint64(64 - bits), (1 << bits) - 1, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key, -1 where there is none."""
        slot = self._slots(keys)
        own = self.keys[slot]
        out = np.where(own == keys, self.values[slot], -1)
        rest = np.flatnonzero((own != keys) & (own >= 0))
        while len(rest):
            slot = (slot if len(slot) == len(rest) else slot[rest]) + 1 & self.last
            own = self.keys[slot]
            hit = own == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            more = ~hit & (own >= 0)
            rest, slot = rest[more], slot[more]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]             # one of those that meet wins
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], slot[~won] + 1 & self.last


class Automaton:
    """Compiled merges; ``encode`` and ``decode`` are exact inverses on bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.pattern = pattern
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label = {i: bytes(symbols[c] for c in name) for name, i in vocab.items()
                      if name not in self.special}
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in
                       (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])])

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        size = max([*self.label, *self.special.values()]) + 1
        self.left, self.right = [-1] * size, [-1] * size
        self.age = [0] * size                  # merge that made the label, 0 for a byte
        self.without: list[dict[int, int]] = [{} for _ in range(size)]
        for step, (u, v, made) in enumerate(merges, 1):
            if self.arc(u, v, step - 1):       # else u is never followed by v
                self.left[made], self.right[made], self.age[made] = u, v, step
                self.without[u][v] = step
        self.latest = len(merges)
        self.size = {token: len(name) for token, name in self.label.items()}
        # Walk over label bytes, as one table (node, byte) -> node. A node where a label
        # ends has that label's id, the others have numbers from ``root`` on.
        live = {name: token for token, name in self.label.items()
                if self.age[token] or len(name) == 1}     # else no live merge makes it
        self.root, inner = size, {b"": size}
        self.step: dict[int, int] = {}
        for name in live:
            node = size
            for end in range(1, len(name) + 1):
                part = name[:end]
                after = live.get(part)
                if after is None:
                    after = inner.setdefault(part, size + len(inner))
                self.step[node << 8 | part[-1]] = after
                node = after
        self.walk = _Table((4 * len(self.step)).bit_length())
        self.walk.add(np.array(list(self.step), dtype=np.int64),
                      np.array(list(self.step.values()), dtype=np.int32))
        self.width = np.zeros(size, dtype=np.int64)
        self.width[list(self.size)] = list(self.size.values())

    def arc(self, entered: int, label: int, merge: int) -> bool:
        """Whether the state that ``entered`` arcs enter after ``merge`` has an arc ``label``."""
        left, right, age, without = self.left, self.right, self.age, self.without
        while True:
            if without[entered].get(label, merge + 1) <= merge:
                return False
            born = age[label]
            if age[entered] > born:            # to the chain that this one was copied from
                merge, entered = age[entered] - 1, right[entered]
            elif born == 0:
                return True
            else:
                merge, label = min(merge, born), left[label]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items()
                if k not in ("arcs", "arc_table", "find")}

    def ready(self) -> Automaton:
        """Adds the per-task memory of looked-up arcs."""
        self.arcs: dict[int, bool] = {}
        self.arc_table = _Table(20)
        self.find = regex.compile(self.pattern).findall
        return self

    def piece(self, text: str) -> bytes:
        """Ids of one pre-split piece as little-endian 32-bit integers.

        Follows the longest arc first. A byte position is entered by one canonical
        path only, so a position without a way to the end is left out from then on
        and the search stays linear.
        """
        data = text.encode("utf-8")
        n, root = len(data), self.root
        step, arcs, size, latest = self.step.get, self.arcs, self.size, self.latest
        path, waiting, closed = [], [], set()
        at, last = 0, -1
        while at < n:
            found, node = [], root             # tokens that begin here, shortest first
            for byte in memoryview(data)[at:]:
                node = step(node << 8 | byte)
                if node is None:
                    break
                if node < root:
                    found.append(node)
            waiting.append(found)
            while True:
                if not found:                  # no way on: back by one token
                    closed.add(at)
                    waiting.pop()
                    at -= size[path.pop()]
                    last = path[-1] if path else -1
                    found = waiting[-1]
                    continue
                token = found.pop()
                if at + size[token] in closed:
                    continue
                if last >= 0:                  # the first state has every arc
                    key = last << 20 | token
                    open_ = arcs.get(key)
                    if open_ is None:
                        open_ = arcs[key] = self.arc(last, token, latest)
                    if not open_:
                        continue
                path.append(token)
                at += size[token]
                last = token
                break
        if len(arcs) >= REMEMBERED:
            arcs.clear()
        return struct.pack(f"<{len(path)}I", *path)

    def _open(self, entered: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """``arc`` after all merges, for arrays; -1 for ``entered`` is the first state."""
        keys = np.where(entered < 0, -1, entered << 20 | labels)
        out = np.ones(len(keys), dtype=bool)
        asked = np.flatnonzero(keys >= 0)
        got = self.arc_table.get(keys[asked])
        new = np.unique(keys[asked[got < 0]])
        if len(new):
            told = np.array([self.arc(k >> 20, k & 0xFFFFF, self.latest) for k in new.tolist()])
            if self.arc_table.used + len(new) > REMEMBERED:
                self.arc_table = _Table(20)
            self.arc_table.add(new[:REMEMBERED], told[:REMEMBERED])
            missing = got < 0
            got[missing] = told[np.searchsorted(new, keys[asked[missing]])]
        out[asked] = got > 0
        return out

    def pieces(self, texts: list[str]) -> list[bytes]:
        """``piece`` of many: every round each takes its next arc or goes back by one."""
        data = [t.encode("utf-8") for t in texts]
        short = [k for k, d in enumerate(data) if len(d) <= SHORT]
        size = np.array([len(data[k]) for k in short], dtype=np.int64)
        symbols = np.frombuffer(b"".join([data[k] for k in short]), dtype=np.uint8).astype(np.int64)
        stop = np.cumsum(size)
        start = stop - size
        at, depth = start.copy(), np.zeros(len(short), dtype=np.int64)
        path = np.full((len(short), SHORT + 1), -1, dtype=np.int32)    # the first column is the start
        closed = np.zeros(len(short), dtype=np.uint64)                 # one bit a position
        row = np.flatnonzero(size)
        while len(row):
            token = self._longest(row, at[row], stop[row], path[row, depth[row]].astype(np.int64),
                                  closed[row], start[row], symbols)
            back, on = row[token < 0], row[token >= 0]
            closed[back] |= np.uint64(1) << (at[back] - start[back]).astype(np.uint64)
            at[back] -= self.width[path[back, depth[back]]]
            depth[back] -= 1
            depth[on] += 1
            token = token[token >= 0]
            path[on, depth[on]] = token
            at[on] += self.width[token]
            row = row[at[row] < stop[row]]
        out = [b""] * len(texts)
        taken = np.arange(1, SHORT + 1) <= depth[:, None]
        flat, ends = path[:, 1:][taken].astype("<u4").tobytes(), (4 * np.cumsum(depth)).tolist()
        for k, a, b in zip(short, [0, *ends], ends):
            out[k] = flat[a:b]
        for k, d in enumerate(data):
            if len(d) > SHORT:
                out[k] = self.piece(texts[k])
        return out

    def _longest(self, row, here, stop, last, closed, start, symbols) -> np.ndarray:
        """The longest label on an arc to a position that is not closed, -1 without one."""
        who = np.arange(len(row))
        node, found = np.full(len(row), self.root, dtype=np.int64), []
        while len(who):                        # labels that begin here, shortest first
            node = self.walk.get(node << 8 | symbols[here])
            on = np.flatnonzero(node >= 0)
            who, node, here = who[on], node[on], here[on] + 1
            ends = np.flatnonzero(node < self.root)
            found.append((who[ends], node[ends], here[ends]))
            on = np.flatnonzero(here < stop[who])
            who, node, here = who[on], node[on], here[on]
        token = np.full(len(row), -1, dtype=np.int64)
        for who, label, to in reversed(found):
            shut = closed[who] >> np.minimum(to - start[who], 63).astype(np.uint64) & np.uint64(1)
            sel = np.flatnonzero((token[who] < 0) & ((shut == 0) | (to == stop[who])))
            who, label = who[sel], label[sel]
            open_ = self._open(last[who], label)
            token[who[open_]] = label[open_]
        return token

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed; NULL counts as empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``encode`` of every text; the distinct pieces of about ``CHARS`` characters are
        encoded together."""
        held, chars = [], 0
        for text in texts:
            held.append(self._split(text or ""))
            chars += len(text or "")
            if chars >= CHARS:
                yield from self._joined(held)
                held, chars = [], 0
        yield from self._joined(held)

    def _split(self, text: str) -> list[tuple[list[str], bytes]]:
        """Pieces of a text up to each special token, and the id of that."""
        rest = [(text, b"")]
        for name, token in self.special.items():
            cut = []
            for part, after in rest:
                parts = part.split(name)
                cut += [(p, struct.pack("<I", token)) for p in parts[:-1]] + [(parts[-1], after)]
            rest = cut
        return [(self.find(part), after) for part, after in rest]

    def _joined(self, texts: list[list[tuple[list[str], bytes]]]) -> list[bytes]:
        wanted: set[str] = set()
        for parts in texts:
            for pieces, _ in parts:
                wanted.update(pieces)
        distinct = list(wanted)
        ids: dict[str, bytes] = {}
        for at in range(0, len(distinct), ABREAST):
            part = distinct[at:at + ABREAST]
            ids.update(zip(part, self.pieces(part)))
        get = ids.__getitem__
        return [b"".join([b"".join(map(get, pieces)) + after for pieces, after in parts])
                for parts in texts]

    def decode(self, ids: bytes) -> str:
        names = self.label | {i: s.encode("utf-8") for s, i in self.special.items()}
        return self._text(ids, names)

    @staticmethod
    def _text(ids: bytes, names: dict[int, bytes]) -> str:
        parts = map(names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(parts).decode("utf-8", errors="replace")


def encode(df: DataFrame, path: str, pattern: str, text: str = "text",
           ids: str = "ids", decoded: str | None = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (binary, little-endian 32-bit) and the decoded text to every row.

    Map-only. NULL and empty texts give empty ids and an empty decoded text; the
    vocabulary, whose size is fixed, travels with the task. ``decoded=None`` leaves
    the decoded text out. ``keep`` names the columns to carry, all by default; one
    named like a new column gives way to it. A task holds one Arrow batch and the
    results of ``ROWS_OUT`` rows.
    """
    auto = Automaton(path, pattern)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (ids, decoded)]
    fields = [T.StructField(c, df.schema[c].dataType) for c in kept]
    fields.append(T.StructField(ids, T.BinaryType()))
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto.ready()
        names = auto.label | {i: s.encode("utf-8") for s, i in auto.special.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                texts = part.column(part.num_columns - 1)
                packed = list(auto.encode_all(t.as_py() for t in texts))
                columns = [*part.columns[:-1], pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([auto._text(p, names) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    rows = df.select(*kept, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType(fields))


def digest(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Encodes, decodes and hashes in one map-only pass, so neither ids nor decoded
    texts travel.
    """
    auto = Automaton(path, pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto.ready()
        names = auto.label | {i: s.encode("utf-8") for s, i in auto.special.items()}
        for texts in batches:
            rows = []
            for ids in auto.encode_all(texts):
                back = auto._text(ids, names).encode("utf-8")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n", "i", "d"])

    got = df.select("doc_id", F.pandas_udf(run, "n long, i string, d string")(F.col("text"))
                    .alias("r"))
    return got.select("doc_id", F.col("r.n").alias("n_tokens"), F.col("r.i").alias("ids_sha256"),
                      F.col("r.d").alias("decoded_sha256"))
