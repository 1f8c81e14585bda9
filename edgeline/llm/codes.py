"""Vector code compression: product codes by active-entry Lloyd rounds.

Vectors become whole numbers and are cut into ``PARTS`` equal consecutive parts; every
part position has its own codebook of at most ``ENTRIES`` entries. A round assigns each
part to the nearest entry (lower index on ties) and moves every entry to the floored
mean of its parts.

A part keeps its entry and its exact squared distance from the round before. If that
entry did not move, every other unmoved entry still loses to it, so the part compares
only the entries that did move with the stored distance; otherwise all entries are
compared. The rows, packed to two or four bytes a component, are written once a round
together with this state; a lost executor reads them again. What goes through the
driver has a fixed size: the codebooks, and one sum per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeline.llm.tables import materialise

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components are held between these, so that every distance and sum of squares is
#: exact in 64 bits up to 4,096 components. Values beyond 16,384 are cut to it.
LIMIT = 1 << 24
#: Rows that one step of a task compares with all entries.
_BLOCK = 4096

Codebooks = list[np.ndarray]      # per part position: entries x width, whole numbers


def usable(vector: str = "embedding") -> Column:
    """True for a vector without a NULL or non-finite component."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(vector), good), F.lit(False))


def whole_numbers(vector: str = "embedding") -> Column:
    scaled = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(LIMIT - 1.0)),
                                          F.lit(-1.0 * LIMIT))).cast("int")
    return F.transform(F.col(vector), scaled)


def nearest(part: np.ndarray, book: np.ndarray, among: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row, lower index on ties.

    ``among`` names the entries to compare, in ascending order; all where it is None.
    """
    entries = book if among is None else book[among]
    widest = max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0))
    # Doubles hold these sums exactly while every term stays below 2 ** 53.
    exact = 4 * part.shape[1] * int(widest) ** 2 < 1 << 53
    kind = np.float64 if exact else np.int64
    e = entries.astype(kind)
    own = (e * e).sum(axis=1)
    at, best = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for start in range(0, len(part), _BLOCK):
        x = part[start:start + _BLOCK].astype(kind)
        # |x - e|^2 without |x|^2, which is the same for all entries of a row.
        apart = own - 2 * (x @ e.T)
        index = apart.argmin(axis=1)
        at[start:start + _BLOCK] = index
        best[start:start + _BLOCK] = (apart[np.arange(len(x)), index] + (x * x).sum(axis=1))
    return (at if among is None else among[at]), best


def reassign(part: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray,
             distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Assignment after a move of some entries, from the one before it.

    Rows whose entry moved compare every entry. The others compare the moved entries
    only, against their stored distance.
    """
    entry, distance = entry.copy(), distance.copy()
    lost = moved[entry]
    if lost.any():
        entry[lost], distance[lost] = nearest(part[lost], book)
    active = np.flatnonzero(moved)
    kept = np.flatnonzero(~lost)
    if len(active) and len(kept):
        at, near = nearest(part[kept], book, active)
        better = (near < distance[kept]) | ((near == distance[kept]) & (at < entry[kept]))
        entry[kept[better]], distance[kept[better]] = at[better], near[better]
    return entry, distance


def _unpacked(packed: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from packed ones; rows of both byte widths may meet."""
    sizes = np.diff(np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1,
                                  packed.offset * 4))
    data = packed.buffers()[2]
    first = np.frombuffer(packed.buffers()[1], np.int32, 1, packed.offset * 4)[0]
    body = np.frombuffer(data, np.uint8)[first:first + sizes.sum()] if data else np.empty(0, np.uint8)
    if not len(packed) or (sizes == sizes[0]).all():
        kind = np.int16 if len(packed) and sizes[0] == 2 * width else np.int32
        return body.view(kind).reshape(len(packed), width).astype(np.int64)
    return np.array([np.frombuffer(b.as_py(), np.int16 if len(b.as_py()) == 2 * width else np.int32)
                     for b in packed], dtype=np.int64)


def _packed(rows: np.ndarray) -> list[bytes]:
    """Two bytes a component where a batch's numbers allow it, else four."""
    small = rows.min(initial=0) >= -(1 << 15) and rows.max(initial=0) < 1 << 15
    return [r.tobytes() for r in rows.astype(np.int16 if small else np.int32)]


def _column(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _state_schema(rows: DataFrame) -> T.StructType:
    keep = [rows.schema[c] for c in ("vec_id", "label")]
    more = T.StructType.fromDDL("v binary, code binary, near binary, part int, entry int, "
                                "n long, total array<long>")
    return T.StructType(keep + more.fields)


def assigned(rows: DataFrame, books: Codebooks, moved: list[np.ndarray] | None) -> DataFrame:
    """Rows with their entries and distances, and one row of sums per task and entry.

    At first ``rows`` holds vec_id, label and whole numbers ``w``, and ``moved`` is None;
    later rows are those of the round before. A task adds up the parts of every entry
    over all its batches and gives the sums as rows with a ``part`` behind its other
    rows, so the vectors are read once a round.
    """
    width = books[0].shape[1]
    schema = _state_schema(rows)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        kinds = None
        for batch in batches:
            n = batch.num_rows
            kinds = [batch.column(c).type for c in ("vec_id", "label")]
            code, near = np.empty((n, PARTS), np.uint8), np.empty((n, PARTS), np.int64)
            if moved is None:
                v = batch.column("w").flatten().to_numpy().reshape(n, -1).astype(np.int64)
                packed = pa.array(_packed(v), pa.binary())
            else:
                packed = batch.column("v")
                v = _unpacked(packed, width * PARTS)
                old = _rows_of(batch.column("code"), np.uint8, n).astype(np.int64)
                stored = _rows_of(batch.column("near"), np.int64, n)
            for p, book in enumerate(books):
                part = v[:, p * width:(p + 1) * width]
                at, best = (nearest(part, book) if moved is None else
                            reassign(part, book, moved[p], old[:, p], stored[:, p]))
                code[:, p], near[:, p] = at, best
                _add_up(count[p], total[p], at, part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), packed, _column(code), _column(near),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                 pa.array(near.sum(axis=1), pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=names)
        for p in range(PARTS) if kinds else ():
            used = np.flatnonzero(count[p])
            m = len(used)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(m, k) for k in kinds], *[pa.nulls(m, pa.binary())] * 3,
                 pa.array(np.full(m, p), pa.int32()), pa.array(used, pa.int32()),
                 pa.array(count[p][used], pa.int64()),
                 pa.array(list(total[p][used]), pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(run, schema)


def _add_up(count: np.ndarray, total: np.ndarray, at: np.ndarray, part: np.ndarray) -> None:
    """Adds the rows of every entry to its count and total."""
    if len(at):
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        total[used] += np.add.reduceat(part[order], first, axis=0)
        count += np.bincount(at, minlength=len(count))


def _rows_of(column: pa.Array, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, PARTS)


def _moved(books: Codebooks, sums: DataFrame) -> tuple[Codebooks, list[np.ndarray]]:
    """Codebooks at the floored means, and which entries changed. Unused entries stay."""
    width = books[0].shape[1]
    each = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    new = [b.copy() for b in books]
    for r in each.collect():      # one row per entry: a fixed number
        new[r.part][r.entry] = [t // r.n for t in r.total]
    return new, [(a != b).any(axis=1) for a, b in zip(books, new)]


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES
          ) -> tuple[DataFrame, Codebooks]:
    """Final assignment (vec_id, label, code, error) and the codebooks.

    ``vectors`` holds vec_id, label and an array ``embedding``; other columns are
    ignored. Rows whose vector is NULL or holds a NULL or non-finite component are
    left out, as are those whose length differs from that of the row first by id with
    a length that ``PARTS`` divides. The codebooks start from the rows first by id;
    a NULL id comes last, and equal ids are ordered by their vectors. Fewer rows than
    ``entries`` give smaller codebooks, none gives an empty result.
    """
    kept = (vectors.filter(usable()).select("vec_id", "label", whole_numbers().alias("w"))
            .filter((F.size("w") > 0) & (F.size("w") % PARTS == 0)))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("w")]
    head = kept.orderBy(*by_id).limit(1).select(F.size("w").alias("n")).collect()
    size = head[0].n if head else PARTS
    kept = kept.filter(F.size("w") == size)
    start = np.array([r.w for r in kept.orderBy(*by_id).limit(entries).select("w").collect()],
                     dtype=np.int64).reshape(-1, size)
    width = size // PARTS
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(PARTS)]
    if not len(start):
        return _outcome(assigned(kept, [np.zeros((1, width), np.int64)] * PARTS, None)), []
    rows, moved = kept, None
    for i in range(rounds):
        state = materialise(assigned(rows, books, moved), f"codes-round-{i}")
        books, moved = _moved(books, state.filter(F.col("part").isNotNull()))
        rows = state.filter(F.col("part").isNull())
    return _outcome(materialise(assigned(rows, books, moved), "codes-final")), books


def _outcome(state: DataFrame) -> DataFrame:
    return state.filter(F.col("part").isNull()).select(
        "vec_id", "label", "code", F.col("n").alias("error"))


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and position, decimal, comma-joined."""
    parts = [",".join(map(str, b.ravel().tolist())) for b in books]
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def decode(code: bytes, books: Codebooks) -> np.ndarray:
    """The whole numbers that a code stands for."""
    return np.concatenate([book[c] for book, c in zip(books, code)])


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256, one row per kept vector.

    ``error`` is the squared distance to the code's entries over all parts; label_error
    adds it up over rows of equal label, NULL labels together, and is NULL beyond 64
    bits. Repeated rows stay.
    """
    final, books = train(vectors, rounds, entries)
    rows = final.withColumn("code", F.lower(F.hex("code")))
    per_label = rows.groupBy(F.col("label").alias("__label")).agg(
        F.try_sum("error").alias("label_error"))
    # The labels' number is not known: Spark broadcasts the sums only below its size
    # limit and otherwise splits a label that holds many rows.
    return (rows.join(per_label, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "code", "error", "label_error",
                    F.lit(digest(books)).alias("codebooks_sha256")))
