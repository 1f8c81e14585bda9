"""Conversation structure repair by a grammar-compressed dynamic programme.

Rows of a conversation become symbols (role class and fault). Runs of at most ``RUN``
symbols in order are compressed by Re-Pair rules that all conversations share: pairs
are counted over all runs, and the commonest become rules, level by level. Every rule
has one min-plus matrix with the letters of its edits (``turn_grammar``); a run's
matrix is the product of few of them, and the runs of a conversation multiply in turn.

Only small rows are sorted for this: ids, turns and digests. They are dealt by range,
so a conversation of any length spreads over tasks. Texts move once, for the digest of
the repaired conversation, which one task reads row by row as a digest has to be.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeline.llm import turn_grammar as tg
from edgeline.llm.tables import materialise

#: Most rows of a conversation that one run holds.
RUN = 4096
#: Levels of rules, and pairs looked at for each; both only decide how much is shared.
LEVELS, PAIRS = 8, 64
#: Runs of one conversation that one step multiplies.
FAN = 64
SPACES = " \t\n\x0b\x0c\r"
FINAL = (".", "!", "?")
_CELLS = [(i, j) for i in range(tg.STATES) for j in range(tg.STATES)]


# ---- damage ----------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after a seeded damage of one row in four.

    The remainder of crc32 of ``conv_id:turn`` by 20 drops a row (0), empties its text
    (1), takes ``.!?`` out of it (2), repeats it (3) or makes it the user's (4). A NULL
    counts as one space in that key, as role and as text.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"),
                                spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


# ---- symbols ---------------------------------------------------------------
def digest() -> Column:
    """What tells rows apart: 16 bytes of role and text."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
                         .cast("binary")))


def own_fault() -> Column:
    """Blank, truncated or fine, by the row's text alone."""
    body = F.rtrim("text", F.lit(SPACES))
    return (F.when(body == "", tg.BLANK)
            .when(~F.substring(body, -1, 1).isin(*FINAL), tg.TRUNCATED).otherwise(tg.FINE))


def role_class() -> Column:
    initial = F.substring("role", 1, 1)
    return (F.when(initial == "s", tg.SYSTEM).when(initial == "u", tg.USER)
            .when(initial == "a", tg.ASSISTANT).when(initial == "", tg.EMPTY).otherwise(tg.OTHER))


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, at and symbol of every row, sorted by conversation and turn over the
    partitions; ``at`` rises along that order.

    Rows of one turn are ordered by their digest. Equal rows are counted before they
    are dealt and unfolded behind that: the first of a conversation's equal rows is
    itself, every later one a duplicate.
    """
    small = rows.select("conv_id", "turn", digest().alias("digest"),
                        role_class().alias("role_class"), own_fault().alias("fault"))
    each = materialise(small.groupBy("conv_id", "turn", "digest", "role_class", "fault")
                       .agg(F.count(F.lit(1)).alias("n")), "conversation-rows")
    again = (each.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
             .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
             .filter("turns > 1").drop("turns"))
    marked = each.join(again, F.col("conv_id").eqNullSafe(F.col("c"))
                       & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = marked.select("conv_id", "turn", "digest", "role_class", "fault", "n",
                           later.alias("later"))
    ordered = (marked.repartitionByRange("conv_id", "turn", "digest")
               .sortWithinPartitions("conv_id", "turn", "digest")
               .select("conv_id", "role_class", "fault", "later",
                       F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")))
    repeats = (F.col("later") | (F.col("i") > 1)) & (F.col("fault") != tg.BLANK)
    fault = F.when(repeats, tg.DUPLICATE).otherwise(F.col("fault"))
    return ordered.select("conv_id", F.monotonically_increasing_id().alias("at"),
                          (F.col("role_class") * tg.FAULTS + fault).cast("byte").alias("symbol"))


def runs(ordered: DataFrame) -> DataFrame:
    """Neighbouring symbols of one conversation as runs (conv_id, at, symbols)."""
    schema = T.StructType([ordered.schema["conv_id"], *T.StructType.fromDDL(
        "at long, symbols binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("conv_id").dictionary_encode()
            code = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(code, prepend=-2)) if len(code) else np.empty(0, int)
            ends = np.append(starts[1:], len(code))
            cuts = np.array([c for a, b in zip(starts, ends) for c in range(a, b, RUN)], dtype=int)
            data = batch.column("symbol").to_numpy(zero_copy_only=False).astype(np.uint8)
            pieces = [p.tobytes() for p in np.split(data, cuts[1:])] if len(cuts) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(cuts)), batch.column("at").take(pa.array(cuts)),
                 pa.array(pieces, pa.binary())], names=schema.names)

    return ordered.mapInArrow(run, schema)


# ---- grammar ---------------------------------------------------------------
def learn_grammar(all_runs: DataFrame, levels: int = LEVELS, pairs: int = PAIRS) -> list[tg.Level]:
    """Re-Pair rules of all runs. Equal runs of a batch are replaced and counted once;
    the driver sees at most ``pairs`` counts a level."""
    rules: list[tg.Level] = []
    symbol = tg.TERMINALS
    for _ in range(levels):
        known = list(rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for entry in batch.column("symbols").value_counts():
                    often = entry["counts"].as_py()
                    left = tg.replaced(np.frombuffer(entry["values"].as_py(), np.uint8).tolist(), known)
                    for pair, n in tg.pair_counts(left).items():
                        total[pair] += n * often
            # No more rows than there are pairs of symbols.
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int32()),
                 pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])

        counts = (all_runs.select("symbols").mapInArrow(count, "a int, b int, n long")
                  .groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1")
                  .orderBy(F.desc("n"), "a", "b").limit(pairs).collect())
        level = tg.next_level([(r.a, r.b, r.n) for r in counts], symbol)
        if not level:
            break
        rules.append(level)
        symbol += len(level)
    return rules


# ---- matrices as columns ---------------------------------------------------
_ELEMENT = ("costs array<long>, letters array<string>, blank long, duplicate long, "
            "truncated long, illegal long, first int, last int")


def _fields(e: tg.Element) -> tuple:
    cells = [e.matrix.get(c) for c in _CELLS]
    return ([None if c is None else c[0] for c in cells],
            [None if c is None else tg.flat(c[1]) for c in cells], *e.faults, e.illegal, e.first, e.last)


def _element(row: dict) -> tg.Element:
    matrix = {c: (cost, text) for c, cost, text in zip(_CELLS, row["costs"], row["letters"])
              if cost is not None}
    return tg.Element(matrix, (row["blank"], row["duplicate"], row["truncated"]), row["illegal"],
                      row["first"], row["last"])


def _element_columns(elements: list[tg.Element]) -> list[pa.Array]:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.int32(), pa.int32()]
    columns = list(zip(*map(_fields, elements))) or [()] * len(kinds)
    return [pa.array(list(c), k) for c, k in zip(columns, kinds)]


def evaluated(all_runs: DataFrame, rules: list[tg.Level]) -> DataFrame:
    """Runs with their elements instead of their symbols."""
    schema = T.StructType([all_runs.schema["conv_id"], *T.StructType.fromDDL(
        f"at long, {_ELEMENT}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = tg.Grammar(rules)
        for batch in batches:
            found = [grammar.evaluate(s) for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("at"), *_element_columns(found)],
                names=schema.names)

    return all_runs.mapInArrow(run, schema)


def multiplied(elements: DataFrame) -> DataFrame:
    """One element for each conversation, from those of its runs in order of ``at``.

    At most ``FAN`` runs meet in a step, so a long conversation takes more steps.
    """
    w = Window.partitionBy("conv_id")
    # Runs are few: one for each ``RUN`` rows of a conversation.
    placed = materialise(elements.withColumns({
        "ord": F.row_number().over(w.orderBy("at")) - 1, "runs": F.count(F.lit(1)).over(w)}), "runs")
    schema = elements.schema
    done = placed.filter("runs = 1").select(*schema.names)
    rest = placed.filter("runs > 1")

    def product(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["ord"])
        one = tg.combined([_element(r) for r in rows])
        return pa.Table.from_arrays(
            [group.column("conv_id").slice(0, 1), pa.array([rows[0]["at"]], pa.int64()),
             *_element_columns([one]), pa.array([rows[0]["ord"] // FAN], pa.int32())],
            names=[*schema.names, "ord"])

    longest = rest.agg(F.max("runs")).collect()[0][0] or 1
    out = T.StructType([*schema.fields, T.StructField("ord", T.IntegerType())])
    while longest > 1:
        rest = (rest.groupBy("conv_id", F.floor(F.col("ord") / FAN).alias("block"))
                .applyInArrow(product, out))
        longest = -(-longest // FAN)
    return done.unionByName(rest.select(*schema.names))


def audits(elements: DataFrame) -> DataFrame:
    """conv_id, counts of faults and illegal neighbours, cost and audit letters."""
    schema = T.StructType([elements.schema["conv_id"], *T.StructType.fromDDL(
        "blank long, duplicate long, truncated long, illegal long, cost long, audit string").fields])
    counts = ["blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [tg.outcome(_element(r).matrix) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *[batch.column(c) for c in counts],
                 pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())],
                names=schema.names)

    return elements.mapInArrow(run, schema)


def audit(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text)."""
    all_runs = materialise(runs(symbols(rows)), "conversation-runs")
    return audits(multiplied(evaluated(all_runs, learn_grammar(all_runs, levels))))


# ---- repaired texts --------------------------------------------------------
class _Repair:
    """Applies the letters of one conversation to its rows as they come."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def _made(self) -> str:
        role = tg.ASSISTANT if self.state == 2 else tg.USER
        self.state = tg.STEP[role][self.state]
        return "assistant" if role == tg.ASSISTANT else "user"

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.letters[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            yield self._made(), text
        elif letter == "K":
            kind = {"s": tg.SYSTEM, "u": tg.USER, "a": tg.ASSISTANT, "": tg.EMPTY}[role[:1]]
            self.state = tg.STEP[kind][self.state]
            yield role, text


def _together(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Every head (conv_id, audit and others) followed by its rows in order."""
    keys = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema.fields if f.name != "conv_id"}
    more = {f.name: F.lit(None).cast(f.dataType) for f in heads.schema.fields if f.name != "conv_id"}
    firsts = heads.withColumns({**keys, "digest": F.lit(None).cast("binary"), "kind": F.lit(0)})
    behind = rows.withColumns({**more, "digest": digest(), "kind": F.lit(1)})
    return (firsts.unionByName(behind).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", "turn", "digest"))


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role and text.

    ``heads`` holds conv_id and audit; rows of other conversations are not allowed.
    """
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(
        "place long, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, owner, place = _Repair(""), None, 0
        out: list[tuple] = []

        def add(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in lines:
                out.append((owner, place, role, text))
                place += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=schema.names)
            out.clear()
            return made

        kinds = None
        for batch in batches:
            kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.string()]
            for conv, kind, letters, role, text in zip(*[batch.column(c).to_pylist() for c in (
                    "conv_id", "kind", "audit", "role", "text")]):
                if kind == 0:
                    add(repair.inserts())
                    repair, owner, place = _Repair(letters), conv, 0
                else:
                    add(repair.row(role, text))
            if out:
                yield batch_of()
        add(repair.inserts())
        if out:
            yield batch_of()

    return _together(rows.select("conv_id", "turn", "role", "text"),
                     heads.select("conv_id", "audit")).mapInArrow(run, schema)


def with_digest(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` with repaired_sha256 of their repaired ``role:text`` lines.

    A task holds one digest at a time and no conversation, however long.
    """
    schema = T.StructType([*heads.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    names = heads.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, repair, sha, empty = None, _Repair(""), hashlib.sha256(), True

        def add(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal empty
            for role, text in lines:
                sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False

        def closed(ended: list[pa.Table], hexes: list[str]) -> list[pa.RecordBatch]:
            return (pa.concat_tables(ended).append_column("repaired_sha256", pa.array(hexes, pa.string()))
                    .combine_chunks().to_batches())

        for batch in batches:
            mine = pa.Table.from_batches([batch]).select(names)
            ended, hexes = [], []
            for i, (kind, letters, role, text) in enumerate(zip(*[
                    batch.column(c).to_pylist() for c in ("kind", "audit", "role", "text")])):
                if kind:
                    add(repair.row(role, text))
                    continue
                if held is not None:
                    add(repair.inserts())
                    ended.append(held)
                    hexes.append(sha.hexdigest())
                held, repair, sha, empty = mine.slice(i, 1), _Repair(letters), hashlib.sha256(), True
            if ended:
                yield from closed(ended, hexes)
        if held is not None:
            add(repair.inserts())
            yield from closed([held], [sha.hexdigest()])

    return _together(rows.select("conv_id", "turn", "role", "text"), heads).mapInArrow(run, schema)


def repair(conversations: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Damage, faults and cheapest repair of every conversation.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 for every conv_id, also for one that lost all its rows and for
    NULL. A NULL turn comes first. Rows of one turn are ordered by a digest of role and
    text. A row whose role is empty adds no initial and may stay anywhere. Extra columns
    are ignored, an empty table gives no row.
    """
    rows = damage(conversations)
    turns = (rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("left")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
    found = audit(rows, levels)
    # One row for each conversation on every side.
    heads = (conversations.select("conv_id").distinct()
             .join(turns.withColumnRenamed("conv_id", "c1"),
                   F.col("conv_id").eqNullSafe(F.col("c1")), "left")
             .join(found.withColumnRenamed("conv_id", "c2"),
                   F.col("conv_id").eqNullSafe(F.col("c2")), "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    heads = heads.select("conv_id", *[zero(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"))
    return with_digest(rows, heads)
