"""Compression classifier, conversation repair and vector codes against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as contract
from edgeline.llm import codes, compression, conversations
from edgeline.llm import turn_grammar as tg

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0D]"
CONV = "conv_id long, turn long, role string, text string"


# ---- conversations: brute force --------------------------------------------
def damaged(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
                          .encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    mark = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, mark(r)))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(SPACE, "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else
                   "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest_by_enumeration(rows, found):
    """Every choice for every row and up to two inserts in every gap."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    ways = [[("D", 2, "")] if f in ("blank", "duplicate") else
            [("D", 2, ""), ("K", 5 * (f == "truncated"), r[2][:1]),
             ("R", 1 + 5 * (f == "truncated"), "u"), ("R", 1 + 5 * (f == "truncated"), "a")]
            for r, f in zip(rows, found)]
    for chosen in itertools.product(*ways):
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(c[2] + g for c, g in zip(chosen, gaps[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(c[1] for c in chosen) + 5 * len("".join(gaps))
                letters = "I" * len(gaps[0]) + "".join(
                    c[0] + "I" * len(g) for c, g in zip(chosen, gaps[1:]))
                best = min(best or (cost, letters), (cost, letters))
    return best


def cheapest(rows, found):
    """Row by row: the best (cost, letters) of each state of the roles read so far."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}

    def opened(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, letters) in list(ways.items()):
                for role in "ua":
                    to = step.get((state, role))
                    if to is not None:
                        new = (cost + 5, letters + "I")
                        ways[to] = min(ways.get(to, new), new)
        return ways

    ways = {"": (0, "")}
    for row, fault in zip(rows, found):
        nxt = {}
        for state, (cost, letters) in opened(ways).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                initial = row[2][:1]
                kept = state if initial == "" else step.get((state, initial))
                options += [(kept, more, "K")]
                options += [(step.get((state, r)), 1 + more, "R") for r in "ua"]
            for to, price, letter in options:
                if to is not None:
                    new = (cost + price, letters + letter)
                    nxt[to] = min(nxt.get(to, new), new)
        ways = nxt
    return min(w for s, w in opened(ways).items() if s in ("", "ua"))


def repaired_lines(rows, letters):
    lines, at, last = [], 0, ""
    def made():
        nonlocal last
        last = "a" if last == "u" else "u"
        return "user" if last == "u" else "assistant"
    for _, _, role, text in [*rows, (None, None, None, None)]:
        while letters[at:at + 1] == "I":
            lines.append(made() + ":")
            at += 1
        if role is None:
            break
        if letters[at] == "R":
            lines.append(f"{made()}:{text}")
        elif letters[at] == "K":
            lines.append(f"{role}:{text}")
            last = role[:1] or last
        at += 1
    return lines


def expected(table):
    out = {}
    rows = damaged(table)
    for conv in {r[0] for r in table}:
        mine = in_order([r for r in rows if r[0] == conv])
        found = faults(mine)
        turns = {r[1] for r in mine} - {None}
        initials = [r[2][:1] for r in mine]
        cost, letters = cheapest(mine, found)
        sha = hashlib.sha256("\n".join(repaired_lines(mine, letters)).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, letters, sha)
    return out


def as_dict(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                     "audit", "repaired_sha256").collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


TEXTS = ["Yes.", "No", "", " \t", "Why?", "Well!", "Because it is so", None, "é.", "Yes.\n", "a" * 3000 + "."]
ROLES = ["user", "assistant", "system", "tool", None, "", "usher"]


def random_table(seed, convs=60, longest=9):
    r = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(r.randint(1, longest)):
            role = r.choices(ROLES, [6, 6, 2, 1, 1, 1, 1])[0]
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role,
                         r.choices(TEXTS, [6, 3, 1, 1, 4, 4, 2, 1, 1, 1, 1])[0]))
    r.shuffle(rows)
    return rows


def test_cheapest_repair_by_enumeration():
    r = random.Random(8)
    grammar = tg.Grammar()
    kinds = {"s": tg.SYSTEM, "u": tg.USER, "a": tg.ASSISTANT, "": tg.EMPTY, "t": tg.OTHER}
    code = {"": tg.FINE, "blank": tg.BLANK, "duplicate": tg.DUPLICATE, "truncated": tg.TRUNCATED}
    for _ in range(25):
        n = r.randint(1, 3)
        rows = [(0, i, r.choice(["user", "assistant", "system", "tool", ""]), "x") for i in range(n)]
        found = [r.choice(["", "", "blank", "truncated"]) for _ in range(n)]
        want = cheapest_by_enumeration(rows, found)
        assert cheapest(rows, found) == want
        run = bytes(kinds[row[2][:1]] * tg.FAULTS + code[f] for row, f in zip(rows, found))
        assert tg.outcome(grammar.evaluate(run).matrix) == want


def test_rules_do_not_change_the_outcome():
    r = random.Random(2)
    runs = [bytes(r.choice([0, 4, 4, 8, 8, 7, 11, 5]) for _ in range(r.randint(1, 60)))
            for _ in range(40)] + [bytes([4, 8] * 500), bytes([4] * 501)]
    levels, symbol = [], tg.TERMINALS
    for _ in range(6):
        total = {}
        for run in runs:
            for pair, n in tg.pair_counts(tg.replaced(list(run), levels)).items():
                total[pair] = total.get(pair, 0) + n
        level = tg.next_level(sorted(((a, b, n) for (a, b), n in total.items() if n > 1),
                                     key=lambda x: (-x[2], x[0], x[1]))[:8], symbol)
        if not level:
            break
        levels.append(level)
        symbol += len(level)
    assert len(tg.replaced(list(runs[-2]), levels)) < 40
    plain, shared = tg.Grammar(), tg.Grammar(levels)
    for run in runs:
        a, b = plain.evaluate(run), shared.evaluate(run)
        assert tg.outcome(a.matrix) == tg.outcome(b.matrix)
        assert (a.faults, a.illegal, a.first, a.last) == (b.faults, b.illegal, b.first, b.last)


def test_pair_counts_equal_the_replacements():
    r = random.Random(5)
    for _ in range(200):
        seq = [r.randint(0, 2) for _ in range(r.randint(0, 30))]
        for pair, n in tg.pair_counts(seq).items():
            assert len(seq) - len(tg.replaced(seq, [{pair: 99}])) == n


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_repair(spark, seed):
    table = random_table(seed)
    df = spark.createDataFrame(table, CONV).withColumns({
        "audit": F.lit("x"), "kind": F.lit(1), "digest": F.lit(2), "n": F.lit(3), "at": F.lit(0)})
    assert as_dict(conversations.repair(df.repartition(5))) == expected(table)


def test_long_conversation_in_many_runs(spark, monkeypatch):
    """Runs of seven rows and products of two: several levels of one conversation."""
    r = random.Random(3)
    table = [(c, t, r.choice(["user", "assistant"]), r.choice(["A.", "B", f"t{t}."]))
             for c, n in ((1, 700), (2, 3), (3, 90)) for t in range(n)]
    monkeypatch.setattr(conversations, "RUN", 7)
    monkeypatch.setattr(conversations, "FAN", 2)
    assert as_dict(conversations.repair(spark.createDataFrame(table, CONV))) == expected(table)


def test_repaired_rows(spark):
    table = random_table(6, convs=20)
    rows = spark.createDataFrame(damaged(table), CONV)
    heads = conversations.audit(rows)
    got = {}
    for r in sorted(conversations.repaired(rows, heads).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    letters = {r.conv_id: r.audit for r in heads.collect()}
    for conv, audit in letters.items():
        mine = in_order([r for r in damaged(table) if r[0] == conv])
        assert got.get(conv, []) == repaired_lines(mine, audit)


def test_conversations_without_rows(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = as_dict(conversations.repair(spark.createDataFrame([(lost, 0, "user", "Hi.")], CONV)))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(spark.createDataFrame([], CONV)).collect() == []


# ---- vector codes ----------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_lloyd(rows, rounds=4, entries=256):
    """Every part against every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    if not first:
        return [], ""
    w = len(first[0][1]) // 4
    books = [[list(v[p * w:(p + 1) * w]) for _, v, _ in first] for p in range(4)]

    def assign():
        out = []
        for _, v, _ in kept:
            best = []
            for p in range(4):
                part = v[p * w:(p + 1) * w]
                best.append(min((sum((a - b) ** 2 for a, b in zip(part, e)), k)
                                for k, e in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(4):
            for k in range(len(books[p])):
                mine = [v[p * w:(p + 1) * w] for (_, v, _), b in zip(kept, got) if b[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    per = {}
    coded = [(i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), lab)
             for (i, _, lab), b in zip(kept, assign())]
    for _, _, e, lab in coded:
        per[lab] = per.get(lab, 0) + e
    return sorted(((i, c, e, per[lab]) for i, c, e, lab in coded), key=str), sha


def vector_rows(n, seed=0, width=8):
    r = random.Random(seed)
    rows = [(r.randint(0, n), [float(np.float32(r.gauss(r.choice([-.2, .3]), .05))) for _ in range(width)],
             r.choice([1, 2, None])) for _ in range(n)]
    bad = [(3, None, 1), (4, [None] + [0.1] * (width - 1), 1), (5, [float("nan")] * width, 1),
           (6, [float("inf")] * width, None), (None, [0.25] * width, 1), (None, [0.25] * width, 1)]
    return rows + bad + rows[:5]


@pytest.mark.parametrize("n, entries", [(150, 12), (40, 256), (1, 4)])
def test_codes_equal_plain_lloyd(spark, n, entries):
    rows = vector_rows(n, seed=n)
    want, sha = plain_lloyd(rows, entries=entries)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"code": F.lit(1), "n": F.lit("x"),
                                                           "part": F.lit(2), "w": F.lit(0)})
    got = codes.compress(df.repartition(3), entries=entries).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_reassign_equals_a_full_search():
    r = np.random.default_rng(4)
    for _ in range(30):
        part = r.integers(-9, 9, (60, 3))
        old = r.integers(-9, 9, (11, 3))
        new = old.copy()
        which = r.random(11) < r.choice([0.0, 0.2, 0.9])
        new[which] += r.integers(-2, 3, (int(which.sum()), 3))
        moved = (old != new).any(axis=1)
        got = codes.reassign(part, new, moved, *codes.nearest(part, old))
        want = codes.nearest(part, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        brute = ((part[:, None] - new[None]) ** 2).sum(axis=2)
        assert (want[0] == brute.argmin(axis=1)).all() and (want[1] == brute.min(axis=1)).all()


def test_large_components_stay_exact():
    r = np.random.default_rng(1)
    part, book = r.integers(-(1 << 24), 1 << 24, (20, 16)), r.integers(-(1 << 24), 1 << 24, (9, 16))
    at, best = codes.nearest(part, book)
    brute = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in book] for p in part]
    assert at.tolist() == [min(range(9), key=lambda k: d[k]) for d in brute]
    assert best.tolist() == [min(d) for d in brute]


def test_mixed_widths_unpack():
    import pyarrow as pa
    small, wide = np.arange(8).reshape(1, 8), np.arange(8).reshape(1, 8) * 100_000
    both = pa.array(codes._packed(small) + codes._packed(wide), pa.binary())
    assert (codes._unpacked(both, 8) == np.vstack([small, wide])).all()
    assert (codes._unpacked(both.slice(1), 8) == wide).all()


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [], 1), (3, [0.1] * 6, 1)]):
        assert codes.compress(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_codes_against_sql(spark):
    df = contract.queries()["op13_vector_codes"](spark, SF)
    n, problem = differences(df, connect(SF), contract.oracle_sql()["op13_vector_codes"])
    assert problem == "" and n > 0


# ---- compression -----------------------------------------------------------
DOCS = "doc_id long, text string"


def noisy(seed, good):
    r = random.Random(seed)
    pool = "the of and house river stone walks under bright evening light many people said".split()
    words = [r.choice(pool) + r.choice(["", "", ",", "."]) for _ in range(r.randint(15, 300))]
    return " ".join(words) if good else " ".join(w.upper() + r.choice(["$$$", "!!"]) for w in words)


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(i, noisy(i, i % 3 > 0)) for i in range(400)]
    rows += [(1000, ""), (1001, None), (None, "no id here"), (7, "another text of one id"),
             (1002, noisy(1, True) * 400)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(7, 1), (7, 0), (None, 1), (9, None), (1000, 1)]
    return (spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_compression_separates_held_out_texts(spark, graded):
    docs, labels = graded
    model = compression.fit(docs, labels.filter(~compression.held_out(labels)))
    clashing = docs.withColumns({"score": F.lit("x"), "difference": F.lit(1), "good": F.lit(0), "h": F.lit(5)})
    got = compression.score(clashing, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 7 and r.doc_id % 2]
    right = [(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in test]
    assert sum(right) >= 0.97 * len(right)
    empty = {r.score for r in got if not r.text}
    assert len(empty) == 1
    assert next(r for r in got if r.doc_id == 1002).score > 0.9
    # The difference as defined, from the dictionaries alone.
    for r in test[:10]:
        data, sizes = r.text.encode(), []
        for content in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content),
                                         write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(max(len(c.compress(data[i:i + 1024])) - 9, 1) for i in range(0, len(data), 1024)))
        assert r.difference == pytest.approx((sizes[1] - sizes[0]) / sum(sizes), abs=1e-12)
        p = 1 / (1 + math.exp(-(model.slope * r.difference + model.bias)))
        assert r.score == pytest.approx(p, abs=1e-9)


def test_compression_without_labels(spark, graded):
    docs, labels = graded
    none = compression.fit(docs, labels.limit(0))
    assert {r.score for r in compression.score(docs, none).collect()} == {0.5}
    ones = compression.fit(docs, labels.filter("quality = 1"))
    assert len({r.score for r in compression.score(docs, ones).collect()}) == 1
    empty = compression.fit(docs.limit(0), labels)
    assert compression.score(docs.limit(0), empty).collect() == []


def test_logistic_equals_its_condition():
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    y = (r.random(500) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, bias = compression.logistic(x, y, np.ones(500), ridge=0.0)
    p = 1 / (1 + np.exp(-(slope * x + bias)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * x).sum()) < 1e-6


def test_quality_classifier_on_held_out_labels(spark):
    got = contract.queries()["op11_quality_classifier"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = got.filter("held_out").join(labels, "doc_id").filter("quality is not null").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.35
