"""Min-plus matrices over role/fault symbols, and the Re-Pair rules that share them.

A symbol is one row of a conversation: the class of its role's first character and its
fault. An automaton with four states reads the roles of a repaired conversation,
``(s?(ua)+)?``. The matrix of a symbol holds, for every pair of states, the cheapest
edits of that row (inserts before it included) with the letters of these edits; among
equal costs the letters first in ASCII order. Matrices multiply, so a rule's matrix is
the product of its two sides', computed once and used by every conversation.

Letters are kept as ropes, strings or pairs of ropes, so that rules share them too.
Ties are sound: of two letter strings of the same rows at the same cost none is a proper
prefix of the other, as the rest would be inserts, which cost; so concatenation keeps
their order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SYSTEM, USER, ASSISTANT, EMPTY, OTHER = range(5)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = 4
#: One symbol for every role class and fault.
TERMINALS = 5 * FAULTS

REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = 4
STEP = {SYSTEM: {0: 1}, USER: {0: 2, 1: 2, 3: 2}, ASSISTANT: {2: 3},
        EMPTY: {q: q for q in range(STATES)}, OTHER: {}}
ACCEPTING = (0, 3)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def letters(rope: Rope) -> Iterator[str]:
    """The pieces of a rope from left to right; any depth."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack += [top[1], top[0]]
        elif top:
            yield top


def flat(rope: Rope) -> str:
    return "".join(letters(rope))


def _first(a: Rope, b: Rope) -> bool:
    """True if rope ``a`` comes before ``b``; reads no further than they differ."""
    x, y, i, j = "", "", 0, 0
    left, right = letters(a), letters(b)
    while True:
        if i == len(x):
            x, i = next(left, ""), 0
        if j == len(y):
            y, j = next(right, ""), 0
        if not x or not y:
            return not x and bool(y)
        n = min(len(x) - i, len(y) - j)
        if x[i:i + n] != y[j:j + n]:
            return x[i:i + n] < y[j:j + n]
        i, j = i + n, j + n


def join(a: Rope, b: Rope) -> Rope:
    return (a, b) if a and b else a or b


def better(found: tuple[int, Rope], held: tuple[int, Rope] | None) -> bool:
    return (held is None or found[0] < held[0]
            or found[0] == held[0] and found[1] is not held[1] and _first(found[1], held[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: the cheapest way over any middle state, ties by letters."""
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(STATES):
            step = b.get((k, j))
            if step is not None:
                found = (cost + step[0], join(rope, step[1]))
                if better(found, out.get((i, j))):
                    out[i, j] = found
    return out


def _inserts() -> Matrix:
    """Cheapest inserts of user and assistant rows between any two states."""
    out: Matrix = {(q, q): (0, "") for q in range(STATES)}
    one: Matrix = {(q, to): (INSERT, "I") for role in (USER, ASSISTANT)
                   for q, to in STEP[role].items()}
    for _ in range(STATES):
        for key, found in times(out, one).items():
            if better(found, out.get(key)):
                out[key] = found
    return out


INSERTS = _inserts()


def row_edits(symbol: int) -> Matrix:
    """Edits of one row without inserts: keep, rerole or delete."""
    role, fault = divmod(symbol, FAULTS)
    out: Matrix = {(q, q): (DELETE, "D") for q in range(STATES)}
    if fault in (BLANK, DUPLICATE):
        return out
    more = LEFT_TRUNCATED if fault == TRUNCATED else 0
    ways = [(q, to, (more, "K")) for q, to in STEP[role].items()]
    ways += [(q, to, (REROLE + more, "R")) for r in (USER, ASSISTANT) for q, to in STEP[r].items()]
    for q, to, found in ways:
        if better(found, out.get((q, to))):
            out[q, to] = found
    return out


@dataclass
class Element:
    """What a run of rows contributes; runs in order combine to their conversation."""
    matrix: Matrix
    faults: tuple[int, int, int]      # blank, duplicate, truncated
    illegal: int
    first: int                        # role classes at both ends
    last: int


def terminal(symbol: int) -> Element:
    role, fault = divmod(symbol, FAULTS)
    faults = tuple(int(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED))
    return Element(times(INSERTS, row_edits(symbol)), faults, 0, role, role)


def combine(a: Element, b: Element) -> Element:
    return Element(times(a.matrix, b.matrix), tuple(x + y for x, y in zip(a.faults, b.faults)),
                   a.illegal + b.illegal + ((a.last, b.first) not in LEGAL), a.first, b.last)


def combined(elements: Sequence[Element]) -> Element:
    """Neighbours are combined level by level, so ropes stay shallow."""
    level = list(elements)
    while len(level) > 1:
        level = [combine(*level[i:i + 2]) if i + 1 < len(level) else level[i]
                 for i in range(0, len(level), 2)]
    return level[0]


def outcome(matrix: Matrix) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of a whole conversation."""
    best = None
    for (i, q), (cost, rope) in matrix.items():
        for to in ACCEPTING if i == 0 else ():
            step = INSERTS.get((q, to))
            if step is not None:
                found = (cost + step[0], join(rope, step[1]))
                if better(found, best):
                    best = found
    return best[0], flat(best[1])


# ---- Re-Pair ---------------------------------------------------------------
Level = dict[tuple[int, int], int]      # pairs replaced in one round, and their symbol


def replaced(symbols: Sequence[int], levels: Iterable[Level]) -> list[int]:
    """The sequence under the rules, from left to right in every level."""
    out = list(symbols)
    for level in levels:
        shorter, i = [], 0
        while i < len(out):
            rule = level.get((out[i], out[i + 1])) if i + 1 < len(out) else None
            shorter.append(out[i] if rule is None else rule)
            i += 1 if rule is None else 2
        out = shorter
    return out


def pair_counts(symbols: Sequence[int]) -> Counter:
    """Pairs of neighbours; of overlapping equal pairs every second one counts."""
    counts: Counter = Counter()
    held = None
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if pair[0] == pair[1] and held == i - 1 and symbols[i - 1] == pair[0]:
            held = None
            continue
        held = i
        counts[pair] += 1
    return counts


def next_level(pairs: Iterable[tuple[int, int, int]], first_symbol: int) -> Level:
    """Rules from (left, right, count), commonest first.

    A symbol stands only on one side of the pairs of a level, so no two occurrences
    overlap and one pass replaces all of them.
    """
    level: Level = {}
    lefts, rights = set(), set()
    for a, b, _ in pairs:
        if a in rights or b in lefts or a == b and (a in lefts or b in rights):
            continue
        level[a, b] = first_symbol + len(level)
        lefts.add(a)
        rights.add(b)
    return level


class Grammar:
    """Terminals and rules with their elements, evaluated bottom-up once each."""

    def __init__(self, levels: Sequence[Level] = ()):
        self.levels = list(levels)
        self.elements = {s: terminal(s) for s in range(TERMINALS)}
        for level in self.levels:
            for (a, b), symbol in level.items():
                self.elements[symbol] = combine(self.elements[a], self.elements[b])
        self.evaluate = lru_cache(maxsize=20_000)(self._evaluate)

    def _evaluate(self, run: bytes) -> Element:
        """Element of a run of terminals, one byte each."""
        symbols = replaced(np.frombuffer(run, np.uint8).tolist(), self.levels)
        return combined([self.elements[s] for s in symbols])
