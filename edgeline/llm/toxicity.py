"""Toxicity with a weighted finite-state pattern grammar.

A text is cut into clauses. Every word is first rewritten by a lexical transducer
to a class symbol (insult, threat, target, negation, report) with a weight; the symbol
string then runs through a sentence automaton that is the composition of five small
transducers, one for each symbol. The state at the end of the clause decides, so the
order of the words does not: a threat matches only with a target, a target raises a
match, a negation or a reporting verb on either side lowers it. Words inside quotation
marks count as reported. An insult matches without a target too, by its word alone.

The insult and threat symbols carry weights learned from labelled rows: words, and
word beginnings for inflected forms, whose share of toxic rows is high. Learning
uses a bounded sample of labelled rows; texts never reach the driver, only the
strongest terms do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.llm.tables import fold, let

# Closed-class words of the grammar, in four languages.
TARGETS = ("you your yours yourself u he she they him her them his their these those people all "
           "du dich dir ihr euch sie er tu toi te vous ton votre il elle ils "
           "tú usted ustedes vosotros ellos ellas él ella").split()
NEGATIONS = ("not no never neither nor isn't aren't wasn't don't doesn't didn't without "
             "nicht kein keine nie ne pas jamais sans nunca ni tampoco").split()
REPORTS = ("said says saying called calls quote quoted quoting reported reports wrote claims "
           "sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó").split()
INSULTS = ("idiot moron stupid loser scum trash pathetic worthless disgusting clown "
           "dumb fool dummkopf trottel imbécile crétin estúpido imbécil").split()
THREATS = "kill hurt destroy beat shoot stab töten umbringen tuer frapper matar golpear".split()

INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
#: Weight of a seed word that labelled rows have not confirmed.
SEED_WEIGHT = 0.5
#: Labelled rows to learn from, taken in hash order.
SAMPLE_ROWS = 20_000
#: Learned terms kept, strongest first; word beginnings have these lengths.
TERMS = 20_000
STEMS = (4, 5, 6)
#: About the number of distinct terms that a sample holds.
CHANCE = 200_000
_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"«»„“”]")
_QUOTES = frozenset("\"«»„“”")


def compose() -> tuple[np.ndarray, np.ndarray]:
    """Next state and factor exponent of the composed sentence automaton.

    A state is (negated, reported, targeted, insulted, threatened), one bit each; the
    components keep their own bit, so the composition is their product. The factor
    table holds what insults and threats weigh in a clause that ends in a state.
    """
    bits = {NEGATION: 1, REPORT: 2, TARGET: 4, INSULT: 8, THREAT: 16}
    step = np.zeros((32, 6), dtype=np.int64)
    factor = np.zeros((32, 2))
    for state in range(32):
        step[state, 0] = state
        for symbol, bit in bits.items():
            step[state, symbol] = state | bit
        weight = ((0.5 if state & 1 else 1.0) * (0.6 if state & 2 else 1.0)
                  * (1.25 if state & 4 else 1.0))
        factor[state, 0] = weight if state & 8 else 0.0
        factor[state, 1] = weight if state & 16 and state & 4 else 0.0
    return step, factor


@dataclass
class Grammar:
    terms: dict[str, float]
    stems: dict[str, float]
    scale: tuple[float, float] = (-3.0, 3.0)
    words: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for symbol, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.words |= dict.fromkeys(group, symbol)
        self.step, self.factor = (t.tolist() for t in compose())
        self.threats = frozenset(THREATS)

    def weight(self, word: str) -> float:
        own = self.terms.get(word)
        if own is None:
            own = max(self.stems.get(word[:k], 0.0) for k in STEMS)
        return own

    def clause(self, tokens: list[str]) -> tuple[float, bool]:
        """Weight of the matches in one clause, and whether anything lowers them."""
        state, quoted, marked = 0, False, False
        open_, told = [0.0, 0.0], [0.0, 0.0]     # insults and threats, the latter in quotes
        for word in tokens:
            if word in _QUOTES:
                quoted = not quoted
                continue
            symbol = self.words.get(word, 0)
            w = 0.0 if symbol else self.weight(word)
            if w:
                symbol = THREAT if word in self.threats else INSULT
                (told if quoted else open_)[symbol - INSULT] += w
                marked = marked or quoted
            state = self.step[state][symbol]
        plain, reported = self.factor[state], self.factor[self.step[state][REPORT]]
        total = sum(p * o + r * t for p, r, o, t in zip(plain, reported, open_, told))
        return total, marked or bool(state & 3)

    def evidence(self, text: str | None) -> float:
        """Clause weights of a whole text: the sum, with lowered clauses only the largest."""
        if not text:
            return 0.0
        lower = text.lower()
        total, lowered = 0.0, 0.0
        terms, stems = self.terms, self.stems
        for part in _CLAUSE.split(lower):
            tokens = _TOKEN.findall(part)
            if any(t in terms or t[:4] in stems or t[:5] in stems or t[:6] in stems
                   for t in tokens):
                weight, less = self.clause(tokens)
                if less:
                    lowered = max(lowered, weight)
                else:
                    total += weight
        return total + lowered

    def score(self, evidence: float) -> float:
        a, b = self.scale
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * evidence))))


def _terms(text: Column) -> Column:
    """Distinct words of a text, and marked beginnings of its longer words."""
    # As in _TOKEN: an apostrophe between letters belongs to the word.
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))
    words = F.filter(F.array_distinct(found), lambda w: F.length(w) > 1)
    stems = lambda ws, k: F.transform(F.filter(ws, lambda w: F.length(w) > k),
                                      lambda w: F.concat(F.lit("^"), F.substring(w, 1, k)))
    return let(words, lambda ws: F.array_distinct(
        F.concat(ws, *[stems(ws, k) for k in STEMS])))


def learn(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> Grammar:
    """Grammar whose term weights and scale come from labelled rows.

    At most ``sample_rows`` labelled rows are used, in hash order; their ids are
    the only broadcast. A term counts when at least 90 % of the rows that hold it are
    toxic, and when as many toxic rows would hold it by chance with a probability
    below 1/``CHANCE``, which keeps rare words out. Without labelled rows the
    seed words carry a small weight each and no text reaches the toxic threshold.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .select("doc_id", (F.col(label) == 1).cast("int").alias("y"))
             .filter(fold(F.col("doc_id"), 3) != 1)
             .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows))
    rate = known.agg(F.avg("y")).first()[0] or 0.0
    least = max(3, math.ceil(math.log(CHANCE) / -math.log(min(max(rate, 1e-3), 0.5))))
    rows = (docs.filter(train).select("doc_id", "text")
            .join(F.broadcast(known), "doc_id"))
    counts = (rows.select("y", F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
              .groupBy("term").agg(F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n"))
              .filter(f"hit >= {least} and hit >= 0.9 * n")
              .orderBy(F.desc("hit"), "term").limit(terms).collect())
    words = dict.fromkeys(INSULTS + THREATS, SEED_WEIGHT)
    words |= {r.term: 1.0 for r in counts if not r.term.startswith("^")}
    stems = {r.term[1:]: 1.0 for r in counts if r.term.startswith("^")}
    grammar = Grammar(words, stems)
    pairs = (_evidence(rows, grammar).groupBy("y", F.floor(F.col("e") * 4).alias("b"))
             .agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("e")).collect())
    return Grammar(words, stems, _fit_scale(pairs)) if counts else Grammar(words, stems, (-3.0, 0.5))


def _evidence(rows: DataFrame, grammar: Grammar) -> DataFrame:
    udf = F.pandas_udf(lambda s: s.map(grammar.evidence).astype(float), "double")
    return rows.select("y", udf(F.coalesce("text", F.lit(""))).alias("e"))


def _fit_scale(pairs: list) -> tuple[float, float]:
    """Logistic curve through binned evidence, by damped Newton steps."""
    x = np.array([min(r.e, 5.0) for r in pairs])
    y = np.array([r.y for r in pairs], dtype=float)
    n = np.array([r.n for r in pairs], dtype=float)
    beta = np.array([-2.0, 1.0])
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.05 * beta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1); map-only, whole texts; NULL counts as empty."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([grammar.score(grammar.evidence(t)) for t in texts], dtype=float)

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))


def held_out(docs: DataFrame) -> Column:
    return fold(docs["doc_id"], 3) == 1
