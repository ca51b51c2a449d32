"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: INSULT and THREAT (with a weight), TARGET, NEGATION, REPORT, STRONG (a word that
strengthens), END of a clause, LINE, QUOTE, COLON and OTHER. Five small transducers relabel the symbols and
are composed into one table once:

* negation marks what follows within three words,
* reported speech marks the rest of its clause, or what stands in the quote that it opens,
* insult marks an insult that a strong word leads to, and those that only go on with one,
* target marks an insult as aimed if a person is addressed or named within four words before it or
  after it, and as alone if not: a word by itself is no clause and counts a fraction,
* threat turns a threat word into a threat only when a target follows within four words.

A run through the table scores a clause: the weights of its matches, each times the weights of its
marks. A document's evidence is its strongest clause, the sum over clauses, their number and the
length of the text, which a logistic model turns into a probability: a stem that now and then stands in
clean texts counts where it is dense.

Insult weights beyond the seed list come from the labels: words, and beginnings of words (so that
inflected forms of a stem count alike), whose log odds for toxic documents stay high after two
standard errors are taken off. Words of the other classes are never insults, whatever stem they
begin with. The fit uses a bounded, documented sample (``SAMPLE`` labelled rows of each class, by a hash of
their ids); nothing else is bounded: all that the sample shows to be high is taken.

Cases: null and empty texts have no matches and get the score of no evidence; very long texts are read
whole; labels that are null or not 0 or 1 are ignored; without labels of both classes the seed list
decides alone; repeated rows get a row each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import map_texts, slices
from ._common import documents
from ._training import SAMPLE, base_rate, best_cut, collect_rows, fold, logistic, sample, shifted

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STRONG, END, LINE, QUOTE, COLON = SYMBOLS = range(11)

#: Seed words of the classes, English, German, French and Spanish.
INSULTS = "idiot idiots idiotic moron morons moronic stupid imbecile loser losers scum trash pathetic worthless disgusting clown fool fools filthy vermin scumbag coward retard bastard bitch asshole dumbass jerk dummkopf abschaum arschloch trottel connard imbécile ordure salaud idiota imbécil escoria basura estúpido".split()
THREATS = "kill destroy hurt murder beat strangle shoot stab crush burn töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours yourself u he she they them him her his their this these those people everyone du dich dir euch ihr sie er vous toi tu te ton votre ils elles usted ustedes tú ti él ellos ella".split()
NEGATIONS = "not no never isn't aren't don't doesn't won't cannot can't without neither nor nicht kein keine nie niemals ne pas jamais aucun nunca jamás sin ni".split()
REPORTS = "said says say saying called calls quoted quote quotes wrote writes reported reports claimed claims allegedly sagte sagt behauptete dit disait selon déclaré dijo dice según".split()
STRONGS = "such total complete utter absolute fucking bloody damn damned so very real pure verdammter verdammte völliger sale sacré espèce maldito maldita".split()

#: What a mark does to the weight of a match. A target's mark says that it aims the insult before it.
MARKS = {"negated": 0.3, "reported": 0.6, "strong": 1.3, "further": 0.2, "aimed": 1.3, "alone": 0.35}
AIMS = "aims"

Symbol = tuple[int, frozenset]
Step = Callable[[int, Symbol], tuple[int, Symbol]]


def _marked(symbol: Symbol, mark: str) -> Symbol:
    return symbol[0], symbol[1] | {mark}


def negation(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """state: words for which the negation still holds."""
    if symbol[0] == NEGATION:
        return 3, symbol
    if symbol[0] in (END, LINE):
        return 0, symbol
    if symbol[0] in (QUOTE, COLON):
        return state, symbol
    if state and symbol[0] in (INSULT, THREAT):
        return state - 1, _marked(symbol, "negated")
    return max(0, state - 1), symbol


def reported(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """state: 1 in a clause that reports, 2 within its quote, which may hold several clauses."""
    if symbol[0] == REPORT:
        return max(1, state), symbol
    if symbol[0] == QUOTE:
        return (2 if state == 1 else 0), symbol
    if symbol[0] == LINE or symbol[0] == END and state == 1:
        return 0, symbol
    return state, _marked(symbol, "reported") if state and symbol[0] in (INSULT, THREAT) else symbol


def insult(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """state: 1 right behind an insult, 3 and 2 within two words behind a strong word."""
    if symbol[0] == INSULT:
        return 1, _marked(symbol, "further") if state == 1 else _marked(symbol, "strong") if state else symbol
    if symbol[0] == STRONG:
        return 3, symbol
    if symbol[0] in (QUOTE, COLON):
        return state, symbol
    return (2 if state == 3 and symbol[0] not in (END, LINE) else 0), symbol


def target(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """state: 1 to 4, words for which a target still aims; -1 to -4, words in which one may still aim
    the insult before."""
    if symbol[0] == TARGET:
        return 4, _marked(symbol, AIMS) if state < 0 else symbol
    if symbol[0] in (END, LINE):
        return 0, symbol
    if symbol[0] in (QUOTE, COLON):
        return state, symbol
    if symbol[0] == INSULT:
        return (state - 1, _marked(symbol, "aimed")) if state > 0 else (-4, _marked(symbol, "alone"))
    return state - (state > 0) + (state < 0), symbol


#: States of the threat transducer: 0, or words left and whether the threat was negated or reported.
_HELD = [frozenset(), frozenset({"negated"}), frozenset({"reported"}), frozenset({"negated", "reported"})]


def threat(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """A threat word waits; a target within four words makes it a match."""
    left, held = divmod(state, 4)
    if symbol[0] == THREAT:
        return 4 * 4 + _HELD.index(symbol[1]), (OTHER, frozenset())
    if symbol[0] == TARGET and left:
        return 0, (THREAT, _HELD[held] | symbol[1])
    if symbol[0] in (QUOTE, COLON):
        return state, symbol
    if symbol[0] in (END, LINE) or not left:
        return 0, symbol
    return 4 * (left - 1) + held if left > 1 else 0, symbol


def compose(*steps: Step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of transducers over the plain symbols, each reading what the one before writes.

    Returns next[state, symbol], weight[state, symbol]: the weight of the match that the last writes, 0
    for none, and aims[state, symbol]: whether it aims the insult before. State 0 is the start.
    """
    start = (0,) * len(steps)
    states, rows, at = {start: 0}, [], 0
    order = [start]
    while at < len(order):
        row = []
        for plain in SYMBOLS:
            symbol: Symbol = (plain, frozenset())
            after = []
            for s, step in zip(order[at], steps):
                s, symbol = step(s, symbol)
                after.append(s)
            key = tuple(after)
            if key not in states:
                states[key] = len(order)
                order.append(key)
            row.append((states[key], weight_of(symbol), AIMS in symbol[1]))
        rows.append(row)
        at += 1
    return tuple(np.array([[x[k] for x in r] for r in rows]) for k in range(3))


def weight_of(symbol: Symbol) -> float:
    """The weight of a match with its marks; 0 for what is none."""
    return math.prod(MARKS[m] for m in symbol[1] if m != AIMS) if symbol[0] in (INSULT, THREAT) else 0.0


STEPS = (negation, reported, insult, target, threat)
NEXT, WEIGHT, LATE = (t.tolist() for t in compose(*STEPS))

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"“”„«»()]")
_ENDS = {"\n": LINE, ":": COLON, **dict.fromkeys('"“”„«»', QUOTE)}
PREFIXES = (4, 5, 6, 7)
#: Entries that a task counts before it hands them on.
_HELD_ENTRIES = 500_000


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


@dataclass
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    coef: tuple[float, ...] = (1.0, 1.0, 0.0, 0.0, -2.0)
    cut: float = 0.0
    threshold: float = 0.7
    _seen: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """Class and weight of a token."""
        if not word[0].isalpha():
            return _ENDS.get(word, END), 0.0
        if word in _CLASSES:
            return _CLASSES[word], 1.0
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n)])
        return (INSULT, weight) if weight else (OTHER, 1.0)

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that have any."""
        return self._run(tokens(text))

    def _run(self, found: list[str]) -> list[float]:
        seen, out = self._seen, []
        if len(seen) > 300_000:
            seen.clear()
        marked = []
        for t in found:
            s = seen.get(t)
            if s is None:
                s = seen[t] = self.symbol(t)
            marked.append(s)
        # clauses without an insult or a threat can't score: nothing to run
        if not any(s[0] in (INSULT, THREAT) for s in marked):
            return out
        state, total, waiting, alone = 0, 0.0, 0.0, 0.0
        for kind, weight in marked:
            w, late = WEIGHT[state][kind], LATE[state][kind]
            state = NEXT[state][kind]
            if kind == THREAT:
                waiting = weight
            if w:
                if kind == INSULT:
                    alone = w * weight
                total += alone if kind == INSULT else w * waiting
            if late:  # the insult before counts as aimed after all
                total += alone * (MARKS["aimed"] / MARKS["alone"] - 1)
            if kind == END or kind == LINE:
                if total:
                    out.append(total)
                total = 0.0
        if total:
            out.append(total)
        return out

    def evidence(self, text: str | None) -> tuple[float, float, float, float]:
        found = tokens(text)
        c = self._run(found)
        return max(c, default=0.0), math.log1p(sum(c)), math.log1p(len(c)), math.log(30 + len(found))

    def logit(self, evidence: np.ndarray) -> np.ndarray:
        return evidence @ np.array(self.coef[:-1]) + self.coef[-1]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return shifted(self.logit(evidence), self.cut, self.threshold)


_CLASSES = {w: k for k, words in ((STRONG, STRONGS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}


def _entries(text: str | None) -> set[str]:
    """Words and their beginnings (with a ``*``) of a text."""
    words = {t for t in set(tokens(text)) if t[0].isalpha() and len(t) > 2 and t not in _CLASSES}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n}


def _counted(picked: DataFrame) -> DataFrame:
    """How many toxic and clean documents hold each entry: (entry, t, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([
            pa.array([e for n in found for e in n], pa.string()), pa.array([y for y, n in enumerate(found) for _ in n], pa.int32()), pa.array([x for n in found for x in n.values()], pa.int64())
        ], ["entry", "y", "n"])
        for batch in batches:
            for part in slices(batch):
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found[y].update(_entries(t))
                if len(found[0]) + len(found[1]) > _HELD_ENTRIES:
                    yield rows()
                    found = Counter(), Counter()
        if found[0] or found[1]:
            yield rows()

    counts = picked.select("y", F.col("text").alias("_text")).mapInArrow(run, "entry string, y int, n long")
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    return counts.groupBy("entry").agg(of(1).alias("t"), of(0).alias("c"))


def lexicon(picked: DataFrame, least: int = 3, floor: float = 1.5) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with the lower bound of their log odds, from a bounded sample (doc_id, y, text).

    Counts stay distributed; what comes to the driver are the entries above the floor.
    """
    sizes = dict(picked.groupBy("y").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        return {}, {}
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (sizes[1] + 1 - t)) - F.log(c / (sizes[0] + 1 - c))
    low = odds - 2 * F.sqrt(1 / t + 1 / c)
    found = _counted(picked).where(F.col("t") >= least).select("entry", low.alias("low")).where(F.col("low") > floor)
    bound = dict(sorted(map(tuple, found.collect())))
    words = {e: x for e, x in bound.items() if not e.endswith("*")}
    return words, {e[:-1]: x for e, x in bound.items() if e.endswith("*")}


def fit(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", threshold: float = 0.7, bound: int = SAMPLE) -> Grammar:
    picked = sample(docs, labels, label, train, bound)
    words, stems = lexicon(picked)
    grammar = Grammar({w: 3.0 for w in INSULTS} | words, stems, threshold=threshold)
    rows = collect_rows(_with_evidence(picked, grammar, ["doc_id", "y"]))
    y = np.array([r["y"] for r in rows], int)
    if len(set(y.tolist())) == 2:
        x = np.array([r["evidence"] for r in rows])
        prior = base_rate(labels, label, train)
        weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
        grammar.coef = tuple(map(float, logistic(x, y.astype(float), weight)))
        grammar.cut = best_cut(grammar.logit(x), y)
    return grammar


def _with_evidence(docs: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([held.value.evidence(t) for t in texts], pa.list_(pa.float64()))]

    return map_texts(docs, keys, run, "evidence array<double>")


def score(docs: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    """``keys`` of docs and score (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(texts: list[str | None]) -> list[pa.Array]:
        g = held.value
        return [pa.array(g.score(np.array([g.evidence(t) for t in texts]).reshape(-1, 4)))]

    return map_texts(docs, keys, run, "score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, fold(3) != 1), ["doc_id"])
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
