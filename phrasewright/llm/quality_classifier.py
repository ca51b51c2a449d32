"""Quality classifier: naive Bayes support vectors (NBSVM).

Features are indicators of n-grams, hashed: words, and one to three shapes of words in a row (case
and kind of the letters, marks at the ends, whether the word repeats the one before). Each is scaled
by its log-count ratio between the classes; a linear hinge-loss model is fitted on the scaled and
normalised rows by dual coordinate descent. Margins are calibrated on rows left out of the fit.

The fit uses a bounded, documented sample (``SAMPLE`` labelled rows of each class, by a hash of their
ids) and runs on the driver; its model is ``2 ** DIM_BITS`` floats. Every text is scored, whole.

Cases: null and empty texts have no features and get the score of the model's constant; labels that
are null or not 0 or 1 are ignored; with one class only or no labels all scores are the base
rate's; repeated rows get a row each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import map_texts
from ._common import documents
from ._training import SAMPLE, base_rate, best_cut, collect_rows, fold, logistic, sample, shifted

DIM_BITS = 18
DIM = 1 << DIM_BITS
#: Words whose features a worker remembers.
_REMEMBER = 200_000
_known: dict[str, tuple[int, int]] = {}
_EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Kind of the letters, and the marks at both ends."""
    before, core, after = _EDGES.match(word).groups()
    kind = "" if not core else "d" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "T" if core[0].isupper() and core[1:].islower() else "m"
    size = "" if not core else "1" if len(core) < 3 else "2" if len(core) < 14 else "3"
    return f"{before[:3]}{kind}{size}{after[-3:]}"


def _ids(word: str) -> tuple[int, int]:
    if len(_known) > _REMEMBER:
        _known.clear()
    bare = word.strip(".,;:!?\"'()").lower()
    _known[word] = got = xxhash.xxh32_intdigest(bare) & (DIM - 1), xxhash.xxh32_intdigest(shape(word))
    return got


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    known = _known
    both = np.array([known[w] if w in known else _ids(w) for w in words], np.uint64)
    s = both[:, 1].copy()
    again = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
    s[1:][again] ^= np.uint64(0x5BD1E995)
    found = [both[:, 0]]
    run = s
    for n in (1, 2, 3):
        if n > 1:
            if len(run) < 2:
                break
            run = run[:-1] * _MULT + s[n - 1 :]
        mixed = np.unique(run + np.uint64(n)) * _MULT
        found.append(mixed >> np.uint64(64 - DIM_BITS))
    return np.unique(np.concatenate(found)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    scale: float
    offset: float
    cut: float
    threshold: float

    def margin(self, f: np.ndarray) -> float:
        if not len(f):
            return self.bias
        x = self.ratio[f]
        return float(self.weights[f] @ x / max(1e-9, np.sqrt(x @ x)) + self.bias)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return shifted(self.scale * margins + self.offset, self.cut, self.threshold)


def count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the ratio of the classes' smoothed shares of each feature's indicators."""
    logs = []
    for label in (1, 0):
        p = np.full(DIM, alpha)
        for i in np.flatnonzero(y == label):
            p[rows[i]] += 1
        logs.append(np.log(p / p.sum()))
    return (logs[0] - logs[1]).astype(np.float32)


def coordinate_descent(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: np.ndarray, epochs: int = 12, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss: w and bias (a constant feature).

    xs: (feature numbers, values); y: -1 or 1; c: the cost of each row, the bound of its dual variable.
    """
    w, bias = np.zeros(DIM, np.float32), 0.0
    alpha = np.zeros(len(xs))
    norms = np.array([float(v @ v) + 1 for _, v in xs])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(xs)):
            f, v = xs[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += np.float32(step) * v
                bias += step
                worst = max(worst, abs(step) * norms[i])
                alpha[i] = new
        if worst < tol:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray, prior: float, threshold: float, c: float = 4.0, keep: float = 0.25) -> Model:
    """keep: how far single weights follow the hinge-loss fit rather than their mean size."""
    flat = Model(np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), float(np.log(threshold / (1 - threshold))), threshold)
    if len(set(y.tolist())) < 2:
        return flat

    def train(at: np.ndarray) -> Model:
        ratio = count_ratio([rows[i] for i in at], y[at])
        xs = []
        for i in at:
            v = ratio[rows[i]]
            xs.append((rows[i], v / max(1e-9, np.sqrt(float(v @ v)))))
        sign = np.where(y[at] == 1, 1.0, -1.0)
        cost = c * np.where(y[at] == 1, len(at) / (2 * max(1, (y[at] == 1).sum())), len(at) / (2 * max(1, (y[at] == 0).sum())))
        w, bias = coordinate_descent(xs, sign, cost)
        used = w != 0
        mean = np.abs(w[used]).mean() if used.any() else 0.0
        return Model((1 - keep) * mean * used + keep * w, ratio, bias, 1.0, 0.0, 0.0, threshold)

    out = np.arange(len(y)) % 4 == 0
    left = train(np.flatnonzero(~out)) if len(set(y[~out].tolist())) == 2 and len(set(y[out].tolist())) == 2 else None
    held = np.flatnonzero(out) if left else np.arange(len(y))
    model = left or train(held)
    m = np.array([model.margin(rows[i]) for i in held])
    yes = y[held] == 1
    weight = np.where(yes, prior / max(1, yes.sum()), (1 - prior) / max(1, (~yes).sum()))
    model.scale, model.offset = map(float, logistic(m[:, None], yes.astype(float), weight))
    model.cut = best_cut(model.scale * m + model.offset, yes.astype(int))
    return model


def fit(docs: DataFrame, labels: DataFrame, train, label: str = "quality", threshold: float = 0.3, bound: int = SAMPLE) -> Model:
    picked = sample(docs, labels, label, train, bound)
    rows = collect_rows(map_texts(picked, ["doc_id", "y"], lambda texts: [pa.array([features(t).astype(np.int32).tobytes() for t in texts], pa.binary())], "f binary"))
    y = np.array([r["y"] for r in rows], int)
    return fit_rows([np.frombuffer(r["f"], np.int32).astype(np.int64) for r in rows], y, base_rate(labels, label, train), threshold)


def score(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` of docs and score (0 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        m = held.value
        return [pa.array(m.score(np.array([m.margin(features(t)) for t in texts])))]

    return map_texts(docs, keys, run, "score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, fold(5) != 0), ["doc_id"])
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
