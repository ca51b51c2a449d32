"""What the two classifiers share: a bounded sample of labelled texts, and calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, written

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 12_000


def fold(n: int) -> Column:
    """crc32 of the id's digits, modulo n (null ids: of the empty string)."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int = SAMPLE) -> DataFrame:
    """doc_id, y and text of at most ``bound`` labelled documents of each class that ``train`` holds for, one
    row an id (of an id that several texts have, the smallest text).

    Which ones is decided by a hash of the id. The chosen ids are at most 2 * bound, so they can be
    broadcast; of the texts only theirs move.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
    ids = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    of = lambda y: ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    picked = cut(of(0).unionByName(of(1)).withColumnRenamed("doc_id", "i"))
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("i"))
    return written(met.groupBy("doc_id", "y").agg(F.min("text").alias("text")))


def base_rate(labels: DataFrame, label: str, train: Column) -> float:
    r = labels.where(F.col(label).isin(0, 1) & train).agg(F.avg(F.col(label).cast("double")).alias("p")).first()
    return 0.5 if r["p"] is None else float(r["p"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; a constant column comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    scale = weight / max(weight.sum(), 1e-12)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (scale * (p - y)) + ridge * 1e-2 * w
        h = (x * (scale * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of z with the best balanced accuracy, midway between the two values it separates."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    below1, below0 = np.cumsum(y == 1) / (y == 1).sum(), np.cumsum(y == 0) / (y == 0).sum()
    good = np.where(np.r_[z[1:] > z[:-1], True], below0 - below1, -2)
    k = int(np.argmax(good))
    if k == len(z) - 1:
        return float(z[k])
    return float((z[k] + z[k + 1]) / 2)


def shifted(z: np.ndarray, cut_at: float, threshold: float) -> np.ndarray:
    """Probabilities whose value at the cut is the threshold."""
    return sigmoid(z - cut_at + math.log(threshold / (1 - threshold)))


def collect_rows(df: DataFrame) -> list:
    """A bounded sample's rows, in an order that a rerun gives again."""
    return sorted(df.collect(), key=lambda r: r["doc_id"])

