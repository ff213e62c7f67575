"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's strength is linear in features of its whole text. A pair (a, b),
a preferred to b, has the likelihood 1 / (1 + exp(-w (x_a - x_b))); w
minimises that logistic loss on feature differences with a small ridge, by
Newton steps. Preferences come from labelled documents: each document of label
0 loses against ``RIVALS`` documents of label 1. The strength at the quantile
that the share of label 0 marks is the threshold; the score maps it to ``CUT``.

The model is fitted on at most ``SAMPLE`` labelled rows (the smallest id
hashes), which bounds what the driver receives; scoring reads every row.

Defined results: null and empty texts have all-zero features and a score like
any other; with labels of one class only (or none) every document scores 0.5;
labels that repeat for an id count each time; rows that repeat get equal
scores; input columns of the same name as an output column are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, give_back_memory, text_or_empty

SAMPLE = 16_000  # labelled rows that the model is fitted on, at most
RIVALS = 8  # preferred documents drawn for each document of label 0
RIDGE = 1e-3
CUT = 0.3  # score of the threshold
STEEP = 6.0  # logits between the threshold and the typical document of either class

_SYMBOLS = "!|%$#&*<>{}[]=_@~^\\/+-()\"':;,.?"
_GROUPS = [range(0, 32), range(48, 58), range(65, 91), range(97, 123), range(128, 256)]
N_FEATURES = 2 * (len(_SYMBOLS) + len(_GROUPS) + 4) + 3


def features(text: str) -> np.ndarray:
    """Shares of symbols, character groups, repeated and different words, and their square roots; lengths."""
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    words = text.split()
    n, total = len(words), max(1, int(raw.sum()))
    if not n:
        return np.zeros(N_FEATURES)
    kinds = set(words)
    shares = [raw[ord(c)] / total for c in _SYMBOLS] + [raw[g.start:g.stop].sum() / total for g in _GROUPS]
    repeats = sum(map(eq, words, words[1:])) / n
    short = sum(len(w) <= 3 for w in kinds) / len(kinds)
    marks = (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / n
    shares += [repeats, 1 - len(kinds) / n, short, min(marks, 4.0) / 4]
    x = np.array(shares)
    return np.concatenate([x, np.sqrt(x), [np.log1p(n) / 10, np.log1p(total / n), repeats > 0.2]])


class Model:
    """w, threshold and slope; strengths are w (x - mean) / spread."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, at: float, slope: float):
        self.mean, self.spread, self.w, self.at, self.slope = mean, spread, w, at, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), 0.5)
        z = self.slope * (self.strength(x) - self.at) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 25) -> Model:
    """Fit w on preference pairs between rows of label 1 and 0; set the threshold by quantile."""
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(mean, spread, np.zeros(x.shape[1]), 0.0, 0.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / spread, -8, 8)
    d = z[rng.choice(good, len(bad) * RIVALS)] - z[np.repeat(bad, RIVALS)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = -(d * lose[:, None]).mean(0) + RIDGE * w
        curve = (d * (lose * (1 - lose))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    at = float(np.quantile(s, len(bad) / len(s), method="midpoint"))
    apart = float(np.median(s[good]) - np.median(s[bad]))
    return Model(mean, spread, w, at, 2 * STEEP / apart if apart > 0 else 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows whose id hash does not mark them as held out."""
    rows = labels.select(labels[key].alias("_id"), labels[label].cast("int").alias("_y")).filter(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    rows = rows.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    x = docs.select(docs[key].alias("_id"), text_or_empty(docs[text]).alias("_text")).join(F.broadcast(rows), "_id")

    @F.pandas_udf("array<double>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield pd.Series([features(t) for t in batch])
        finally:
            give_back_memory()

    # A repeated id is learned once for each label: the driver gets ``sample`` rows at most.
    x = x.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    found = x.select("_y", "_id", extract("_text").alias("_x")).orderBy("_id", "_y").collect()
    return fit_pairs(np.array([r["_x"] for r in found]).reshape(-1, N_FEATURES), np.array([r["_y"] for r in found]))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``CUT`` on)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                x = np.array([features(t) for t in batch]).reshape(-1, N_FEATURES)
                yield pd.Series(model.score(x))
        finally:
            give_back_memory()

    names, rest = carried(docs, None, ["score", "predicted"])
    scored = docs.select(*rest, score(text_or_empty(docs[text])).alias("_score"))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))
