"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled web texts train a linear model on the non-negative unbiased risk (Kiryo et al., 2017):
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]). No negative label is ever read. The class prior is
estimated first: a model of positives against unlabelled texts orders the texts, and the prior is the least ratio of the
unlabelled to the positive share among the texts above a score, over scores that keep enough positives to tell.

Features of a whole text: hashed byte 3-grams (log counts, unit length) and a few ratios of characters, words and lines.

Learning is bounded: at most about `positives` and `unlabelled` texts, drawn by hash, whose features go to the driver.
Scores are one pass over the texts that shuffles nothing.

Nulls: a null text counts as empty and is scored like any other. Rows with a null id or of the held-out fold are scored,
not learned from; a label that repeats counts once; null labels are unknown. Without positives every score is 0.5.
Repeated rows are scored alike; an id is learned from once, with the least of its texts. Very long texts are read whole.
Other columns are not looked at. An empty table gives an empty result. `fit` is eager: it reads the rows three times.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestow.llm import folds, grams
from lodestow.llm.base import small

BITS = 9
#: Bounds of what is learned from.
POSITIVES, UNLABELLED = 5000, 10000
THRESHOLD = 0.7
STEPS, RATE, PENALTY = 250, 0.02, 1e-2
#: Least share of the positives above a score that the prior may be read at.
ENOUGH = 0.4

_UPPER, _DIGIT, _MARKS = string.ascii_uppercase.encode(), string.digits.encode(), string.punctuation.encode()


def features(text: str | None) -> np.ndarray:
    """A text's features; a long text's zlib ratio is of all of it."""
    data = (text or "").encode()
    found = np.log1p(grams.counts(data, (3,), BITS))
    found /= max(1e-9, np.linalg.norm(found))
    n, words, lines = max(1, len(data)), data.split(), data.split(b"\n")
    common = Counter(words).most_common(1)
    k = max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    ratios = [
        *((len(data) - len(data.translate(None, kind))) / n for kind in (_UPPER, _DIGIT, _MARKS)),
        len(words) / n,
        len(set(words)) / k,
        common[0][1] / k if common else 0.0,
        repeats / k,
        len(set(lines)) / len(lines),
        len(lines) / k,
        len(zlib.compress(data, 1)) / n if data else 0.0,
        np.log1p(len(data)) / 10,
        np.log1p(k) / 10,
    ]
    return np.concatenate([found, np.minimum(ratios, 4.0)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, gradient) -> tuple[np.ndarray, float]:
    """Adam on gradient(margins of p, margins of u) -> their derivatives."""
    w, b = np.zeros(p.shape[1], np.float32), np.float32(0)
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        gp, gu = gradient(p @ w + b, u @ w + b)
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        g = np.append(gp @ p + gu @ u + PENALTY * w, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    return w, b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among u, from scores that order both: the least U(above) / P(above)."""
    ratios = []
    for t in np.unique(np.quantile(p, np.linspace(0, 1, 201))):
        share = (p >= t).mean()
        if share >= ENOUGH:
            ratios.append((u >= t).mean() / share)
    return float(np.clip(min(ratios, default=0.5), 0.05, 0.98))


def train(p: np.ndarray, u: np.ndarray) -> Model:
    """The model of feature rows of positives and of unlabelled texts; half of both orders, the other half gives the prior."""
    n = len(p) + len(u)
    mean = (p.sum(axis=0, dtype=np.float64) + u.sum(axis=0, dtype=np.float64)) / n
    squares = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (p, u)) / n
    mean, scale = mean.astype(np.float32), (np.sqrt(np.maximum(0, squares - mean**2)) + 1e-3).astype(np.float32)
    p, u = (p - mean) / scale, (u - mean) / scale
    apart = lambda zp, zu: (-_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu))
    w, b = _train(p[::2], u[::2], apart)
    prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b) if len(p) > 1 and len(u) > 1 else 0.5

    def risk(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        soft = lambda z: np.logaddexp(0, z)
        negative = soft(zu).mean() - prior * soft(zp).mean()
        as_negative = _sigmoid(zp) * prior / len(zp), _sigmoid(zu) / len(zu)
        if negative < 0:  # the estimate can't be negative: step back on that part alone
            return as_negative[0], -as_negative[1]
        return -prior * _sigmoid(-zp) / len(zp) - as_negative[0], as_negative[1]

    w, b = _train(p, u, risk)
    return Model(mean, scale, w, b, prior)


def _featured(rows: DataFrame, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], [*names, "x"])

    return rows.select(*names, "text").mapInArrow(run, f"{columns}, x binary")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learn from docs (doc_id, text) and the ones of labels (doc_id, quality), in the rows that folds allow."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(folds.learnable(F.col("doc_id")))
    trusted = labels.where((F.col("quality") == 1) & folds.learnable(F.col("doc_id"))).select(F.col("doc_id").cast("long")).distinct()
    share = lambda n, most: F.lit(min(1.0, most / max(n, 1)))
    chosen = small(trusted.where(folds.drawn(F.col("doc_id"), share(trusted.count(), positives), "trusted")))
    p = docs.join(chosen, "doc_id", "left_semi").withColumn("kind", F.lit(1))
    ids = docs.agg(F.approx_count_distinct("doc_id", 0.01)).first()[0]
    u = docs.where(folds.drawn(F.col("doc_id"), share(ids, unlabelled), "unlabelled")).withColumn("kind", F.lit(0))
    rows = sorted(_featured(folds.one_text(p.union(u), "kind", "doc_id"), "kind int, doc_id long").collect(), key=lambda r: (r["kind"], r["doc_id"]))
    x = {k: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["kind"] == k]) for k in (0, 1)}
    return train(x[1], x[0]) if len(x[1]) and len(x[0]) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = model.score(np.stack([features(t.as_py()) for t in batch.column("text")])) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
