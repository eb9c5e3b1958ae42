"""Language identification by nearest centroids.

A text is the TF-IDF vector of the hashed n-grams of its letters, of unit length. The texts of a language are clustered
(spherical k-means), and a text gets the language of the centroid with the highest cosine. It is rejected if it is
farther from that centroid than nearly all texts of about its length are from theirs, or if it has no letter.

Learning: document frequencies count every row that may be learned from; clusters come from a drawn sample of at most
about `sample` texts of each language. Each language is clustered in a task of its own, so what a task holds is bounded.
The model (languages x CLUSTERS x BUCKETS floats) goes to the tasks with the function; texts are never shuffled but for
the sample.

Nulls: a null text, and one without a letter, is `und` with score 0 and rejected. Rows with a null lang or id are
predicted, not learned from. With nothing to learn from, every text is `und`. Repeated rows count each in document
frequencies; an id of a language is sampled once, with the least of its texts, however often it stands there. Very long
texts are read whole. `predict` replaces columns of its own names, `recognised` leaves every column as it was. An empty
table gives an empty result. `fit` is eager: it reads the rows twice, once for frequencies and once for the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestow.llm import folds, grams
from lodestow.llm.base import small

BITS, WIDTHS = 12, (2, 3)
CLUSTERS, ROUNDS = 4, 12
#: Texts of each language that are clustered.
SAMPLE = 1200
#: A text is rejected below this share of the cosine that all but QUANTILE of the sampled texts of its length reach.
SLACK, QUANTILE = 0.5, 0.002
#: Lengths count by powers of two of their n-grams.
SIZES = 24
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def term_counts(text: str | None) -> np.ndarray | None:
    """n-gram counts of the lower-cased words; None if there is no letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    return grams.counts(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode(), WIDTHS, BITS)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / np.linalg.norm(v)).astype(np.float32)


def _size(counts: np.ndarray) -> int:
    return min(SIZES - 1, int(counts.sum()).bit_length())


def cluster(vectors: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of spherical k-means; k-means++ starts."""
    rng, k = np.random.default_rng(seed), min(k, len(vectors))
    chosen = [int(rng.integers(len(vectors)))]
    for _ in range(1, k):
        far = np.maximum(0, 1 - (vectors @ vectors[chosen].T).max(axis=1)) ** 2
        chosen.append(int(rng.choice(len(vectors), p=far / far.sum())) if far.sum() > 0 else chosen[0])
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(k)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres.astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centres: np.ndarray
    floor: np.ndarray  # least cosine of a kept text, by size


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the rows of docs (doc_id, text, lang) that folds allow and that have a lang."""
    known = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where(folds.learnable(F.col("doc_id")) & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                if (found := term_counts(text.as_py())) is not None:
                    total += found > 0
                    rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int32()), pa.array([*total, rows], pa.int64())], ["bucket", "n"])

    summed = dict(known.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect())
    df = np.array([summed.get(i, 0) for i in range(1 << BITS)], np.float64)
    idf = np.log((1 + summed.get(1 << BITS, 0)) / (1 + df)) + 1

    def centroids(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [c for t in rows.sort_values("doc_id")["text"] if (c := term_counts(t)) is not None]
        if not found:
            return pd.DataFrame({"lang": [], "centre": [], "size": [], "cosine": []})
        vectors = np.stack([_vector(c, idf) for c in found])
        centres = cluster(vectors, CLUSTERS)
        near = (vectors @ centres.T).max(axis=1)
        return pd.DataFrame({"lang": keys[0], "centre": [[*c.tolist()] for c in centres] + [None] * len(near), "size": [None] * len(centres) + [_size(c) for c in found], "cosine": [None] * len(centres) + near.tolist()})

    shares = small(known.groupBy("lang").agg((sample / F.approx_count_distinct("doc_id", 0.01)).alias("share")))
    drawn = folds.one_text(known.join(shares, "lang").where(folds.drawn(F.col("doc_id"), F.col("share"), "langid")), "lang", "doc_id")
    rows = drawn.groupBy("lang").applyInPandas(centroids, "lang string, centre array<float>, size int, cosine double").collect()
    model = sorted((r for r in rows if r["centre"]), key=lambda r: (r["lang"], r["centre"]))
    floor = np.zeros(SIZES)
    for s in range(SIZES):
        near = [r["cosine"] for r in rows if r["size"] == s]
        # longer texts than any sampled are held to the longest sampled ones' cosine
        floor[s] = SLACK * np.quantile(near, QUANTILE) if len(near) >= 20 else floor[s - 1] if s else 0
    return Model(idf, [r["lang"] for r in model], np.array([r["centre"] for r in model], np.float32).reshape(-1, 1 << BITS), floor)


#: Of the columns that predict adds.
NAMES = ("lang_pred", "score", "rejected")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, all columns as they were."""
    own = [f"_lodestow_{c}" for c in NAMES]
    return predict(docs, model, own).where(~F.col(own[2])).select(*docs.columns)


def predict(docs: DataFrame, model: Model, as_names: list[str] | tuple[str, ...] = NAMES) -> DataFrame:
    """docs with lang_pred, score (the cosine) and rejected, under as_names; its columns stay unless they have these names."""
    names = [c for c in docs.columns if c.lower() not in as_names]
    docs = docs.select(*names)
    schema = docs.select("*", *[F.lit(x).alias(c) for c, x in zip(as_names, ("", 0.0, True))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, out = [], [], []
            for text in batch.column(names.index("text")):
                found = term_counts(text.as_py()) if model.langs else None
                if found is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    out.append(True)
                    continue
                near = model.centres @ _vector(found, model.idf)
                best = int(near.argmax())
                langs.append(model.langs[best])
                scores.append(float(np.clip(near[best], 0, 1)))
                out.append(bool(near[best] < model.floor[_size(found)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*names, *as_names])

    return docs.mapInArrow(run, schema)
