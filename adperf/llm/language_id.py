"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed character n-grams (one to three letters,
lower case, everything between words as one blank), with unit length. Per language
a spherical k-means over a sample of labelled texts gives ``clusters`` centroids;
a text takes the language of the centroid with the largest cosine. It is rejected
when that cosine is below ``floor`` of the lowest that the centroid's own sample
texts have, or when the text has no letter.

The fit reads about ``per_language`` labelled texts of each language, chosen by a
digest of the id (a documented bound: language codes are few, so the sample, the
document frequencies and the centroids are small however large the corpus is).
The prediction is one pass over whole texts without a shuffle.

Defined results: NULL and letterless texts get ``und``, score 0 and are rejected;
so does every text when there is nothing to learn from; ties go to the first
language in alphabetical order; repeated rows give one row each; rows of an empty
table: none; ``language_of`` reads the text only, ``keep_languages`` keeps all
columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common

DIMENSIONS = 1 << 13
UNKNOWN = "und"
_SHIFT = np.uint64(64 - 13)
_BLANK = np.uint64(0x20)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # dimensions x centroids
    idf: np.ndarray
    floors: np.ndarray


_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Dimensions that the text touches and how often, or None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = points < 0x10000
    letter = _ALPHA[np.where(low, points, 0)]
    if not low.all():
        high = np.flatnonzero(~low)
        letter[high] = [chr(c).isalpha() for c in points[high]]
    if not letter.any():
        return None
    signs = np.where(letter, points, 0x20).astype(np.uint64)
    signs = np.concatenate([[_BLANK], signs, [_BLANK]])
    blank = signs == _BLANK
    signs = signs[~(blank & np.concatenate([[False], blank[:-1]]))]
    one = (signs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (signs[1:] << np.uint64(21))) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ (signs[2:] << np.uint64(7))) * np.uint64(0x165667B19E3779F9)
    touched = np.concatenate([one[signs != _BLANK], two, three]) >> _SHIFT
    counts = np.bincount(touched.astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = found
    weight = (np.log1p(counts) * idf[at]).astype(np.float32)
    return at, weight / np.linalg.norm(weight)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, texts = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = grams(text)
            if found:
                seen[found[0]] += 1
                texts += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*at, -1], pa.int32()), pa.array([*seen[at], texts], pa.int64())], ["dimension", "texts"]
    )


def spherical_means(vectors: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length and the nearest of each vector; starts from the mean's farthest vectors."""
    centre = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ centre))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([
            vectors[owner == k].sum(axis=0) if (owner == k).any() else centroids[k] for k in range(len(centroids))
        ])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


def _fit_language(idf: np.ndarray, clusters: int):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        found = [g for g in map(grams, sample["text"].sort_values()) if g]
        if not found:
            return pd.DataFrame({"lang": [], "centroid": [], "lowest": []})
        vectors = np.zeros((len(found), DIMENSIONS), np.float32)
        for row, gram in zip(vectors, found):
            at, weight = weighted(gram, idf)
            row[at] = weight
        centroids, owner = spherical_means(vectors, clusters)
        near = (vectors * centroids[owner]).sum(axis=1)
        used = [k for k in range(len(centroids)) if (owner == k).any()]
        return pd.DataFrame({
            "lang": sample["lang"].iloc[0],
            "centroid": [centroids[k].astype("<f4").tobytes() for k in used],
            "lowest": [float(near[owner == k].min()) for k in used],
        })

    return fit


def fit(docs: DataFrame, trained: Column, per_language: int = 1000, clusters: int = 4, floor: float = 0.5) -> Model | None:
    """Learn from the labelled rows for which ``trained`` holds; None when there are none."""
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & trained)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    shares = F.create_map(*[
        F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))
    ])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    sample = materialize(labelled.where(place < F.try_element_at(shares, F.col("lang"))).select("lang", "text"))
    seen = (
        sample.select("text").mapInArrow(_document_frequency, "dimension int, texts long")
        .groupBy("dimension").agg(F.sum("texts").alias("texts")).collect()
    )
    frequency = np.zeros(DIMENSIONS)
    texts = sum(r["texts"] for r in seen if r["dimension"] < 0)
    for r in seen:
        if r["dimension"] >= 0:
            frequency[r["dimension"]] = r["texts"]
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    rows = sample.groupBy("lang").applyInPandas(
        _fit_language(idf, clusters), "lang string, centroid binary, lowest double"
    ).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Model(
        [r["lang"] for r in rows],
        np.ascontiguousarray(np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows]).T),
        idf,
        np.array([floor * r["lowest"] for r in rows]),
    )


def predict(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    found = grams(text) if text and model else None
    if found is None:
        return UNKNOWN, 0.0, True
    at, weight = weighted(found, model.idf)
    near = weight @ model.centroids[at]
    best = int(np.argmax(near))
    return model.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < model.floors[best])


def language_of(docs: DataFrame, model: Model | None) -> Column:
    """Struct of ``lang_pred``, ``score`` and ``rejected`` for the column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(shared.value, t) for t in text], columns=["lang_pred", "score", "rejected"])

    return nearest(F.col("text"))


def keep_languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose language is not rejected, with their own columns."""
    return docs.where(~language_of(docs, model)["rejected"])
