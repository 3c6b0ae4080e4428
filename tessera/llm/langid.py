"""Language identification by nearest centroids.

A text is a unit vector of TF-IDF weights of its hashed character 1- to 3-grams (letters only, case folded, words
apart). Each language has several centroids, from spherical k-means over its sample, and a text takes the language of
the centroid with the largest cosine. A text farther from all centroids than nearly all learning texts is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample

DIM, CLUSTERS, ROUNDS = 4096, 4, 8
#: Bound of the learning sample: documents a language. Share of learning texts that may lie beyond the rejection distance.
SAMPLE, BEYOND = 800, 0.002
UNKNOWN = "und"
_POINTS = 0x110000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(_POINTS)]))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the whole text; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return None
    c = np.concatenate([[0], np.where(letter, points, 0), [0]]).astype(np.uint32)
    keep = np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])  # one gap between words
    c = c[keep]
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    grams = np.concatenate([c[c != 0] * np.uint32(0x165667B1), two, three])
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 12), minlength=DIM)


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    least: float  # cosines below are rejected


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the mean and then the points farthest from all chosen: the same for the same rows."""
    chosen = [x.mean(axis=0)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int((x @ np.array(chosen).T).max(axis=1).argmin())])
    c = np.array(chosen)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(ROUNDS):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids | None:
    """Centroids from a bounded sample: about ``sample`` different whole texts a language, by a hash of id and text.

    Rows with a null language or without letters aren't learnt from; equal rows are one. None if nothing is left. What comes to the
    driver is one sparse count vector per sampled text.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = bounded_sample(rows.where(F.col("text") != ""), "lang", sample, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, at, n = [], [], [], []
            for i, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counts = gram_counts(text)
                if counts is not None:
                    full = np.flatnonzero(counts)
                    ids.append(str(i))
                    langs.append(lang)
                    at.append(full.astype("<u2").tobytes())
                    n.append(counts[full].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["id", "lang", "at", "n"])

    found = sorted(rows.mapInArrow(run, "id string, lang string, at binary, n binary").collect())
    if not found:
        return None
    counts = np.zeros((len(found), DIM), np.float32)
    for row, r in zip(counts, found, strict=True):
        row[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.n, "<u4")
    idf = (np.log((1 + len(found)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _weights(counts, idf)
    lang = np.array([r.lang for r in found])
    names, vectors = [], []
    for name in np.unique(lang).tolist():
        c = _k_means(x[lang == name], clusters)
        names += [name] * len(c)
        vectors.append(c)
    vectors = np.concatenate(vectors).astype(np.float32)
    least = float(np.quantile((x @ vectors.T).max(axis=1), BEYOND))
    return Centroids(names, vectors, idf, least)


def predict(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred string, score double, rejected boolean) for the whole text of each row.

    score is the cosine with the nearest centroid, in 0..1. Null texts, texts without letters, and all texts when there is
    no model, get ``und``, score 0 and rejected. Ties go to the first language in order. Repeated rows stay.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for at in range(0, batch.num_rows, 512):
                counts = [gram_counts(t) for t in batch.column(1).slice(at, 512).to_pylist()]
                full = [i for i, c in enumerate(counts) if c is not None and model is not None]
                lang, score = [UNKNOWN] * len(counts), [0.0] * len(counts)
                if full:
                    cosine = _weights(np.array([counts[i] for i in full]), model.idf) @ model.vectors.T
                    for i, j, s in zip(full, cosine.argmax(axis=1).tolist(), cosine.max(axis=1).tolist(), strict=True):
                        lang[i], score[i] = model.languages[j], min(max(s, 0.0), 1.0)
                langs += lang
                scores += score
            far = [lang == UNKNOWN or s < model.least for lang, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, f"id {id_type}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
