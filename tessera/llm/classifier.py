"""Quality classifier by positive-unlabelled learning.

A logistic scorer over shape features of the whole text minimises the non-negative unbiased risk: with class prior q,
positives P and unlabelled texts U, q * loss(P as positive) + max(0, loss(U as negative) - q * loss(P as negative)).
Where the second term turns negative, its gradient is followed upwards, as the estimator prescribes. The prior is
estimated from positives and unlabelled texts alone: no negative label is read anywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, bounded_ids, bounded_sample

#: Bound of the learning sample: trusted positives, and unlabelled texts.
SAMPLE = 3000
ROUNDS, RATE, DECAY = 600, 0.05, 1e-4
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"#*$%&<>", b"\n", b"\"'()[]{};:", b"=_/\\@~^`+-"]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _i
_CLASS_OF[[32, 9, 11, 12, 13]] = len(_CLASSES) + 1
N_FEATURES = len(_CLASSES) + 1 + 11


def features(text: bytes | None) -> np.ndarray:
    """Shape of a text: shares of character classes, repetition of words, pairs and lines, lengths. Zeros when empty."""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    kinds = np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(_CLASSES) + 2)
    k = len(_CLASSES) + 1
    n = len(words)
    out[:k] = np.sqrt(kinds[:k] / max(1, kinds[:k].sum()))
    count = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), np.int64, n)
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    out[k:] = (
        np.log1p(n) / 8,
        size.mean() / 10,
        min(size.max(), 60) / 60,
        len(count) / n / (1 if n < 50 else min(1.0, (50 / n) ** 0.25)),
        max(count.values()) / n,
        pairs / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines),
        ends / len(lines),
        np.log1p(n / len(lines)) / 6,
        (size <= 3).mean(),
    )
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares, and steps at fixed places: a linear score over these bends in each feature."""
    return np.concatenate([x, x * x, np.maximum(x - 0.25, 0), np.maximum(x - 0.5, 0), np.minimum(x, 0.1)], axis=-1)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expanded(x.astype(float)) - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> Scorer:
    """Minimise the non-negative risk (logistic loss) by full-batch Adam; the same for the same rows."""
    both = expanded(np.concatenate([positive, unlabelled]).astype(float))
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    x = np.clip((both - mean) / scale, -8, 8)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p, u = x[: len(positive)], x[len(positive) :]
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        grad_pp = p.T @ (sp - 1) / len(p)
        grad_pn, grad_un = p.T @ sp / len(p), u.T @ su / len(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = prior * grad_pp + grad_un - prior * grad_pn if negative >= 0 else prior * grad_pn - grad_un
        grad[:-1] += DECAY * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= RATE / (1 + 4 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, w[:-1], float(w[-1]))


def _against(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic score that tells positives from unlabelled rows, both of one weight in all."""
    x = np.concatenate([positive, unlabelled])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    share = np.where(y == 1, 0.5 / len(positive), 0.5 / len(unlabelled))
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from the two samples of features alone.

    Rows get out-of-fold scores of a positive-against-unlabelled classifier; equal rows share a fold. Above any threshold, (share of unlabelled) over
    (share of positives) is at least the prior, and equals it where only positives score so high. The threshold is the one
    with the least upper confidence bound of that ratio.
    """
    both = expanded(np.concatenate([positive, unlabelled]).astype(float))
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    both = np.concatenate([np.clip((both - mean) / scale, -8, 8), np.ones((len(both), 1))], axis=1)
    p, u = both[: len(positive)], both[len(positive) :]
    scores_p, scores_u = np.zeros(len(p)), np.zeros(len(u))
    _, same = np.unique(both, axis=0, return_inverse=True)
    fold_p, fold_u = same[: len(p)] % 2, same[len(p) :] % 2
    for k in (0, 1):
        learn_p, learn_u = p[fold_p == k], u[fold_u == k]
        w = _against(learn_p, learn_u) if len(learn_p) and len(learn_u) else np.zeros(both.shape[1])
        scores_p[fold_p != k], scores_u[fold_u != k] = p[fold_p != k] @ w, u[fold_u != k] @ w
    at = np.unique(scores_p)
    above_p = 1 - np.searchsorted(np.sort(scores_p), at) / len(p)
    above_u = 1 - np.searchsorted(np.sort(scores_u), at) / len(u)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (len(u) ** -0.5 + len(np.unique(same[: len(p)])) ** -0.5)
    best = int(((above_u + slack) / above_p).argmin())
    return float(min(max(above_u[best] / above_p[best], 0.02), 0.98))


def _feature_rows(rows: DataFrame, keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], [keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {rows.schema[keep].dataType.simpleString()}, x binary")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer | None:
    """Learn from rows of ``labels`` (id, label 0/1) and unlabelled texts of ``docs``.

    Trusted positives: texts labelled 1. Unlabelled: texts of docs, whatever their label. Each is a sample of about
    ``sample`` different rows by a hash of id and text; equal rows are one. The class prior is estimated from these two
    (estimated_prior); labels 0 are read only to see that an id isn't trusted. Null labels and ids are left out; of an id
    labelled twice, the labels' largest counts. Columns besides these aren't read. None without positives or texts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    trusted = bounded_ids(known.where("label = 1").select("id", F.lit("p").alias("role")), "role", "id", sample, 6)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.lit("u").alias("role"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    positive = rows.join(F.broadcast(trusted.select("id")), F.col("doc") == F.col("id")).select(F.lit("p").alias("role"), "doc", "text")
    texts = bounded_sample(positive.union(rows), "role", sample, 61)
    found = sorted((r.role, bytes(r.x)) for r in _feature_rows(texts.select("role", "text"), "role").collect())
    x = {k: np.array([np.frombuffer(b, np.float32) for r, b in found if r == k]) for k in "pu"}
    if not len(x["p"]) or not len(x["u"]):
        return None
    return nn_pu(x["p"], x["u"], estimated_prior(x["p"], x["u"]))


def score(docs: DataFrame, model: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double) for the whole text of each row, 0..1, higher for label 1.

    Null and empty texts are scored by their (zero) features; without a model all scores are 0.5. Repeated rows stay.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t) for t in as_bytes(batch.column(1))])
                s = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return kept.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
