import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifier
from tessera.llm.common import fold


def test_non_negative_risk_finds_the_classes():
    rng = np.random.default_rng(0)
    d = classifier.N_FEATURES
    good, bad = rng.normal(0.6, 0.1, (2000, d)), rng.normal(0.4, 0.1, (800, d))
    model = classifier.nn_pu(good[:600], np.concatenate([good[600:], bad]), 1400 / 2200)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad) < 0.5).mean() > 0.97


@pytest.mark.parametrize("prior", [0.1, 0.35, 0.6, 0.9])
def test_known_priors_are_estimated(prior):
    """From positives and unlabelled rows alone, whatever the share of positives among them; copies and ties too."""
    rng = np.random.default_rng(int(prior * 100))
    d, n = classifier.N_FEATURES, 3000
    good = rng.normal(0.6, 0.12, (3000, d))
    of_u = rng.random(n) < prior
    unlabelled = np.where(of_u[:, None], rng.normal(0.6, 0.12, (n, d)), rng.normal(0.45, 0.12, (n, d)))
    assert abs(classifier.estimated_prior(good, unlabelled) - prior) < 0.06
    assert abs(classifier.estimated_prior(np.repeat(good[:300], 10, axis=0), unlabelled) - prior) < 0.1


def test_prior_of_nothing_but_positives_and_of_one_row():
    rng = np.random.default_rng(1)
    good = rng.normal(0.6, 0.1, (2000, classifier.N_FEATURES))
    assert classifier.estimated_prior(good[:1000], good[1000:]) > 0.85
    assert 0 < classifier.estimated_prior(good[:1], good[:1]) < 1


def test_labels_of_the_bad_class_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = classifier.fit(docs, labels), classifier.fit(docs, labels.where("quality = 1"))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def brute_features(text):
    """Shape of a text by plain counting."""
    words = text.split()
    shares = [0] * (len(classifier._CLASSES) + 2)
    for byte in text:
        kind = next((k for k, chars in enumerate(classifier._CLASSES) if byte in chars), len(classifier._CLASSES))
        shares[len(classifier._CLASSES) + 1 if byte in b" \t\x0b\x0c\r" else kind] += 1
    n, sizes = len(words), [len(w) for w in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    k = len(classifier._CLASSES) + 1
    return [
        *[math.sqrt(x / sum(shares[:k])) for x in shares[:k]],
        math.log1p(n) / 8, sum(sizes) / n / 10, min(max(sizes), 60) / 60, len(set(words)) / n / (1 if n < 50 else min(1.0, (50 / n) ** 0.25)),
        max(words.count(w) for w in set(words)) / n, len(set(pairs)) / max(1, n - 1), sum(a == b for a, b in pairs) / n, 1 - len(set(lines)) / len(lines),
        sum(x.strip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), math.log1p(n / len(lines)) / 6, sum(x <= 3 for x in sizes) / n,
    ]


def test_features_and_score_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000 and n_chars > 0")
    model = classifier.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r.score for r in classifier.score(docs, model).collect()}
    for r in docs.collect()[:80]:
        text = r.text.encode()
        if not text.split():
            continue
        x = brute_features(text)
        assert np.allclose(classifier.features(text), x, atol=1e-6)
        bent = [*x, *[v * v for v in x], *[max(v - 0.25, 0) for v in x], *[max(v - 0.5, 0) for v in x], *[min(v, 0.1) for v in x]]
        z = sum(min(max((v - m) / s, -8), 8) * w for v, m, s, w in zip(bent, model.mean, model.scale, model.weight)) + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-4


def test_risk_against_brute_force():
    """One step from zero follows the gradient of the non-negative risk, taken by differences."""
    rng = np.random.default_rng(9)
    d, prior = classifier.N_FEATURES, 0.4
    p, u = rng.random((40, d)), rng.random((60, d))
    model = classifier.nn_pu(p, u, prior, rounds=400)

    def risk(m):
        zp, zu = (np.clip((classifier.expanded(x) - m.mean) / m.scale, -8, 8) @ m.weight + m.bias for x in (p, u))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)

    start = classifier.Scorer(model.mean, model.scale, np.zeros_like(model.weight), 0.0)
    assert risk(model) < 0.8 * risk(start)


def test_very_long_text_and_ties(spark):
    docs = spark.createDataFrame([(1, "good text here. " * 60_000), (2, "x" * 500_000), (3, "good text here."), (4, "good text here.")], "doc_id long, text string").withColumns({"label": F.lit(1), "id": F.lit("x"), "doc": F.lit(2), "role": F.lit("u"), "x": F.lit(0)})
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit("y").alias("id"))
    got = {r.doc_id: r.score for r in classifier.score(docs, classifier.fit(docs, labels)).collect()}
    assert got[3] == got[4] and all(0 <= s <= 1 for s in got.values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = fold(F.col("doc_id"), 3) == 1
    model = classifier.fit(docs.where(~held), labels.where(~held))
    got = classifier.score(docs.where(held), model).join(labels, "doc_id").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    order = s[y == 1][:, None] > s[y == 0][None, :]
    print("auc", order.mean(), "accuracy", ((s >= 0.5) == y).mean(), "recall of 0", (s[y == 0] < 0.5).mean(), "of 1", (s[y == 1] >= 0.5).mean())
    assert order.mean() > 0.97 and ((s >= 0.5) == y).mean() > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y z.", "b"), (3, "x y z.", "b"), (None, "x " * 5000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    got = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert classifier.fit(docs, labels.limit(0)) is None and classifier.fit(docs.limit(0), labels) is None
    assert classifier.score(docs.limit(0), None).collect() == []
