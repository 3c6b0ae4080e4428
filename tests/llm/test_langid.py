import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.common import fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held))
    got = langid.predict(docs.where(held), model).join(docs, "doc_id").select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.1
    odd = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок")], "doc_id long, text string")
    assert langid.predict(odd, model).head().rejected


def test_counts_against_brute_force():
    text = "Ab c! É2"
    letters = [c if c.isalpha() else " " for c in text.lower()]
    line = " " + " ".join("".join(letters).split()) + " "
    n = sum(c != " " for c in line) + len(line) - 1 + len(line) - 2
    assert langid.gram_counts(text).sum() == n
    assert langid.gram_counts("12 !") is None and langid.gram_counts("") is None and langid.gram_counts(None) is None


def test_edge_cases(spark):
    rows = [(1, "hello there world", "en", "x"), (1, "hello there world", "en", "x"), (2, None, "en", "y"), (3, "", None, "y"), (None, "guten tag welt", "de", "z"), (4, "123", "de", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "de"), (1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und")]
    empty = docs.limit(0)
    assert langid.fit(empty) is None and langid.predict(empty, None).collect() == []
    assert langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_letters_of_all_planes():
    assert langid.gram_counts("\U00030000\U00031000").sum() == 2 + 3 + 2 and langid.gram_counts("\U000e0001") is None


def brute_grams(text):
    """Hash of each 1- to 3-gram of the letters, words apart, by whole-number arithmetic."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    m, counts = 1 << 32, {}
    points = [0 if c == " " else ord(c) for c in line]
    hashed = [p * 0x165667B1 for p in points if p]
    hashed += [a * 0x9E3779B1 + b * 0x85EBCA77 for a, b in zip(points, points[1:])]
    hashed += [(a * 0x9E3779B1 + b * 0x85EBCA77) % m * 0xC2B2AE3D + c * 0x27D4EB2F for a, b, c in zip(points, points[1:], points[2:])]
    for h in hashed:
        h %= m
        h = (h ^ h >> 15) * 0x2C1B3C6D % m >> 20
        counts[h] = counts.get(h, 0) + 1
    return counts


def test_prediction_against_brute_force(spark):
    """Weights, cosines, the nearest centroid, ties and rejection, text by text in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i in sorted(texts)[:60]:
        counts = brute_grams(texts[i])
        weight = {h: math.log1p(n) * float(model.idf[h]) for h, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w * float(v[h]) for h, w in weight.items()) / norm for v in model.vectors]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[i].lang_pred == model.languages[best] and abs(got[i].score - min(cosines[best], 1.0)) < 1e-5
        assert abs(cosines[best] - model.least) < 1e-5 or got[i].rejected == (cosines[best] < model.least)


def test_ties_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "same words", "bb"), (2, "same words", "aa"), (3, "same words " * 50_000, None), (4, "w" * 300_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "aa" and got[3].lang_pred == "aa" and 0 <= got[4].score <= 1
