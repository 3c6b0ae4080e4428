import math
import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import fold


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


TERMS = {"abcde": 1.0, "abca": 2.0, "bbbbb": 3.0, "abcab*": 1.5, "cabbac": 0.5, "abcdea": 2.5}


def brute(word):
    found = []
    for t in TERMS:
        letters = t.rstrip("*")
        if t.endswith("*"):
            if word.startswith(letters) and len(word) > len(letters):
                found.append((0, -TERMS[t], t))
        else:
            d = distance(word, letters)
            if d <= (len(letters) >= toxicity.FUZZY):
                found.append((d, -TERMS[t], t))
    return (min(found)[2], min(found)[0]) if found else None


AUTOMATON = toxicity.Automaton(TERMS)


@settings(max_examples=1500, deadline=None)
@given(st.text("abcde", max_size=9))
def test_automaton_against_edit_distance(word):
    assert AUTOMATON.lookup(word) == brute(word)


def test_context_changes_the_score():
    a = toxicity.Automaton({"idiot": 2.0})

    def one(text):
        [hit] = toxicity.hits(text, a, {})
        return hit[4]

    plain = one("what an idiot here now")
    assert one('the sign had "idiot" on it') < one("somebody called him idiot once") < plain < one("you idiot")
    assert one("what an idi0t idioot here") < plain
    assert toxicity.hits("", a, {}) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    got = toxicity.score(docs.where(held), model).join(labels, "doc_id").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    auc = ((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])).mean()
    print("terms", model.terms, "auc", auc, "recall", (s[y == 1] >= 0.5).mean(), "false", (s[y == 0] >= 0.5).mean())
    assert auc > 0.97 and (s[y == 1] >= 0.5).mean() > 0.9 and (s[y == 0] >= 0.5).mean() < 0.02


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, "some vile words " + "fine " * i, "x") for i in range(8)] + [(20 + i, "clean words here", "y") for i in range(30)] + [(90, None, "z"), (91, "", None), (None, "vile", "z"), (1, "vile", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(20 + i, 0) for i in range(30)] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.score >= 0.5} == {None, *range(8)}
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def near(a, b):
    """One edit at most; two neighbours swapped count as one."""
    return distance(a, b) <= 1 or any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


def loose_brute(word):
    found = []
    for t, weight in TERMS.items():
        s = t.rstrip("*")
        if t.endswith("*"):
            ends = [i for i in range(1, len(word)) if word[i - 1] == s[-1] and len(s) >= toxicity.FUZZY and near(word[: i - 1], s[:-1])]
            if word.startswith(s) and len(word) > len(s):
                found.append((0, -weight, t))
            elif ends:
                found.append((1, -weight, t))
        elif word == s:
            found.append((0, -weight, t))
        elif near(word, s) and (len(s) >= toxicity.FUZZY or (len(s) == toxicity.SHORT and word[:1] == s[0] and len(word) >= len(s))):
            found.append((1, -weight, t))
    return (min(found)[2], min(found)[0]) if found else None


@settings(max_examples=1500, deadline=None)
@given(st.text("abcde", max_size=9))
def test_loose_automaton_against_edit_distance(word):
    assert toxicity.Automaton(TERMS, loose=True).lookup(word) == loose_brute(word)


def test_misspellings_of_learnt_words(spark):
    for other, n in (("idiots", 2), ("idioot", 5)):
        rows = [(f"what a {other if i < n else 'idiot'} he is, that scum" if i % 2 else f"an {other if i < n else 'idiot'} here", 1) for i in range(100)]
        rows += [("what an idea he has here, that is a fine thing", 0)] * 200
        terms = toxicity.lexicon(spark.createDataFrame(rows, "text string, label int"))
        assert "idiot" in terms and "scum" in terms and "idio*" not in terms
        automaton, memory = toxicity._automaton(terms)
        for word, edits in (("idiot", 0), ("idoit", 1), ("ediot", 1), ("idi0t", 1), ("id-iot", 1), ("scum", 0), ("scumm", 1), ("skum", 1)):
            [hit] = toxicity.hits(f"that {word}, there", automaton, memory)
            assert hit[1:4] == (word, 1, edits)
        assert toxicity.hits("the sum of a slump, idle i.d. iota", automaton, memory) == []


def test_words_stay_beside_stems_and_nothing_is_cut_off(spark):
    """Words stay beside a stem that many of them share; long words and many words are all kept."""
    long = "x" * 3 + "abcdefghij" * 40
    rows = [(f"grobzz{c} there", 1) for c in "abcdefghijkl" for _ in range(15)] + [("vilest of all", 1)] * 50 + [(f"so {long}{c}", 1) for c in "pqrst" for _ in range(10)]
    rows += [(" ".join(f"bad{i}word{i}" for i in range(k, k + 100)).replace("0", "o").replace("1", "l"), 1) for k in range(0, 500, 100) for _ in range(12)] + [("clean words here", 0)] * 3000
    terms = toxicity.lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert set(terms) >= {"grobzz*", "vilest", f"{long}*", *[f"grobzz{c}" for c in "abcdefghijkl"]} and len(terms) > 300
    automaton, memory = toxicity._automaton(terms)
    assert [h[3] for h in toxicity.hits("a grobbzzqq b", automaton, memory)] == [1]
    assert [h[0] for h in toxicity.hits(f"a {long}zzz b", automaton, memory)] == [f"{long}*"]


def brute_lexicon(rows):
    """Word and stem counts of texts by hand; then the rules of the docstring."""
    words = sorted({w for text, _ in rows for w in toxicity.LETTERS.findall(text.lower())})
    places = {os.path.commonprefix([a, b]) for a in words for b in words if a != b}
    n = {k: sum(label == k for _, label in rows) for k in (0, 1)}
    t, c = {}, {}
    for text, label in rows:
        words = set(toxicity.LETTERS.findall(text.lower()))
        for term in words | {w[:k] + "*" for w in words for k in range(toxicity.STEM, len(w)) if w[:k] in places}:
            (t if label else c)[term] = (t if label else c).get(term, 0) + 1
    share = {x: (c.get(x, 0) + 1) / (n[0] + 1) for x in t}
    found = {x: (t[x], math.log(t[x] / n[1] / share[x])) for x in t if t[x] >= toxicity.LEAST and (t[x] - 2 * t[x] ** 0.5) / n[1] >= toxicity.LIFT * share[x]}
    stems = {x for x in found if x.endswith("*")}
    left = {}
    for s in stems:
        words = [found[x][0] for x in found if not x.endswith("*") and x.startswith(s[:-1])]
        longer = [found[x][0] for x in stems if x != s and x.startswith(s[:-1])]
        if max(words, default=0) < toxicity.ALONE * found[s][0] and max(longer, default=0) < found[s][0]:
            left[s] = found[s][0] * found[s][1]
    covered = {s for s in left if any(o != s and s.startswith(o[:-1]) and left[o] >= left[s] for o in left)}
    return {x: w for x, (_, w) in found.items() if x not in stems or (x in left and x not in covered)}


def test_lexicon_against_brute_force(spark):
    rng = random.Random(3)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    bad = [base + end for base in ("grom", "blix", "tavo") for end in ("", "s", "en", "ens", "ity", "er")] + ["zzat"]
    rows = [(" ".join(rng.choice(clean) for _ in range(8)), 0) for _ in range(800)] + [(rng.choice(bad) + " odd", 0) for _ in range(3)]
    rows += [(" ".join([*(rng.choice(clean) for _ in range(5)), rng.choice(bad), rng.choice(bad)]), 1) for _ in range(150)]
    got, want = toxicity.lexicon(spark.createDataFrame(rows, "text string, label int").repartition(5)), brute_lexicon(rows)
    assert got.keys() == want.keys() and any(x.endswith("*") for x in want)
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_score_against_brute_force(spark):
    docs = spark.createDataFrame([(i, f'you vile thing "{w}" he said' if i % 2 else f"a vile {w} and vile {w}") for i, w in enumerate(["grim", "vile", "fine", "vola"] * 10)] + [(99, "none at all")], "doc_id long, text string")
    model = toxicity.Model({"vile": 2.0, "grim": 1.0}, np.zeros(5), np.ones(5), np.array([0.5, 0.3, 0.2, 0.1, 0.4]), -1.0, (0.2, 0.5, 1.5))
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        n = len(r.text.split()) if r.hits else 0
        by_term = {}
        for h in r.hits:
            f = (0.2 if h.context & 1 else 0.5 if h.context & 2 else 1.0) * (1.5 if h.context & 4 else 1.0)
            assert abs(h.score - model.terms[h.term] * f * (toxicity.SHORT_SHARE if h.edits else 1.0)) < 1e-12
            by_term[h.term] = max(by_term.get(h.term, 0.0), min(f, 1.0))
        total = sum(h.score for h in r.hits)
        x = [math.log1p(total), max((h.score for h in r.hits), default=0.0), sum(by_term.values()) ** 0.5, math.log1p(100 * total / (n + 30)), max(by_term.values(), default=0.0)]
        assert abs(r.score - 1 / (1 + math.exp(1.0 - float(np.dot(x, model.weight))))) < 1e-9


def test_quotation_is_told_from_abuse(spark):
    """Fitted on texts where quoted and reported uses are clean, held-out quotations are left alone and abuse is found."""
    rng = random.Random(5)
    fill = [f"{a}{b}" for a in "bdfglmnprst" for b in ("ala", "ino", "eta", "oru")]
    insults = ["grobzak", "vileton", "morvat"]

    def text(kind, w):
        around = [" ".join(rng.choice(fill) for _ in range(rng.randint(6, 20))) for _ in range(2)]
        middle = {"abuse": f"{w} {rng.choice(fill)}", "you": f"you {w}", "quote": f"the word “{w}” is old", "single": f"signs with '{w}' on them", "said": f"somebody said {w} once"}[kind]
        return f"{around[0]} {middle} {around[1]}"

    toxic = [(text(rng.choice(["abuse", "you"]), rng.choice(insults)), 1) for _ in range(300)]
    clean = [(" ".join(rng.choice(fill) for _ in range(25)), 0) for _ in range(3000)] + [(text(rng.choice(["quote", "single", "said"]), rng.choice(insults)), 0) for _ in range(60)]
    rows = [(i, *r) for i, r in enumerate(toxic + clean)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    # Where quotation marks are mere emphasis, the sample says so.
    loud = [(text(rng.choice(["abuse", "quote", "single"]), rng.choice(insults)), 1) for _ in range(300)] + clean[:3000]
    loud = spark.createDataFrame([(i, *r) for i, r in enumerate(loud)], "doc_id long, text string, toxic int")
    other = toxicity.fit(loud.select("doc_id", "text"), loud.select("doc_id", "toxic"))
    kinds = ["abuse", "you", "quote", "single", "said"] * 30
    held = spark.createDataFrame([(i, text(k, rng.choice(insults))) for i, k in enumerate(kinds)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    right = [(got[i] >= 0.5) == (k in ("abuse", "you")) for i, k in enumerate(kinds)]
    assert np.mean(right) > 0.95
    got = {r.doc_id: r.score for r in toxicity.score(held, other).collect()}
    assert np.mean([got[i] >= 0.5 for i, k in enumerate(kinds) if k in ("abuse", "quote", "single")]) > 0.95


def test_apostrophes_are_no_quotation():
    a = toxicity.Automaton({"idiot": 2.0}, loose=True)
    context = lambda text: toxicity.hits(text, a, {})[0][5] & toxicity.QUOTED
    assert not context("it’s an idiot, that’s clear") and not context("it's an idiot, that's clear") and not context("the dogs' idiot is here")
    assert context("the ‘idiot’ is here") and context("the 'idiot' is here") and context("“an idiot”") and context("« idiot »")


def test_clashing_names_and_very_long_texts(spark):
    rows = [(i, "vile " * (40_000 if i == 0 else 1) + "thing", 1) for i in range(8)] + [(20 + i, "clean words here " + "y" * (50_000 if i == 0 else 1), 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumns({"id": F.lit(1), "term": F.lit("x"), "score": F.lit("x"), "hits": F.lit(0), "labelled": F.lit(7)})
    labels = docs.select("doc_id", F.col("label").alias("toxic"), F.lit(3).alias("id"), F.lit(4).alias("text"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r.doc_id for r in got if r.score >= 0.5} == set(range(8)) and max(len(r.hits) for r in got) >= 40_000
