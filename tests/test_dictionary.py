"""Names of a dictionary against brute force over words, and the automaton against the join."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import dictionary as D

SF = "/root/testdata/sf0.001"


def brute(text, names):
    found = [(m.group(), m.start(), m.end()) for m in re.finditer("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))]
    out, k = [], 0
    while k < len(found):
        n = next((n for n in range(min(6, len(found) - k), 0, -1) if " ".join(w for w, _, _ in found[k : k + n]) in names), 0)
        if n:
            out.append((" ".join(w for w, _, _ in found[k : k + n]), k, found[k][1], found[k + n - 1][2]))
        k += n or 1
    return out


def test_finds_against_brute_force():
    dice = random.Random(1)
    for _ in range(300):
        names = {" ".join(dice.choices("a b ab ba".split(), k=dice.randint(1, 4))) for _ in range(5)}
        text = "".join(dice.choices(["a", "b", "ab", "B", " ", "-", "é", "\n"], k=40))
        assert D.finds(text, D._automaton(sorted(names), hash(tuple(sorted(names))))) == brute(text, names), (text, names)


def test_names_of_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = ["of the", "The", "in and", "that", "heat", "", "--", None, "of the heat", "ÜBER", "thing"]
    names = spark.createDataFrame([(n,) for n in said], "name string")
    known = {"of the", "the", "in and", "that", "heat", "of the heat", "ber", "thing"}
    want = sorted((r.doc_id, *f) for r in docs.collect() for f in brute(r.text or "", known))
    got = D.names_in(docs, "doc_id", "text", names)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(D, "NAMES", 3)
    joined = D.names_in(docs, "doc_id", "text", names)
    assert sorted(tuple(r)[:3] for r in joined.collect()) == [w[:3] for w in want]


def test_masks(spark):
    rows = [(1, "Permit Gold wins a permit"), (2, "the permit-gold, Permit  GOLD and permits"), (3, None), (4, ""), (5, "Café Permit"), (5, "Café Permit")]
    names = spark.createDataFrame([("Permit Gold",), ("permit",)], "name string")
    got = D.masked(spark.createDataFrame(rows, "id int, h string"), "h", names).orderBy("id").collect()
    assert [r.h for r in got] == ["Xyz wins a Xyz", "the Xyz, Xyz and permits", None, "", "Café Xyz", "Café Xyz"]
    assert D.masked(spark.createDataFrame(rows, "id int, h string"), "h", names.limit(0)).where("h like 'Permit Gold%'").count() == 1
