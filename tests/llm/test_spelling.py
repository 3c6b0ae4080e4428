import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling


def edits(w, letters):
    for k in range(len(w) + 1):
        yield from (w[:k] + c + w[k:] for c in letters)
        if k < len(w):
            yield w[:k] + w[k + 1 :]
            yield from (w[:k] + c + w[k + 1 :] for c in letters)


def brute_force(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_count}
    letters = {c for w in n for c in w}
    near = {w: {v for v in edits(w, letters) if v in n and v != w} for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def found(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("large", [3, 2048])
def test_dense_words_against_brute_force(spark, large):
    dice = random.Random(5)
    words = ["".join(dice.choice("abÀé") for _ in range(dice.choice([6, 6, 7, 8, 9]))) for _ in range(500)]
    rows = [(i, " ".join(dice.choices(words, weights=[1 / (k + 1) for k in range(500)], k=900))) for i in range(30)]
    rows.append((30, "aaaaaaaaa " * 20000 + "aaaaaaaab " * 3000 + "aaaaaaabb " * 500 + "aaaaaabbb " * 80 + "aaaaabbbb " * 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(spelling.variants(docs, large=large))
    assert got == brute_force(rows)
    assert any(r[1] and r[1] != r[2] for r in got), "no chain of forms"


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(spelling.variants(docs, large=64)) == brute_force([tuple(r) for r in docs.collect()])


def test_blocks_stay_small_and_lose_no_pair(spark):
    """A third of all words share their beginning, another their end: blocks are dealt again until they are small."""
    dice = random.Random(7)
    words = {"prefix" + "".join(dice.choices("abcdefgh", k=5)) for _ in range(1500)} | {"".join(dice.choices("abcdefgh", k=5)) + "suffix" for _ in range(1500)}
    table = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    dealt = spelling.blocks(table, large=100)
    sizes = dealt.groupBy("block", "base", "i", "j").agg(F.count("*").alias("size")).where(F.col("j") - F.col("i") > 1)
    assert sizes.agg(F.max("size")).head()[0] <= 100
    rows = sorted(dealt.collect(), key=lambda r: (r.base, r.block))
    a, b = spelling.near_pairs(spelling.Words([r.word for r in rows]), *(np.array([r[k] for r in rows]) for k in ("block", "base", "i", "j")))
    pairs = [tuple(sorted((rows[x].word, rows[y].word))) for x, y in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)), "a pair is counted twice"
    want = {tuple(sorted((w, v))) for w in words for v in edits(w, "abcdefghprixuf") if v in words and v != w}
    assert set(pairs) == want


def test_edge_cases(spark):
    long = "zyxwvut" * 3000
    rows = [(1, None, "x"), (2, "", "x"), (None, "Straßen straßen STRAßEN straßen straßen", None), (3, ("éclair Éclair " * 5 + long + " " + long + "a ") * 5, "y"), (3, "lonely " * 5 + "123 -- ", "y"), (3, "lonely " * 5 + "123 -- ", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = found(spelling.variants(docs))
    assert got == brute_force([r[:2] for r in rows])
    assert {r[0] for r in got} >= {"éclair", "Éclair", "lonely"}
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("text is null")).count() == 0
