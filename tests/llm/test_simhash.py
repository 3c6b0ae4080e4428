import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_match_brute_force():
    texts = [None, "", " \n ", "one", "one Two", "A b c", "a B c d É é", "x " * 1000, " ".join(str(i) for i in range(900))]
    got = simhash.fingerprint_words([t if t is None else t.encode() for t in texts])
    assert got.tolist() == [brute_fp(t) for t in texts]


@pytest.mark.parametrize("run", [simhash.RUN, 3])
def test_components_on_planted_fingerprints(spark, run):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 64, 150, dtype=np.uint64)]
    for base in fps[:8]:  # chains of near copies, and a star of many within one key
        x = base
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << b
            fps.append(x)
    fps += [fps[0] ^ (1 << b) for b in range(40)]
    fps = dict(enumerate(dict.fromkeys(fps)))
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps.values()], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, run)).collect()}
    want = brute_components(fps)
    got = {}
    for i, x in fps.items():
        s = simhash._signed(x)
        got.setdefault(roots.get(s, s), []).append(i)
    expected = {}
    for i, c in want.items():
        expected.setdefault(c, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c d", None), (3, "a b c d", None), (7, "A b C d", "y"), (None, "a b c d", "z"), (None, "lone words here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (7, 3), (None, 3), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    left = sorted(map(tuple, simhash.deduplicated(docs).collect()), key=str)
    assert left == sorted([(1, None, "x"), (3, "a b c d", None), (None, "lone words here now", "z")], key=str)
    assert simhash.deduplicated(docs.limit(0)).collect() == []


def test_near_duplicates_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_very_long_texts_and_ties(spark):
    """Whole texts count: a change at the end of a long one is seen, equal ones link, the smallest id names them."""
    long = " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000))
    rows = [(5, long), (3, long), (9, "x" * 400_000), (8, "x" * 400_000), (4, long + " " + "tail " * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own"))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in (3, 5, 8, 9)] == [3, 3, 8, 8] and got[4].fp != got[3].fp
    assert {i: got[i].fp & (2**64 - 1) for i in got} == {i: brute_fp(t) for i, t in rows}
