import hashlib
import random
import tracemalloc

import numpy as np

from tessera.llm import substring


def brute(docs, width=20):
    """docs: [(id, text)] with unique ids, null last; what stays of each."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for i, text in order:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept)
    return out


def check(spark, docs, **kw):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring.dedup_substrings(frame, **kw).collect()}
    want = brute(docs, kw.get("window", 20))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert {i: (r.text or "").encode().split() for i, r in got.items()} == {i: w[3] for i, w in want.items()}
    return got


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["é", "ß x"]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 70))) for _ in range(6)]
    docs = [(9, None), (8, ""), (None, passages[0]), (7, "same " * 90)]
    for i in range(10, 70):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    docs.append((70, docs[20][1]))
    for kw in ({"n_buckets": 7, "block_words": 300}, {"n_buckets": 3}, {"window": 5, "n_buckets": 5, "block_words": 100}, {"window": 2, "n_buckets": 5}):
        got = check(spark, docs, **kw)
    assert got[9].text is None


def test_hash_clashes_are_told_apart(monkeypatch, spark):
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 4])
    at = np.array([0, 3, 6, 9])
    assert substring._first_of_equal(ids, np.zeros(4, np.uint64), at, 3).tolist() == [0, 1, 0, 1]


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, text, "t")], "doc_id long, text string, n_words string")
    got = substring.dedup_substrings(docs, n_buckets=3)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept_sha256"]
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got.collect()) == [(1, 0, text), (1, 0, text), (2, 30, "")]
    assert substring.dedup_substrings(docs.limit(0)).collect() == []


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in rows.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(rows, block_words=20_000).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    assert any(w[1] for w in want.values())


def test_a_frequent_line_is_dealt_to_many_buckets(spark):
    """Different windows around one line: no bucket holds more than a few times its share, and the results stay exact."""
    rng = random.Random(5)
    line = "this text may be copied by all who read it here"
    docs = []
    for i in range(300):
        before, after = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(2))
        docs.append((i, f"{before} {line} {after}"))
    docs += [(300 + i, docs[i][1]) for i in range(0, 60, 3)] + [(None, docs[7][1])] * 3
    check(spark, docs[:-2], n_buckets=40, block_words=500, bucket_windows=300)
    keys = spark.createDataFrame([(i, 0, t) for i, t in docs[:300]], "doc_id long, text_hash int, text string").repartition(3)
    parts = substring.large_buckets(keys, 40, 10_000, 20, 300)
    sizes = {}
    for r in keys.mapInArrow(substring._super_kmers(40, 20, 500, parts), "bucket long, payload binary").collect():
        packed = substring._unpacked(r.payload)
        if len(packed) == 5:
            sizes[r.bucket] = sizes.get(r.bucket, 0) + int(np.frombuffer(packed[3], np.int32).sum())
    windows = sum(len(t.split()) - 19 for _, t in docs[:300])
    assert sum(sizes.values()) == windows and windows > 40 * 300 and parts
    assert max(sizes.values()) < 2 * 2 * 300

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r for r in substring.dedup_substrings(frame, n_buckets=40, bucket_windows=300).collect() if r.doc_id is None]
    assert [(r.n_removed, r.text) for r in got] == [(71, "")] * 3


def peak_bytes(work) -> int:
    """The most memory that ``work`` had at a time beyond what stood before."""
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_rolling_hashes_of_a_long_text_need_little_beside_the_result():
    h = np.random.default_rng(1).integers(0, 1 << 63, 3 * substring.ROLLED + 5, dtype=np.uint64)
    for width in (1, 20, len(h), len(h) + 1):
        whole = substring._rolling(h, width)
        assert len(whole) == max(0, len(h) - width + 1)
    whole = substring._rolling(h, 20)
    for x in (0, substring.ROLLED - 1, substring.ROLLED, 2 * substring.ROLLED - 19, len(whole) - 1):
        assert whole[x] == substring._rolling(h[x : x + 20].copy(), 20)[0]
    h = np.ones(2_000_000, np.uint64)
    assert peak_bytes(lambda: substring._rolling(h, 20)) < 2 * h.nbytes


def test_a_bucket_needs_memory_for_its_windows_not_for_all_words_of_its_strings():
    rng = np.random.default_rng(2)
    payloads = []
    for k in range(8):
        n = 5000
        start = np.arange(n, dtype=np.int64) * 40
        strings = [b" ".join(b"w%d" % w for w in row) for row in rng.integers(0, 3000, (n, 24)).tolist()]
        if k:
            strings[:10] = first
        first = strings[:10]
        payloads.append(substring._packed(np.full(n, k, np.int64).tobytes(), np.zeros(n, np.int64).tobytes(), start.tobytes(), np.full(n, 5, np.int32).tobytes(), b"\n".join(strings)))
    found = []
    peak = peak_bytes(lambda: found.append(substring._bucket(payloads, 20)))
    assert sorted(zip(*(c.to_pylist() for c in found[0].columns), strict=True)) == [(k, 0, 40 * i, 5) for k in range(1, 8) for i in range(10)]
    assert peak < 40 * 8 * 5000 * 24  # bytes a word of its strings
