"""The stored index against a scan of all texts, and what a search reads of it."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S

SF = "/root/testdata/sf0.01"


def scan(docs, prefixes):
    found = []
    for i, text in docs.items():
        words = re.split("[^a-z0-9]+", (text or "").lower())
        if i is not None and all(any(w.startswith(p) and w for w in words) for p in prefixes):
            found.append(i)
    return sorted(found, reverse=True)


def asked(spark, path, prefixes, limit=None):
    return sorted((r.doc_id for r in S.search(spark, path, prefixes, limit).collect()), reverse=True)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    kept = S.PER_FILE
    S.PER_FILE = 8000
    S.build(spark.read.parquet(f"{SF}/documents.parquet"), path)
    S.PER_FILE = kept
    return path


def test_prefixes_against_a_scan(spark, index):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for prefixes in (["heat"], ["tion", "heat", "ston"], ["a"], ["zzzz"], ["the", "the"], ["heat", "zzzz"], [""], ["HEAT"], ["9"]):
        assert asked(spark, index, prefixes) == scan(docs, [p.lower() for p in prefixes]), prefixes
    assert S.search(spark, index, []).count() == 0
    assert asked(spark, index, ["a"], 7) == scan(docs, ["a"])[:7]


def test_a_search_reads_only_the_files_of_its_ranges(spark, index):
    lines = S.files_of(spark, index, [""]).collect()
    assert len(lines) > 8
    ranges = sorted((r.first, r.last) for r in lines)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])), "ranges overlap"
    of_prefix = S.files_of(spark, index, ["heat"]).collect()
    assert {r.path for r in of_prefix} == {r.path for r in lines if r.first <= "heat￿" and r.last >= "heat"}
    assert sum(r.bytes for r in of_prefix) * 4 < sum(r.bytes for r in lines)
    name = lambda p: p.rsplit("/", 1)[1]
    assert {name(p) for p in S.search(spark, index, ["heat"]).inputFiles()} == {name(r.path) for r in of_prefix}


def test_refreshes_write_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = {1: "alpha beta", 2: "alpha gamma", 3: None, 4: "", 5000: "alpha beta beta", -7: "beta"}
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    S.build(put([*docs.items(), (None, "alpha")]), path)
    with pytest.raises(ValueError):
        S.build(put([]), path)
    steps = [{2: "beta delta", 6: "alpha"}, {1: None, 2: "alpha"}, {1: "alpha again beta"}, {}]
    for gen, step in enumerate(steps, 1):
        S.refresh(put(list(step.items())), path)
        docs |= step
        for prefixes in (["al"], ["be"], ["al", "be"], ["delta"], ["aga", "al"]):
            assert asked(spark, path, prefixes) == scan(docs, prefixes), (gen, prefixes)
        written = spark.read.schema(S.POSTINGS).parquet(f"{path}/postings/gen={gen}")
        assert {i for r in written.collect() for i in r.ids} == {i for i, t in step.items() if t}
    S.refresh(put([(i, None) for i in docs]), path)
    assert asked(spark, path, [""]) == []


def test_repeated_rows_and_long_texts(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (2, "word " * 100_000 + "last")]
    S.build(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert asked(spark, path, ["one", "three"]) == [1] and asked(spark, path, ["la"]) == [2]


def test_files_are_cut_by_postings_whatever_the_texts_and_ids(spark, tmp_path, monkeypatch):
    """A task sorts one file: few long texts, or one word of all blocks, must not end in one (F32)."""
    monkeypatch.setattr(S, "PER_FILE", 10_000)
    long = spark.range(20).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.concat(F.lit("w"), i)), " ").alias("text"))
    wide = spark.range(30_000).select((F.col("id") * S.BLOCK).alias("doc_id"), F.lit("common").alias("text"))
    for name, docs, prefix, finds in (("long", long, "w4", 20), ("wide", wide, "com", 30_000)):
        path = str(tmp_path / name)
        S.build(docs, path)
        held = spark.read.schema(S.POSTINGS).parquet(f"{path}/postings/gen=0").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum("n").alias("n"), F.min("term").alias("first"), F.max("term").alias("last")).collect()
        assert max(r.n for r in held) < 3 * S.PER_FILE, name
        assert {(r.path, r.first, r.last) for r in held} == {(r.path, r["first"], r["last"]) for r in S.files_of(spark, path, [""]).collect()}
        assert len(asked(spark, path, [prefix])) == finds


def test_lists_of_any_batches_hold_each_posting_once(monkeypatch):
    """Lists are made of rows as they come: ids in any order, words of a document in several rows, repeated rows (F33)."""
    monkeypatch.setattr(S, "AT_ONCE", 500)
    monkeypatch.setattr(S, "ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i) // 4, " ".join(f"t{x}" for x in rng.integers(0, 40, rng.integers(1, 30)))) for i in rng.integers(-50, 50, 300)]
    want = defaultdict(set)
    for i, block, text in rows:
        for w in text.split(" "):
            want[w, block].add(i)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 90])], ["id", "block", "words"]) for k in range(0, 300, 90)]
    got, made = defaultdict(set), list(S._listed(iter(batches)))
    assert len(made) > 3 and not list(S._listed(iter([])))
    for r in (r for b in made for r in b.to_pylist()):
        assert r["ids"] == sorted(set(r["ids"])) and r["n"] == len(r["ids"]) > 0
        got[r["term"], r["block"]] |= set(r["ids"])
    assert got == want


def test_texts_longer_than_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "ROW_WORDS", 3)
    docs = {1: "a b c", 2: "a b c d", 3: "", 4: None, 5: " ".join(f"x{i}" for i in range(50)) + " a"}
    S.build(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), str(tmp_path / "i"))
    for prefixes in (["a"], ["d"], ["x49", "a"], ["x"], [""]):
        assert asked(spark, str(tmp_path / "i"), prefixes) == scan(docs, prefixes), prefixes
