from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_packing import ids
from test_quality import brute as judge
from test_simhash import brute_components, brute_fp
from test_substring import brute as without_repeats


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    held = {r.doc_id: r for r in docs.collect()}
    stages = [stage for _, stage in corpus_pipeline.STAGES]

    docs = corpus_pipeline.written(stages[0](spark, docs, sf_dir), "t1")
    assert docs.columns == columns
    got = {r.doc_id: r.text for r in docs.collect()}
    judged = {i: judge(r.text) for i, r in held.items()}
    assert got == {i: j[7] for i, j in judged.items() if j[6]}
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = corpus_pipeline.written(stages[1](spark, docs, sf_dir), "t2")
    roots = brute_components({i: brute_fp(t) for i, t in got.items()})
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left == {i: t for i, t in got.items() if roots[i] == i}

    docs = corpus_pipeline.written(stages[2](spark, docs, sf_dir), "t3")
    want = {i: w[3] for i, w in without_repeats(list(left.items())).items()}
    left = {r.doc_id: r.text for r in docs.collect()}
    assert {i: t.encode().split() for i, t in left.items()} == want

    docs = corpus_pipeline.written(stages[3](spark, docs, sf_dir), "t4")
    copies = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == columns and set(copies) <= set(left) and max(copies.values()) <= 2
    taken, size = (sum(len(left[i].split()) * n for i, n in c.items()) for c in (copies, dict.fromkeys(left, 1)))
    assert 1.3 * size < taken < 1.6 * size

    pieces = stages[4](spark, docs, sf_dir).collect()
    assert Counter({r.doc_id: 0 for r in pieces}).keys() == copies.keys()
    assert sum(r.length for r in pieces) == sum(n * (len(ids(left[i])) + 1) for i, n in copies.items())


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_edge_rows_and_empty_tables(spark):
    good = " ".join(f"word{i} is here." for i in range(40))
    rows = [
        (1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, good, None, None, None), (None, good + " more words.", "en", "a", 1),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "a b", "en", "a", 3), (6, good.upper() + " end.", "de", "b", 9),
        (7, " ".join(f"other{i} text." for i in range(9000)), "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("own"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "edge")
        left.append(sorted((r.doc_id or 0) for r in docs.collect()))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert left[0] == [0, 1, 1, 2, 6, 7] and left[1].count(1) == 1 and 2 not in left[1] and 7 in left[1] and left[2] == left[1]
    assert {r.kept for r in docs.collect()} <= {"own"}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(pieces) >= docs.count()
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_columns_named_like_the_operators_own_pass_through(spark):
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept", "_w", "_l", "_copy", "_copies", "_id", "_hash", "_source", "_text_hash", "_row_id", "_row_hash", "_gone", "_gone_id", "label", "id", "size", "target", "words", "n_removed", "kept_sha256", "bucket", "start", "length", "class", "rank", "key", "column 1"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in own})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), "names")
        assert docs.columns == columns and docs.count()
    for r in docs.collect():
        assert all(r[c] == f"{c} of {r.doc_id}" for c in own)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
