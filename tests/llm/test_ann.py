import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def exact(ids, x, k):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = np.einsum("ij,j->i", x, v)
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in best]
    return out


@pytest.mark.parametrize("block", [ann.BLOCK, 700, 250])
def test_recall_on_the_table(spark, block):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = table.toPandas()
    want = exact(pdf.vec_id.to_numpy(), np.array(pdf.embedding.tolist(), float), 20)
    got = ann.nearest(table, F.col("vec_id") % 20 == 0, block=block).toPandas()
    assert set(got.query_id) == set(want)
    hit = 0
    for i, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
        known = dict(want[i])
        hit += len(set(g.vec_id) & set(known))
        assert all(known[j] == s for j, s in zip(g.vec_id, g.score, strict=True) if j in known)
    print("recall", hit / (20 * len(want)))
    assert hit / (20 * len(want)) >= 0.95


def test_the_first_block_is_searched_by_many_tasks(spark, monkeypatch):
    """With more blocks than cores the pass ahead of the others has as many tasks as cores, of like size."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    monkeypatch.setattr(ann, "SHARED", 4)
    ahead = []
    kept = ann.written
    monkeypatch.setattr(ann, "written", lambda df, label: ahead.append(df) or kept(df, label))
    found = ann.nearest(table, F.col("vec_id") % 20 == 0, block=100)
    assert found.count() == 20 * table.where("vec_id % 20 = 0").count()
    queries = ahead[0].groupBy(F.spark_partition_id()).agg(F.count_distinct("query_id").alias("n")).collect()
    assert len(queries) == spark.sparkContext.defaultParallelism and max(r.n for r in queries) <= 4 * sorted(r.n for r in queries)[len(queries) // 2]


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 1024)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    sizes = []
    monkeypatch.setattr(ann, "BLOCK_BYTES", 20 * 1024 * 64)
    monkeypatch.setattr(ann, "_run", lambda k, top, run=ann._run: sizes.append(k) or run(k, top))
    got = ann.nearest(table, F.col("vec_id") % 20 == 0, k=5).toPandas()
    want = exact(np.arange(300), x.astype(float), 5)
    assert len(sizes) == 2, "five blocks: the first is searched ahead"
    assert sum(len(set(g.vec_id) & {j for j, _ in want[i]}) for i, g in got.groupby("query_id")) >= 0.9 * 5 * len(want)


def search(ids, x, queries, q, k=20):
    top = float(ann.log2_norms(x).max())
    return {i: (f, s) for i, f, s, _ in ann.Block(ids, x, top, k).search(queries, q, np.full(len(q), -math.inf))}


def test_norms_differ_and_copies_tie():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)) * rng.gamma(2, 1, (3000, 1))
    x[1000:1500] = x[7] * 3
    ids = np.arange(3000)
    want = exact(ids, x, 20)
    queries = np.array(sorted(want))
    hit = 0
    for i, (found, _) in search(ids, x, queries, x[queries]).items():
        hit += len({*found.tolist()} & {j for j, _ in want[i]})
        assert i not in found
    assert hit / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0])
def test_any_magnitude_ends(scale):
    """Products of 1e200 overflow to one infinite score, of 1e-200 vanish; the search ends and finds what brute force finds."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8))
    x[::3] *= scale
    ids = np.arange(400)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        want = exact(ids, x, 5)
    got = search(ids, x, np.array(sorted(want)), x[::20], 5)
    assert set(got) == set(want)
    same = [np.array_equal(got[i][1], [s for _, s in want[i]]) for i in want if np.isfinite([s for _, s in want[i]]).all()]
    assert np.mean(same) >= 0.8
    assert all(np.isinf(got[i][1]).sum() >= min(3, np.isinf([s for _, s in want[i]]).sum()) for i in want)


def test_huge_and_tiny_rows_in_spark(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 4))
    x[5], x[40] = [1e200, 1.0, 0.0, 0.0], [1e-200, 0.0, 0.0, 0.0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0] * 9), (1020, [2.0] * 9)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by_query) == set(range(0, 300, 20)) and all(len(v) == 3 for v in by_query.values())
    assert by_query[40][0] == 5 and by_query[0][0] == (5 if x[0][0] > 0 else by_query[0][0])


def test_repeated_ids_are_the_same_from_run_to_run(spark):
    rows = [(i % 50, [float(i % 7), float(i % 11), 1.0]) for i in range(1000)]
    first, again = (ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n), F.col("vec_id") % 20 == 0, k=4).collect() for n in (3, 8))
    assert sorted(first) == sorted(again) and len(first) == 12
    least = {}
    for i, v in rows:
        least[i] = min(least.get(i, v), v)
    assert all(r.score == sum(a * b for a, b in zip(least[r.query_id], least[r.vec_id], strict=True)) for r in first)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, []), (40, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "id": F.lit(1), "v": F.lit(1), "query": F.lit(1)})
    got = ann.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(table, F.lit(False)).collect() == []
