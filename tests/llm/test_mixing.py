import numpy as np
import pytest

from tessera.llm import mixing


def brute_targets(sizes, share=1.5, cap=2.0):
    """Share by weight; what is above a cap is shared again by weight among the rest, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full, target = share * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        amount = left - sum(cap * sizes[s] for s in full)
        target = {s: amount * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target | {s: cap * sizes[s] for s in full}
        full |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 50, "d": 1, None: 7}, {"x": 10}, {"a": 0, "b": 9}, {"é": 3, "z": 90, "A": 900}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_pivotal_keeps_words_and_expectation():
    size = np.array([900, 500, 500, 40, 30, 20, 10, 5, 0, 3])
    p = np.full(len(size), 0.37)
    total = np.zeros(len(size))
    for seed in range(3000):
        q, at = mixing.pivotal(size, p, np.random.default_rng(seed))
        assert abs((q * size).sum() - (0.37 * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(q) if i != at)
        total += q
    assert np.abs(total / 3000 - 0.37).max() < 0.05


def check(rows, tolerance=None):
    sources = {}
    for r in rows:
        assert 0 <= r.copies <= 2
        s = sources.setdefault(r.source, [0, r.source_size, r.target, 0, 0])
        s[0] += r.copies * r.size * r.n_rows
        s[3] += r.size * r.n_rows
        s[4] = max(s[4], r.size * r.n_rows)
    for taken, source_size, target, size, largest in sources.values():
        assert source_size == size
        assert abs(taken - target) <= largest + 1e-6
    want = brute_targets({s: x[1] for s, x in sources.items()})
    assert all(abs(sources[s][2] - want[s]) < 1e-6 * max(1, want[s]) for s in sources)
    return {s: (x[0], x[2]) for s, x in sources.items()}


def test_whole_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mix(docs).collect()
    for taken, target in check(first).values():
        assert abs(taken - target) < 0.03 * target
    assert sum(r.n_rows for r in first) == docs.count()
    again = mixing.mix(docs.repartition(5)).collect()
    assert {r.doc_id: r.copies for r in first} == {r.doc_id: r.copies for r in again}
    monkeypatch.setattr(mixing, "LEAF", 6)  # several levels of the tree
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    for taken, target in check(mixing.mix(docs).collect()).values():
        assert abs(taken - target) < 0.15 * target


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x y z", "b"), (None, "x y z", "b"), (None, "q", "b"), (4, "w " * 400, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS copies", "3 AS p")
    check(mixing.mix(docs).collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.source, r.size): r.copies * r.n_rows for r in mixing.mix(docs).collect()}
    assert out.count() == sum(taken.values())
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
