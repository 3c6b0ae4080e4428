import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes


def brute_force(rows, rounds=6):
    """rows: (id, vector, label); ids ascending decide the start."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-len(kept[0][1]) // 8)
    ints = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    parts = [[v[j * width : (j + 1) * width] for j in range(8)] for v in ints]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:16]
    books = [[parts[k][j] for k in first] for j in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for j in range(8):
            groups = {}
            for p in parts:
                groups.setdefault(nearest(p[j], books[j])[1], []).append(p[j])
            books[j] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[j])]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    best = [[nearest(p[j], books[j]) for j in range(8)] for p in parts]
    errors = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    fits = lambda e: e if e < 1 << 63 else None
    found = [(k[0], "".join(f"{e:02x}" for _, e in b), fits(error), fits(by_label[k[2]]), digest) for k, b, error in zip(kept, best, errors)]
    return sorted(found, key=repr)


def found(spark, rows, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted((tuple(r) for r in codes.compress(frame).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 8, 16, 32])
def test_transform_keeps_distances_and_orders_by_sign_changes(size):
    matrix = codes.walsh(np.eye(size, dtype=np.int64)).T
    assert [int((row[1:] != row[:-1]).sum()) for row in matrix] == list(range(size))
    x, y = np.random.default_rng(1).integers(-99, 99, (2, 50, size))
    assert (((codes.walsh(x) - codes.walsh(y)) ** 2).sum(axis=1) == size * ((x - y) ** 2).sum(axis=1)).all()


def test_early_elimination_is_exact():
    rng = np.random.default_rng(2)
    for size in (1, 2, 4, 16):
        t, entries = rng.integers(-3, 4, (400, size)), rng.integers(-3, 4, (16, size))
        best, scaled = codes.nearest_entries(codes.walsh(t), codes.walsh(entries))
        d = ((t[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and (scaled == size * d.min(axis=1)).all()


@pytest.mark.parametrize("length", [8, 24, 20, 3, 64])
def test_against_brute_force(spark, length):
    rng = np.random.default_rng(length)
    rows = [(i, (rng.standard_normal(length) * 0.3).round(2).tolist(), int(rng.integers(4)) or None) for i in range(120)]
    rows += [(3, rows[5][1], 1), (None, rows[7][1], None), (None, rows[7][1], None)] + [(200 + i, [0.25] * length, 2) for i in range(60)]
    assert found(spark, rows) == brute_force(rows)


def test_few_rows_and_tests_of_components(spark):
    fine = [(5, [-0.1] * 16, None), (2, [0.1] * 16, 1), (9, [0.1001] * 16, 1)]
    odd = [(1, None, 1), (3, [None] + [0.5] * 15, 1), (4, [math.nan] * 16, 1), (6, [math.inf] + [0.0] * 15, 1), (7, [0.5] * 8, 1), (8, [], 1)]
    assert found(spark, fine + odd) == brute_force(fine)
    assert found(spark, odd[:4]) == []
    assert found(spark, [(1, [], None)]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"," * 0).hexdigest())]


@pytest.mark.parametrize("kind, most", [("float", 3e38), ("double", 1e300), ("double", 1e5)])
def test_any_magnitude_is_exact(spark, kind, most):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16) * (most / 9 if i % 3 == 0 else 0.5)], i % 2) for i in range(40)]
    assert found(spark, rows, kind) == brute_force(rows)


def test_clashing_columns_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    rows = [(i, [i / 64.0] * 8, i % 3 or None) for i in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, id int")
    assert sorted((tuple(r) for r in codes.compress(frame).collect()), key=repr) == brute_force(rows)
    assert codes.compress(frame.where(F.lit(False))).count() == 0
