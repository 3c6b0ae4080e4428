"""Scoped refreshes against a whole recomputation, what they write, and the shadow check."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scoped as S


def totals(rows):
    return rows.groupBy("k", "l").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, l string, v long")


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).glob("rows/**/*.parquet")}


def test_refreshes_equal_whole_runs_and_write_touched_buckets_only(spark, tmp_path):
    path, dice = str(tmp_path), random.Random(2)
    rows = [(dice.choice([*range(40), None]), dice.choice(["x", "y", None]), dice.randrange(100)) for _ in range(400)]
    schema = totals(frame(spark, rows)).schema
    steps = [lambda r: r, lambda r: [*r, (3, "x", 5)], lambda r: [x for x in r if x[0] != 7], lambda r: [*r, (None, None, 1), (99, "z", 1)], lambda r: r, lambda r: []]
    for step in steps:
        rows, before = step(rows), files(path)
        done = S.refresh(frame(spark, rows), path, ["k", "l"], totals, buckets=16, shadow=0.5)
        got = sorted(map(str, S.published(spark, path, schema).collect()))
        assert got == sorted(map(str, totals(frame(spark, rows)).collect()))
        after = files(path)
        assert all(after[f] == t for f, t in before.items()), "files of an earlier generation changed"
        assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} <= set(map(str, range(16)))
        if step in (steps[1], steps[3]):
            assert done["written"] <= 2 and done["checked"] > 10
    assert done["changed"] > 50


def test_nothing_changed_writes_nothing(spark, tmp_path):
    path, rows = str(tmp_path), [(1, "a", 1), (2, "b", 2)]
    assert S.refresh(frame(spark, rows), path, ["k", "l"], totals, buckets=4) == {"gen": 0, "changed": 2, "written": 4, "checked": 0}
    before = files(path)
    done = S.refresh(frame(spark, rows[::-1]), path, ["k", "l"], totals, shadow=1.0)
    assert (done["gen"], done["changed"], done["written"], done["checked"]) == (0, 0, 0, 2) and files(path) == before


def test_the_shadow_check_finds_other_code(spark, tmp_path):
    path, rows = str(tmp_path), [(i, "a", i) for i in range(30)]
    S.refresh(frame(spark, rows), path, ["k", "l"], totals, buckets=4)
    before = files(path)
    other = lambda r: totals(r.withColumn("v", F.col("v") + 1))
    with pytest.raises(S.ShadowMismatch):
        S.refresh(frame(spark, [*rows, (50, "a", 1)]), path, ["k", "l"], other, shadow=1.0)
    assert files(path) == before
    assert S.refresh(frame(spark, [*rows, (50, "a", 1)]), path, ["k", "l"], totals)["changed"] == 1
