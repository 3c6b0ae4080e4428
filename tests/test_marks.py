"""Runs from a mark: what they read, what they find, and that a run that failed is done again."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import marks as M

SCHEMA = "id long, v string"


def put(spark, path, ids):
    M.append(spark.createDataFrame([(i, f"v{i}") for i in ids], SCHEMA), path, "id", 10)


def go(spark, path, every=3, work=None):
    found = M.run(spark, path, SCHEMA, "id", work or (lambda r: r.select("id", F.upper("v").alias("v"))), every, 10)
    return sorted(r.id for r in found.collect())


def test_runs_take_what_is_above_the_mark_and_full_passes_the_rest(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, [1, 5, 25, None])
    assert go(spark, path) == [1, 5, 25] and M.last_run(spark, path) == (0, 25)
    put(spark, path, [3, 26, 31, 31])
    assert go(spark, path) == [26, 31, 31] and M.last_run(spark, path) == (1, 31)
    assert go(spark, path) == [] and M.last_run(spark, path) == (2, 31)
    put(spark, path, [2, 99])
    assert go(spark, path) == [2, 3, 99], "a full pass finds what came below the mark"
    assert go(spark, path) == [] and M.last_run(spark, path) == (4, 99)


def test_a_run_reads_only_folders_from_the_mark_on(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, range(100))
    rows = M.above(spark, path, SCHEMA, "id", 77, 10)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,77)]" in plan
    read = rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert {r.f.split("range=")[1].split("/")[0] for r in read} == {"7", "8", "9"}
    assert rows.count() == 22


def test_a_failed_run_is_done_again(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, [1, 2])
    with pytest.raises(Exception):
        go(spark, path, work=lambda r: r.select("id", F.raise_error(F.lit("lost"))))
    assert M.last_run(spark, path) == (-1, None)
    assert go(spark, path) == [1, 2]
