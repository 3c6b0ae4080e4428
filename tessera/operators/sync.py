"""Differences between versions of a table, and refreshing only the keys whose input changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import digest


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per distinct row: kept, inserted, deleted copies. Both sides are counted first, so copies cost nothing."""
    cols = new.columns
    a = old.select(*cols, F.lit(1).alias("_old"), F.lit(0).alias("_new"))
    b = new.select(*cols, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    n = a.unionAll(b).groupBy(*cols).agg(F.sum("_old").alias("_o"), F.sum("_new").alias("_n"))
    return n.select(*cols, F.least("_o", "_n").alias("kept"), F.greatest(F.col("_n") - F.col("_o"), F.lit(0)).alias("inserted"), F.greatest(F.col("_o") - F.col("_n"), F.lit(0)).alias("deleted"))


def keyed_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): insert, replace or delete of a table with a primary key; unchanged keys are left out."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.xxhash64(*rest).alias("_a"))
    b = new.select(*key, F.xxhash64(*rest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_a") != F.col("_b"), "replace")
    return a.join(b, key, "full").select(*key, change.alias("change")).where("change is not null")


def changed_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows differ as a multiset between two inputs."""
    a, b = digest(old, key), digest(new, key)
    named = b.select(*key, *[F.col(c).alias(f"_{c}") for c in ("n", "hash_sum", "hash_xor")])
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("hash_sum").eqNullSafe(F.col("_hash_sum")) & F.col("hash_xor").eqNullSafe(F.col("_hash_xor"))
    return a.join(named, key, "full").where(~same).select(*key)


def refreshed(published: DataFrame, old: DataFrame, new: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute(new)``, made by recomputing only the changed keys of ``published`` = compute(old). compute works by key."""
    keys = changed_keys(old, new, key)
    return published.join(keys, key, "left_anti").unionByName(compute(new.join(keys, key, "left_semi")))


def signatures(rows: DataFrame, key: list[str]) -> DataFrame:
    """What is stored of an input beside what was published from it: a digest per key."""
    return digest(rows, key)


def refreshed_from(published: DataFrame, stored: DataFrame, new: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute(new)`` from the published table and the stored signatures of its input; the old input isn't read again."""
    now = digest(new, key)
    named = stored.select(*key, *[F.col(c).alias(f"_{c}") for c in ("n", "hash_sum", "hash_xor")])
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("hash_sum").eqNullSafe(F.col("_hash_sum")) & F.col("hash_xor").eqNullSafe(F.col("_hash_xor"))
    keys = now.join(named, key, "full").where(~same).select(*key)
    return published.join(keys, key, "left_anti").unionByName(compute(new.join(keys, key, "left_semi")))


def rebuild_steps(stored: DataFrame, now: DataFrame, key: list[str], age_hours: Column, forced: int) -> DataFrame:
    """(key, step): rebuild where the fingerprint changed, forced where it didn't but the last build is ``forced`` hours old, else skip."""
    rest = [c for c in now.columns if c not in key]
    same = None
    joined = now.join(stored.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], "built_at"), key, "full")
    for c in rest:
        equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = equal if same is None else same & equal
    return joined.select(*key, F.when(~same, "rebuild").when(age_hours >= forced, "forced").otherwise("skip").alias("step"))
