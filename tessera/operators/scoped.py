"""Published tables that are refreshed by key: only buckets with a changed key are written, and a sample of the rest is checked.

Layout of a folder: ``rows/gen=<n>/bucket=<b>`` and ``signatures/gen=<n>/bucket=<b>`` hold what generation n made of bucket b (keys by
hash), ``live`` the buckets (gen, bucket) of each generation that has ended. A reader takes the newest generation of each bucket, so it
never sees half a refresh, and files of buckets without a changed key stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import digest
from tessera.operators.marks import _exists

#: Buckets of a table, and the share of unchanged keys that each refresh computes anew.
BUCKETS, SHADOW = 64, 0.02
LIVE = "gen int, bucket int"
_SIGNATURE = ("n", "hash_sum", "hash_xor")


class ShadowMismatch(RuntimeError):
    """Keys whose input didn't change but whose published rows aren't what compute gives: compute doesn't work by key, or isn't the
    code that published them."""


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _live(spark: SparkSession, path: str) -> list:
    if not _exists(spark, f"{path}/live"):
        return []
    return spark.read.schema(LIVE).parquet(f"{path}/live").groupBy("bucket").agg(F.max("gen").alias("gen")).collect()


def _read(spark: SparkSession, path: str, what: str, schema, live: list) -> DataFrame:
    folders = [f"{path}/{what}/gen={r.gen}/bucket={r.bucket}" for r in live]
    folders = [f for f in folders if _exists(spark, f)]  # a bucket may have no rows left
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as the last refresh left it."""
    return _read(spark, path, "rows", schema, _live(spark, path))


def _write(rows: DataFrame, path: str, what: str, gen: int, key: list[str], buckets: int) -> None:
    laid = rows.withColumn("bucket", _bucket(key, buckets))
    laid.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/{what}/gen={gen}")


def _compared(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose digests differ."""
    named = b.select(*key, *[F.col(c).alias(f"_{c}") for c in _SIGNATURE])
    same = F.lit(True)
    for c in _SIGNATURE:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    on = None
    for k in key:
        here = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = here if on is None else on & here
    return a.alias("a").join(named.alias("b"), on, "full").where(~same).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key])


def _of_keys(rows: DataFrame, keys: DataFrame, key: list[str], how: str) -> DataFrame:
    """Rows of the keys (left_semi) or of all others (left_anti); null is a value of a key like others."""
    named = keys.toDF(*[f"_key {k}" for k in key])
    on = None
    for k in key:
        here = rows[k].eqNullSafe(named[f"_key {k}"])
        on = here if on is None else on & here
    return rows.join(named, on, how)


def refresh(new: DataFrame, path: str, key: list[str], compute: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, shadow: float = SHADOW) -> dict:
    """Bring the table of ``compute(new)`` up to date: {"gen", "changed", "written", "checked"}.

    compute works by key and keeps the key columns. Keys are compared by digests of their input rows with those stored; changed,
    new and gone ones are computed, and their buckets written as a new generation. A share of the unchanged keys, others each time, is
    computed too and compared with what is published: ShadowMismatch if one differs, before anything is written.
    Nothing is written where nothing changed. The number of buckets is fixed by the first run. A run that fails isn't live
    and can be run again.
    """
    spark = new.sparkSession
    live = _live(spark, path)
    gen = max((r.gen for r in live), default=-1) + 1
    now = digest(new, key).select(*key, *_SIGNATURE)
    if not live:
        _write(compute(new), path, "rows", 0, key, buckets)
        _write(now, path, "signatures", 0, key, buckets)
        spark.range(buckets).select(F.lit(0).alias("gen"), F.col("id").cast("int").alias("bucket")).write.mode("append").parquet(f"{path}/live")
        return {"gen": 0, "changed": now.count(), "written": buckets, "checked": 0}
    buckets = len(live)
    stored = _read(spark, path, "signatures", now.schema, live)
    staged = f"{path}/staged/gen={gen}"
    _compared(now, stored, key).write.mode("overwrite").parquet(staged)
    keys = spark.read.schema(now.select(*key).schema).parquet(staged)
    computed = compute(new)
    rows = _read(spark, path, "rows", computed.schema, live)
    share = F.pmod(F.xxhash64(F.lit(gen), *key), F.lit(1 << 20)) < int(shadow * (1 << 20))
    sample = _of_keys(now.where(share).select(*key), keys, key, "left_anti")
    again = compute(_of_keys(new, sample, key, "left_semi"))
    wrong = _compared(digest(again, key), digest(_of_keys(rows, sample, key, "left_semi").select(*computed.columns), key), key)
    if found := wrong.limit(5).collect():
        raise ShadowMismatch(f"unchanged keys differ from what is published: {[tuple(r) for r in found]}")
    touched = sorted(r.b for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect())
    if touched:
        here = _bucket(key, buckets).isin(touched)
        kept = _of_keys(rows.where(here), keys, key, "left_anti").select(*computed.columns)
        fresh = compute(_of_keys(new, keys, key, "left_semi"))
        _write(kept.unionByName(fresh), path, "rows", gen, key, buckets)
        _write(now.where(here), path, "signatures", gen, key, buckets)
        spark.createDataFrame([(gen, b) for b in touched], LIVE).write.mode("append").parquet(f"{path}/live")
    return {"gen": gen if touched else gen - 1, "changed": keys.count(), "written": len(touched), "checked": sample.count()}
