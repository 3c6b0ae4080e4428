"""Ordered operators over one key: sessions, latest rows, filling, change history, first reports, keepers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionise(df: DataFrame, key: str, at: str, id_col: str, gap: int) -> DataFrame:
    """df with session (number within the key, from 1), started by a gap over ``gap``."""
    w = Window.partitionBy(key).orderBy(at, id_col)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def chain_columns(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds chain_items, chain_first (least of the first order column) and latest (the last row in order)."""
    whole = Window.partitionBy(*group)
    last = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])) == 1
    return df.withColumns({"chain_items": F.count("*").over(whole), "chain_first": F.min(order[0]).over(whole), "latest": last})


def fill_forward(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Null columns take the last earlier value of the key; filled_from lists the columns that did."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    marks = F.array(*[F.when(F.col(f"_was_{c}").isNull() & F.col(c).isNotNull(), F.lit(c)) for c in cols])
    return df.withColumns({f"_was_{c}": F.col(c) for c in cols}).withColumns(filled).withColumn("filled_from", F.filter(marks, lambda x: x.isNotNull())).drop(*[f"_was_{c}" for c in cols])


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Only the rows whose value differs from the row before of the key, with previous and step (from 1)."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = df.withColumn("previous", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    kept = kept.where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("previous")))
    return kept.withColumn("step", F.row_number().over(w)).drop("_n")


def first_reports(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Only the first row of each key; a plain min over a struct, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in [*order, *[c for c in rest if c not in order]]])


def latest_group_rows(df: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """All rows of the group that is last by (order, group) within the key."""
    last = df.groupBy(key).agg(F.max(F.struct(order, group)).alias("_m")).select(key, F.col(f"_m.{group}").alias(group))
    return df.join(last, [key, group])


def keeper(df: DataFrame, cluster: list[str], order: list[Column]) -> DataFrame:
    """df with keeper: the row that stays of each cluster, and cluster_size."""
    w = Window.partitionBy(*cluster)
    return df.withColumns({"cluster_size": F.count("*").over(w), "keeper": F.row_number().over(w.orderBy(*order)) == 1})
