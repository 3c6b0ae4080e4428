"""Grouped operators: facets, gap-filled buckets, record-field-value tables, digests, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """Money as whole cents: sums of these don't depend on the order of rows."""
    return F.round(x * 100).cast("bigint")


def with_zeros(counts: DataFrame, vocabulary: DataFrame, on: list[str], value: str) -> DataFrame:
    """A row for each entry of the vocabulary, zero where ``counts`` has none."""
    return vocabulary.join(counts, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def gap_filled(df: DataFrame, at: Column, unit: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by date_trunc(unit) with a row for every bucket between the first and the last, zeros where empty."""
    got = df.groupBy(F.date_trunc(unit, at.cast("timestamp")).alias("bucket")).agg(*[m.alias(n) for n, m in measures.items()])
    ends = got.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return spine.join(got, "bucket", "left").select("bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def facets(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(facet, value, n): counts by each dimension, from one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in dims.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def melt(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Record, field, value rows of numeric columns; nulls leave no row."""
    long = df.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value_num")) for c in cols])).alias("f"))
    return long.select(*key, "f.*").where("value_num is not null")


def pivot_back(facts: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per record with a column per field."""
    return facts.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.col("value_num"))).alias(f) for f in fields])


def digest(df: DataFrame, key: list[str]) -> DataFrame:
    """Order-free digest of each key's rows: count, and sum and xor of row hashes."""
    h = F.xxhash64(*[c for c in df.columns if c not in key])
    return df.select(*key, h.alias("h")).groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def precision_recall(judged: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall over rows with both sides known; ratios are null on zero."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    counts = judged.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    return counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
