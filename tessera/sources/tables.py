"""Loading tables and files as DataFrames. Schemas are read from Parquet or given; nothing is inferred from text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event envelope of an ingest drop: known columns, and the rest as text.
ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("review_status", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_broken", T.StringType()),
])
RSS_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "pubDate", "description")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) envelopes of a folder of JSON lines. Valid: parsed, with an id, a confidence in 0..1."""
    raw = spark.read.schema(ENVELOPE).option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").json(path)
    fine = F.col("_broken").isNull() & F.col("event_id").isNotNull() & F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    judged = raw.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    return judged.where("_fine").drop("_fine", "_broken"), judged.where("not _fine").drop("_fine")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS 2.0 files, with the publication time parsed; times that don't parse are null."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    day = F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return items.withColumn("published_at", F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss")))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, but columns ``keep`` hold their old values."""
    held = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    joined = new.join(held, key, "left")
    fresh = joined.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return fresh.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; below the warehouse where that is unset and the master
    is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet into a shared folder and read back."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A dimension from JSON lines, with its schema given."""
    return spark.read.schema(schema).json(path)


#: Sources by name: functions (spark, path) -> DataFrame of (event_id, title, published_at).
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def source(name: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        SOURCES[name] = f
        return f

    return register


@source("rss")
def _rss(spark: SparkSession, path: str) -> DataFrame:
    return rss_items(spark, path).select(F.col("guid").alias("event_id"), "title", "published_at")


@source("envelopes")
def _envelopes(spark: SparkSession, path: str) -> DataFrame:
    fine, _ = envelopes(spark, path)
    return fine.select("event_id", F.col("payload")["title"].alias("title"), F.try_to_timestamp("published_at").alias("published_at"))


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, path)
