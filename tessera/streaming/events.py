"""Structured Streaming over event folders: seen-set dedup, late copies, tumbling and session windows, guarded ingest.

All take a streaming (or batch) frame with event_id, user_id, ts; state is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LATE = "30 days"


def stream(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive, with ``at`` as the event time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def unseen(events: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """First arrival of each key; a key is remembered for ``late`` of event time."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, width: str, by: list[str], late: str = LATE) -> DataFrame:
    """Events per window and group."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *by, "n")


def sliding(events: DataFrame, width: str, step: str, late: str = LATE) -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "n")


def sessions(events: DataFrame, gap: str, by: str, late: str = LATE) -> DataFrame:
    """Sessions of a key that end ``gap`` after their last event."""
    grouped = events.withWatermark("at", late).groupBy(F.session_window("at", gap), by)
    return grouped.agg(F.count("*").alias("items")).select(by, F.col("session_window.start").alias("first_at"), "items")


def guarded(batch: DataFrame, guards: list[tuple[str, Column]]) -> DataFrame:
    """Ingest guards in order: refused_by is the first one whose condition a row breaks, null for rows that pass."""
    return batch.withColumn("refused_by", F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in guards]))


def merging_sink(path_of: Callable[[int], str], key: list[str], better: Column, keep: list[str], versions: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that merges each batch into a versioned Parquet table: version n is n - 1 with the batch merged.

    Of the stored row and those of the batch the one with the largest ``better`` stays for a key, the stored one of equals, so the
    result doesn't depend on how rows fall into batches (where ``better`` tells rows apart). Stored values of ``keep`` win over new ones. A batch that is run
    again writes the same version again. Versions before the last ``versions`` are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        rows = batch.select(*batch.columns, F.lit(1).alias("_new"))
        if number:
            rows = rows.unionByName(spark.read.parquet(path_of(number - 1)).withColumn("_new", F.lit(0)))
        picked = [F.max_by(F.struct(*rest), F.struct(better.alias("b"), (1 - F.col("_new")).alias("old"))).alias("r")]
        first = F.min_by(F.struct(*keep), F.struct("_new", better.alias("b"))) if keep else None
        held = [F.when(F.min("_new") == 0, first).alias("h")] if keep else []
        merged = rows.groupBy(*key).agg(*picked, *held)
        columns = [F.when(F.col("h").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(f"r.{c}")).alias(c) if c in keep else F.col(f"r.{c}").alias(c) for c in rest]
        merged.select(*key, *columns).write.mode("overwrite").parquet(path_of(number))
        if number >= versions:
            path = spark._jvm.org.apache.hadoop.fs.Path(path_of(number - versions))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return write
