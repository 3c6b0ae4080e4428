"""Scans from a high-water mark: records in folders by range of their ids, a mark that is kept, and a full pass now and then.

A store is a Parquet folder partitioned by ``range`` = id // WIDTH. A run reads the folders from the mark's on (partition
pruning) and, there, the rows above the mark; its work is written as a new folder of ``done`` before the mark moves, so a run that
fails is run again from the same mark. Each ``every``-th run is a full pass, which finds what came below the mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a folder.
WIDTH = 1_000_000
MARKS = "run int, mark long, full boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append(records: DataFrame, path: str, id_col: str, width: int = WIDTH) -> None:
    """Add records to a store. Rows without an id are left out."""
    laid = records.where(F.col(id_col).isNotNull()).withColumn("range", F.floor(F.col(id_col) / width).cast("long"))
    laid.repartition("range").write.partitionBy("range").mode("append").parquet(f"{path}/records")


def last_run(spark: SparkSession, path: str) -> tuple[int, int | None]:
    """(number, mark) of the last run that ended; (-1, None) before the first."""
    if not _exists(spark, f"{path}/marks"):
        return -1, None
    run = spark.read.schema(MARKS).parquet(f"{path}/marks").agg(F.max_by(F.struct("run", "mark"), "run").alias("r")).head().r
    return (run.run, run.mark) if run else (-1, None)


def above(spark: SparkSession, path: str, schema, id_col: str, mark: int | None, width: int = WIDTH) -> DataFrame:
    """Records with an id above the mark, all without one. Only folders from the mark's on are read."""
    rows = spark.read.schema(f"{schema}, range long").parquet(f"{path}/records")
    if mark is not None:
        rows = rows.where((F.col("range") >= mark // width) & (F.col(id_col) > mark))
    return rows.drop("range")


def run(spark: SparkSession, path: str, schema: str, id_col: str, work: Callable[[DataFrame], DataFrame], every: int = 10, width: int = WIDTH) -> DataFrame:
    """What ``work`` gives for the records that no run has done, from an ended run's mark on; written, listed and returned.

    work takes records and returns rows with ``id_col``. A full pass takes all records that aren't done (an anti-join with the
    ids of ``done``), so records that arrived with small ids are found, at latest after ``every`` - 1 other runs. Ties of an id are done together.
    """
    number, mark = last_run(spark, path)
    number += 1
    full = mark is None or number % every == 0
    highest = above(spark, path, schema, id_col, mark, width).agg(F.max(id_col)).head()[0]
    highest = mark if highest is None else highest
    records = above(spark, path, schema, id_col, None if full else mark, width).where(F.col(id_col) <= F.lit(highest))  # what arrives meanwhile is the next run's
    if full and number:
        kind = records.schema[id_col].dataType.simpleString()
        done = spark.read.schema(f"`{id_col}` {kind}, in_run int").parquet(f"{path}/done").where(F.col("in_run") < number).select(id_col).distinct()
        records = records.join(done, id_col, "left_anti")
    worked = work(records)
    out = f"{path}/done/in_run={number}"
    worked.write.mode("overwrite").parquet(out)
    spark.createDataFrame([(number, highest, full)], MARKS).write.mode("append").parquet(f"{path}/marks")
    return spark.read.schema(worked.schema).parquet(out)
