"""Shared pieces of the training-data operators: words, folds, scratch tables and ragged numpy helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text as long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; the split into learning and held-out rows."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def free_name(rows: DataFrame, base: str) -> str:
    """A column name that ``rows`` doesn't have (names don't differ by case alone)."""
    taken = {c.lower() for c in rows.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def protected(docs: DataFrame, keep: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``operator``, which sees all but ``keep`` under names that can't clash with its own."""
    inner = [c if c in keep else f"column {i}" for i, c in enumerate(docs.columns)]
    found = operator(docs.toDF(*inner))
    return found.select([found[f"`{a}`"].alias(c) for a, c in zip(inner, docs.columns, strict=True)])


_own_folder: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where the setting is absent a temporary folder is made and kept for the session, on one machine only (a local master):
    executors of a cluster would each write to their own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path  # lets drop_written() find it
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for nulls."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def in_slices(rows: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are Python objects at a time."""
    for batch in rows:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def release_memory() -> None:
    """Give what a task has freed back to the system; Python workers live on from task to task and from query to query."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc has it
        trim(0)


class Vocabulary(dict):
    """word -> dense number, given on first sight: ``list(map(v.__getitem__, words))``."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def ragged_positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0]..starts[0]+counts[0]-1, starts[1].. and so on, as one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def batches(rows: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One Arrow batch of the columns, none if they are empty."""
    if len(next(iter(rows.values()))):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def hash_share(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id, for samples that don't depend on partitions or order."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_ids(rows: DataFrame, by: str, id_col: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most for each value of ``by`` (a column of few values), chosen by a hash of the id, of rows whose
    ids differ.

    Only counts are gathered; each row decides by its hash, so a frequent value isn't collected in one task. The
    number kept varies around ``most`` as a binomial; a value with fewer rows keeps all.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by")
    picked = rows.join(F.broadcast(counts), F.col(by).eqNullSafe(F.col("_by")))
    return picked.where(hash_share(F.col(id_col), seed) * F.col("_n") < most).drop("_by", "_n")


def bounded_sample(rows: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """About ``most`` different rows at most for each value of ``by`` (a column of few values), chosen by a hash of the whole row.

    Equal rows are one, so neither many rows of one id nor many copies of a row fill the sample or empty it. How many different rows a value
    has is estimated by a sketch that combines before the shuffle; the number kept is within a tenth of ``most`` or of all. The
    same rows give the same sample, whatever their order and partitions.
    """
    rest = [c for c in rows.columns if c != by]
    marked = rows.withColumn("_unit", F.xxhash64(F.lit(seed), *rest))
    counts = marked.groupBy(by).agg(F.approx_count_distinct("_unit", 0.02).alias("_n")).withColumnRenamed(by, "_by")
    picked = marked.join(F.broadcast(counts), F.col(by).eqNullSafe(F.col("_by"))).where(hash_share(F.col("_unit"), seed) * F.col("_n") * 0.95 < most)
    return picked.groupBy(by, "_unit").agg(*[F.any_value(c).alias(c) for c in rest]).select(*rows.columns)
