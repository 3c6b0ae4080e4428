"""From raw documents to packed sequences: five operators in a row, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, simhash, substring
from tessera.llm.common import drop_written, protected, written


def _rewritten(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after an operator that changes texts; n_chars, where there is one, follows the text."""
    found = protected(docs, ("doc_id", "text"), operator)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines.

    Null, empty and short texts are rejected. Rows with null or equal ids and repeated rows are judged one by one; other
    columns pass through, also those named like a measure of the rules. Empty in, empty out.
    """
    return _rewritten(docs, lambda rows: quality.apply_rules(rows).where("kept"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, null ids last, ties by a hash of the text.

    Of repeated rows one stays. Texts without words are copies of each other. Other columns pass through. Empty in, empty out.
    """
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that an earlier place has: under a smaller id, or earlier in the text.

    A null id comes last; rows of one id are one document. Null texts stay null, texts below a window stay as they are, a
    text may become empty. Other columns pass through. Empty in, empty out.
    """
    return _rewritten(docs, substring.dedup_substrings)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source. Null and empty texts have no words; they are drawn like others. Repeated rows share one
    decision, so reruns agree. Other columns pass through. Empty in, empty out.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    Null and empty texts are one piece of the end id; repeated rows and null ids are packed one by one. Only id and text are
    read. Empty in, empty out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", source_mixing),
    ("packing", pack),
]

#: Near-dedup components, drawn copies and tokenizer ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_written(before)  # nothing reads a stage's input once its result is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
