"""A stored inverted index: posting lists by term in files of disjoint term ranges, with a small dictionary of the files.

Layout of a folder: ``postings/gen=<n>`` holds (term, block, ids, n): the ids of one block of documents that hold a term, sorted;
each generation is cut by ranges of terms, one range a file. ``files`` holds (gen, path, first, last, bytes) of each file, so that a
prefix reads only the files that its range touches. ``changes/gen=<n>`` holds the documents that generation replaces or
removes. Building shuffles the distinct words of each document to its block, where they become lists, and the lists to their
ranges; a refresh writes only what changed; a search never sees a text. A term may have several lists in a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.measures import let
from tessera.functions.text import words
from tessera.sources.tables import stored

#: Documents of a block: posting lists of a term are cut by id, so that no list grows with the table. Postings of a file.
BLOCK, PER_FILE = 4096, 2_000_000
#: Words of a document that travel in one row, rows that a task splits at once, and postings it makes lists of at once.
ROW_WORDS, ROWS, AT_ONCE = 1024, 1024, 2_000_000
FILES = "gen int, path string, first string, last string, bytes long"
POSTINGS = "term string, block long, ids array<bigint>, n int"


def _block(doc_id: Column) -> Column:
    return F.floor(doc_id / BLOCK).cast("long")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def generations(spark: SparkSession, path: str) -> int:
    """Number of generations of an index, 0 if there is none."""
    return spark.read.schema(FILES).parquet(f"{path}/files").agg(F.coalesce(F.max("gen") + 1, F.lit(0))).head()[0] if _exists(spark, f"{path}/files") else 0


def _lists(ids: np.ndarray, blocks: np.ndarray, held: list[pa.ListArray]) -> pa.RecordBatch:
    """(term, block, ids, n) from rows of words: ``ids`` and ``blocks`` are of the rows."""
    terms = pa.concat_arrays([h.flatten() for h in held]).dictionary_encode()
    sizes = np.concatenate([h.value_lengths().to_numpy() for h in held])
    unique, first, row = np.unique(ids, return_index=True, return_inverse=True)
    keys = np.sort(terms.indices.to_numpy().astype("int64") * len(unique) + np.repeat(row, sizes))  # by term, then id
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    code, at = np.divmod(keys, max(1, len(unique)))
    block = blocks[first][at]
    new = np.ones(len(keys), bool)
    new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    offsets = np.append(starts, len(keys)).astype("int32")
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unique[at]))
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[starts])), pa.array(block[starts]), lists, pa.array(np.diff(offsets))], ["term", "block", "ids", "n"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists from rows (id, block, words joined by blanks), of about AT_ONCE postings at a time."""
    ids, blocks, held, n = [], [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            ids.append(part.column(0).to_numpy())
            blocks.append(part.column(1).to_numpy())
            held.append(pc.split_pattern(part.column(2), " "))
            n += len(held[-1].flatten())
            if n >= AT_ONCE:
                yield _lists(np.concatenate(ids), np.concatenate(blocks), held)
                ids, blocks, held, n = [], [], [], 0
    if held:
        yield _lists(np.concatenate(ids), np.concatenate(blocks), held)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, first, last, bytes) of the files of a folder. They are sorted: only the first and the last row of each are compared."""
    rows = spark.read.schema(POSTINGS).parquet(folder).select("term", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_size").alias("bytes"))
    ends = rows.groupBy("path").agg(F.max("row").alias("end"), F.max("bytes").alias("bytes"))
    edges = rows.drop("bytes").join(F.broadcast(ends), "path").where((F.col("row") == 0) | (F.col("row") == F.col("end")))
    return edges.groupBy("path").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.max("bytes").alias("bytes"))


def _write(docs: DataFrame, path: str, gen: int) -> None:
    """Postings of docs (id, text) as a new generation, then its lines of the dictionary: what isn't listed isn't read."""
    spark = docs.sparkSession
    cut = lambda ws: F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(1), F.size(ws), F.lit(ROW_WORDS)), lambda i: F.array_join(F.slice(ws, i, ROW_WORDS), " ")))
    rows = docs.select("id", _block(F.col("id")).alias("block"), F.explode(let(F.array_distinct(words(F.col("text"))), cut)).alias("words"))
    dealt = rows.repartition(max(1, math.ceil(docs.count() / BLOCK)), "block")
    lists = stored(dealt.mapInArrow(_listed, POSTINGS), "lists")  # ranges are found by a look at all lists
    parts = max(1, math.ceil((lists.agg(F.sum("n")).head()[0] or 0) / PER_FILE))
    folder = f"{path}/postings/gen={gen}"
    lists.repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(folder)
    itself = spark.range(1).select(*[F.lit(None).cast(k).alias(n) for n, k in (("path", "string"), ("first", "string"), ("last", "string"), ("bytes", "long"))])  # a generation may have no postings
    _lines(spark, folder).unionByName(itself).select(F.lit(gen).alias("gen"), "path", "first", "last", "bytes").write.mode("append").parquet(f"{path}/files")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """An index of all documents in a new folder. Rows of one id are one document; null texts have no words; null ids are left out."""
    if generations(docs.sparkSession, path):
        raise ValueError(f"{path} holds an index: refresh it")
    _write(_texts(docs, id_col, text_col), path, 0)


def refresh(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Changed documents as a new generation: all that the index held of their ids is void. A null text removes its document.

    Only the postings of ``docs`` are written. A refresh that failed before its end isn't listed and can be run again.
    """
    gen = generations(docs.sparkSession, path)
    rows = _texts(docs, id_col, text_col)
    rows.select("id").distinct().select("id", _block(F.col("id")).alias("block")).write.mode("overwrite").parquet(f"{path}/changes/gen={gen}")
    _write(rows, path, gen)


def files_of(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame:
    """Lines of the dictionary whose terms a prefix can touch."""
    touched = F.lit(False)
    for prefix in prefixes:
        touched |= (F.col("last") >= prefix) & ((F.col("first") < prefix) | F.startswith("first", F.lit(prefix)))
    return spark.read.schema(FILES).parquet(f"{path}/files").where(touched)


def _postings(spark: SparkSession, path: str, prefixes: list[str]) -> DataFrame | None:
    """(prefix, block, ids) by generation of all terms that begin with a prefix, void ids out; None if no file has any."""
    chosen = files_of(spark, path, prefixes).select("gen", "path").collect()
    if not chosen:
        return None
    found = None
    for gen in sorted({r.gen for r in chosen}):
        rows = spark.read.schema(POSTINGS).parquet(*[r.path for r in chosen if r.gen == gen])
        begins = F.lit(False)
        for prefix in prefixes:
            begins |= F.startswith("term", F.lit(prefix))
        rows = rows.where(begins).select("term", "block", "ids", F.lit(gen).alias("gen"))
        found = rows if found is None else found.unionByName(rows)
    of = F.explode(F.array_compact(F.array(*[F.when(F.startswith("term", F.lit(p)), F.lit(p)) for p in prefixes])))
    found = found.select(of.alias("prefix"), "block", "gen", "ids").groupBy("block", "prefix", "gen").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    last = generations(spark, path) - 1
    if last > 0:
        changed = spark.read.schema("id long, block long, gen int").parquet(f"{path}/changes").where(F.col("gen") <= last)
        void = changed.groupBy("block", "id").agg(F.max("gen").alias("gen")).groupBy("block").agg(F.collect_list(F.struct("id", "gen")).alias("void"))
        kept = F.array_except("ids", F.transform(F.filter("void", lambda v: v["gen"] > F.col("gen")), lambda v: v["id"]))  # once for a prefix, not for each term
        found = found.join(void, "block", "left").withColumn("ids", F.when(F.col("void").isNull(), F.col("ids")).otherwise(kept))
    return found.select("prefix", "block", "ids")


def search(spark: SparkSession, path: str, prefixes: list[str], limit: int | None = 200) -> DataFrame:
    """(doc_id) of documents in which each prefix begins some word, largest ids first; all of them where ``limit`` is None.

    Lists are intersected block by block, the shortest first: a block that one prefix lacks is done without its other lists,
    and no list is larger than a block. An empty prefix is in every document with a word; no prefix finds nothing.
    """
    prefixes = sorted({p.lower() for p in prefixes})
    rows = _postings(spark, path, prefixes) if prefixes else None
    if rows is None:
        return spark.createDataFrame([], "doc_id long")
    lists = rows.groupBy("block", "prefix").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    blocks = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists")).where(F.size("lists") == len(prefixes))
    both = F.aggregate(F.slice("lists", 2, len(prefixes)), F.get("lists", F.lit(0))["ids"], lambda acc, x: F.array_intersect(acc, x["ids"]))
    found = blocks.select(F.explode(both).alias("doc_id"))
    return found if limit is None else found.orderBy(F.desc("doc_id")).limit(limit)
