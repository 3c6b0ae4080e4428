"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its words should have: a whole part that every
document gets, and a fraction that is rounded. Rounding pairs two documents, draws which of them grows, and moves
words (fraction times size) from the other until one fraction is 0 or 1, so that a source's expected words never
change. Blocks of a thousand documents are rounded on their own, longest first; each leaves one open document, and the
open documents are paired up a tree of fixed depth. Only the very last one of a source is drawn by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words, protected, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Documents of a leaf block, and open documents that one node of the tree above pairs.
LEAF, FAN_IN = 1024, 4096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same rows with ``target``: words that the mix should take from each source.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` times all words; no target
    is above ``cap`` times its source, and what is above goes to the others by weight. With sources in order of cap over
    weight, the level that fills all targets is the largest of (words left when the first k are full) / (weight left).
    One row per source is all this holds, ordered in one task: sources are names of collections, thousands at most, not hosts
    of pages.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.select("source", "source_size", F.least(F.col("weight") * F.col("level"), F.col("most")).alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions p, keeping the sum of p * size but for one open entry; (p, index of that entry or -1).

    Entries are paired in order. Entries without words hold no mass and are drawn by themselves.
    """
    p = p.astype(float).tolist()
    size = size.tolist()
    draws = rng.random(len(p)).tolist()
    i = -1
    for j in range(len(p)):
        if not 1e-12 < p[j] < 1 - 1e-12:
            p[j] = float(round(p[j]))
        elif not size[j]:
            p[j] = float(draws[j] < p[j])
        elif i < 0:
            i = j
        else:
            grow = min((1 - p[i]) * size[i], p[j] * size[j])
            shrink = min(p[i] * size[i], (1 - p[j]) * size[j])
            move = grow if draws[j] * (grow + shrink) < shrink else -shrink
            p[i] += move / size[i]
            p[j] -= move / size[j]
            open_i, open_j = (1e-12 < p[k] < 1 - 1e-12 for k in (i, j))
            for k, is_open in ((i, open_i), (j, open_j)):
                if not is_open:
                    p[k] = float(round(p[k]))
            i = i if open_i else j if open_j else -1
    return np.array(p), i


def _node(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "id_key", "text_hash"], ascending=[False, True, True], kind="stable", ignore_index=True)
        source, block = pdf["source"].iloc[0], int(pdf["block"].iloc[0])
        name = b"\0" if pd.isna(source) else b"\1" + source.encode()
        rng = np.random.default_rng([seed, zlib.crc32(name), block])
        p, at = pivotal(pdf["words"].to_numpy(), pdf["p"].to_numpy(), rng)
        is_open = np.zeros(len(p), bool)
        if at >= 0 and last:
            p[at] = float(rng.random() < p[at])
        elif at >= 0:
            is_open[at] = True
        return pdf.assign(p=p, open=is_open)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 20) -> DataFrame:
    """How many copies of each document the mix takes.

    One row per distinct (id, text, source) with n_rows, size (words of one row), source_size, target (of its source) and
    copies (of each of its rows): id_col, source_col, text_hash, n_rows, size, source_size, target, copies. Repeated rows
    are one unit and share a decision, so reruns agree; a source's words miss its target by its largest unit at most, about. Null texts have size 0; a null source is a source; null ids are
    units by their text. Other columns aren't read. Empty in, empty out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), n_words(F.col(text_col)).alias("size"))
    units = written(rows.groupBy("id", "source", "text_hash", "size").agg(F.count("*").alias("n_rows")), "mix-units")
    units = units.withColumn("words", F.col("size") * F.col("n_rows"))
    sources = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_units"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    sources = sources.join(targets.withColumnRenamed("source", "s").drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumnsRenamed({"source": "s"}).withColumn("rate", rate)
    units = units.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = units.withColumns({"whole": F.floor("rate"), "p": F.col("rate") - F.floor("rate"), "open": F.lit(True), "id_key": F.coalesce(F.col("id").cast("string"), F.lit(""))})
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_units") / LEAF))
    level = units.withColumn("block", F.pmod(F.xxhash64("id", "text_hash"), leaves))
    done = None
    for depth in range(3):  # LEAF * FAN_IN * FAN_IN units of a source
        last = depth == 2
        if depth:
            level = level.withColumn("block", F.lit(0).cast("long") if last else F.floor(F.col("block") / FAN_IN))
        rounded = level.groupBy("source", "block").applyInPandas(_node(seed + depth, last), level.schema)
        rounded = rounded if last else written(rounded, "mix-level")
        closed = rounded if last else rounded.where("not open")
        done = closed if done is None else done.union(closed)
        level = rounded.where("open")
    copies = (F.col("whole") + F.round("p").cast("long")).cast("long")
    return done.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "text_hash", "n_rows", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as mix() takes it, with the columns of ``docs``, whatever their names."""

    def take(rows: DataFrame) -> DataFrame:
        taken = mix(rows, id_col, text_col, source_col, **options).where("copies > 0")
        taken = taken.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("text_hash").alias("_hash"), F.col("copies").alias("_copies"))
        same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & (F.xxhash64(text_col) == F.col("_hash"))
        return rows.join(taken.hint("shuffle_hash"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))

    return protected(docs, (id_col, text_col, source_col), take)
