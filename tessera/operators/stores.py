"""Sinks as pure transforms: envelopes, undo logs, stable ids, renames, soft deletes, feed gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.measures import let

#: Names of a dictionary that are sent to every executor at most; beyond, they meet the words by a shuffle.
BROADCAST_ROWS = 200_000


def envelopes(df: DataFrame, id_col: str, kind: Column) -> DataFrame:
    """event_id, event_type and the other columns as a JSON payload."""
    rest = [c for c in df.columns if c != id_col]
    return df.select(F.col(id_col).alias("event_id"), kind.alias("event_type"), F.to_json(F.struct(*rest)).alias("payload"))


def removed(df: DataFrame, gone: Column, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, undo log): each removed row is kept whole as JSON."""
    gone = F.coalesce(gone, F.lit(False))
    return df.where(~gone), df.where(gone).select(F.col(id_col).alias("removed_id"), F.to_json(F.struct(*df.columns)).alias("row"))


def restored(stay: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of an undo log put back."""
    return stay.unionByName(log.select(F.from_json("row", stay.schema).alias("r")).select("r.*"))


def stable_ids(rows: DataFrame, content: list[str], known: DataFrame) -> DataFrame:
    """rows with surrogate_id: that of ``known`` (content columns, surrogate_id) where it has the content, else new ones.

    New ids follow the largest known one in order of a content hash (the first 60 bits of md5). The hash space is cut in 1,024 parts with running
    offsets, so no task orders all new rows.
    """
    joined = rows.join(known, content, "left")
    fresh = joined.where("surrogate_id is null").select(*content).distinct().withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", *content).cast("binary")), 1, 15), 16, 10).cast("bigint")).withColumn("_part", F.shiftright("_h", 50))
    top = known.agg(F.coalesce(F.max("surrogate_id"), F.lit(0)).alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = fresh.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", *content))
    given = fresh.join(F.broadcast(ahead), "_part").crossJoin(F.broadcast(top)).select(*content, (F.col("_top") + F.col("_ahead") + place).alias("_new"))
    return joined.join(given, content, "left").withColumn("surrogate_id", F.coalesce("surrogate_id", "_new")).drop("_new")


def renamed(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    """Values of ``col`` by a rename table (old, new); values that aren't in it stay."""
    return df.join(names, F.col(col) == F.col("old"), "left").withColumn(col, F.coalesce("new", col)).select(*df.columns)


def feed_gaps(feeds: DataFrame, key: str, order: str, ids: str) -> DataFrame:
    """Full reads of a feed that share no id with the one before: something was missed in between."""
    w = Window.partitionBy(key).orderBy(order)
    seen = feeds.withColumn("_before", F.lag(ids).over(w))
    return seen.where(F.col("_before").isNotNull() & ~F.arrays_overlap("_before", ids)).drop("_before")


def dictionary_matches(texts: DataFrame, id_col: str, words: Column, names: DataFrame, longest: int) -> DataFrame:
    """(id, name, at): names (column ``name``, words joined by a blank) in texts, longest first, without overlaps.

    Runs of 1..longest words are built inside the text's array, so words aren't shuffled to meet their neighbours, and joined with
    the names, which are broadcast up to BROADCAST_ROWS of them; only finds go on. A find is dropped when a longer or earlier
    one covers its place: it isn't the longest that starts there, or an earlier longest one reaches over it.
    """

    def runs(ws: Column) -> Column:
        each = lambda n: F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(ws, i + 1, n), " ").alias("name")))
        none = F.array().cast("array<struct<at: int, n: int, name: string>>")
        return F.concat(*[F.when(F.size(ws) >= n, each(n)).otherwise(none) for n in range(1, longest + 1)])

    w = Window.partitionBy(id_col).orderBy("at")
    spread = texts.select(id_col, F.explode(let(words, runs)).alias("g")).select(id_col, "g.*")
    wanted = names.select("name").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    found = spread.join(wanted, "name").groupBy(id_col, "at").agg(F.max("n").alias("n"), F.max_by("name", "n").alias("name"))
    covered = F.max(F.col("at") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_end", covered).where(F.col("_end").isNull() | (F.col("_end") <= F.col("at"))).select(id_col, "name", "at")


def rewritten(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """References in ``col`` by a map (old, new); references that it doesn't have become null."""
    return df.join(ids.select("old", "new").distinct(), F.col(col) == F.col("old"), "left").withColumn(col, F.col("new")).select(*df.columns)


def gaps_filled(first: DataFrame, second: DataFrame, key: list[str], how: str) -> DataFrame:
    """Rows of ``first`` with their null columns from ``second``, and rows of ``second`` for keys that first doesn't have; ``how`` is own,
    filled or other."""
    rest = [c for c in first.columns if c not in key]
    named = second.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_second"))
    joined = first.withColumn("_first", F.lit(True)).join(named, key, "full")
    gap = F.lit(False)
    for c in rest:
        gap |= F.col(c).isNull() & F.col(f"_{c}").isNotNull()
    step = F.when(F.col("_first").isNull(), "other").when(gap, "filled").otherwise("own")
    return joined.select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in rest], step.alias(how))
