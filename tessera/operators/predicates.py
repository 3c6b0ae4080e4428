"""Row predicates and per-row rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_token(tokens: Column, wanted: list[str]) -> Column:
    """Whether an array of tokens holds any of the wanted ones."""
    return F.coalesce(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def half_open(ts: Column, low: str, high: str) -> Column:
    return (ts >= F.lit(low).cast("timestamp_ntz")) & (ts < F.lit(high).cast("timestamp_ntz"))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds, in the given order; rows are annotated, never dropped."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def first_rule(rules: dict[str, Column]) -> Column:
    """Name of the first rule that holds, null if none."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()])


def exact_else_prefix(df: DataFrame, col: str, wanted: str) -> DataFrame:
    """Rows equal to ``wanted`` if there are any, otherwise rows that start with it."""
    found = df.where(F.col(col).startswith(wanted))
    exact = found.agg(F.max(F.col(col) == wanted).alias("_any"))
    return found.crossJoin(F.broadcast(exact)).where((F.col(col) == wanted) | ~F.coalesce("_any", F.lit(False))).drop("_any")


def hidden(df: DataFrame, entries: DataFrame) -> DataFrame:
    """``df`` without rows that match an entry in all fields the entry fills (nulls of an entry match anything).

    Entries that fill the same fields are one equi-join; there are as many as ways to fill the few columns of an entry.
    """
    ways = entries.select(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in entries.columns])).alias("filled")).distinct().collect()
    for way in sorted(tuple(r.filled) for r in ways):
        if not way:
            return df.limit(0)  # an entry without fields hides everything
        others = [c for c in entries.columns if c not in way]
        some = entries
        for c in entries.columns:
            some = some.where(F.col(c).isNotNull() if c in way else F.col(c).isNull())
        df = df.join(some.drop(*others).distinct(), list(way), "left_anti")
    return df


def sliced(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """df with ``_slice``: slices in the order of a numeric or time column, nulls in the first. The bounds (at most ``parts``, else as
    many as shuffle partitions) are fixed before df is read again, so every reading and every task that is run again cuts alike."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(value, shares, 20 * parts)).head()[0] or [])) if shares else []
    step = max(int(len(bounds) ** 0.5), 1)
    below = lambda some: F.size(F.filter(some, lambda b: b < F.col(value)))
    known = F.array(*[F.lit(b) for b in bounds])
    coarse = below(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])) * step  # steps whose last bound lies below
    return df.withColumn("_slice", coarse + below(F.slice(known, coarse + 1, F.lit(step)))) if bounds else df.withColumn("_slice", F.lit(0))


def _ahead(cut: DataFrame, size: Column, largest_first: bool) -> Column:
    """Rows in the slices before that of a row. One number a slice comes to the driver, never a row."""
    sizes = dict(cut.groupBy("_slice").agg(size).collect())
    total, before = 0, {}
    for number in sorted(sizes, reverse=largest_first):
        before[number], total = total, total + sizes[number]
    numbers = [before.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    return F.get(F.array(*[F.lit(n).cast("bigint") for n in numbers]), F.col("_slice"))


def ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, place): rank of each value, largest first, ties alike. Distinct values are ranked in slices with running offsets, so no
    task orders all rows."""
    counts = sliced(df.groupBy(value).agg(F.count("*").alias("_n")), value)
    ahead = _ahead(counts, F.sum("_n"), True)
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_slice").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(value, (ahead + within + 1).alias("place"))


def row_numbers(df: DataFrame, by: str, *ties: Column) -> DataFrame:
    """df with ``place``, the row's number from 1 in the order of a column (``ties`` make it total), sorted slice by slice."""
    cut = sliced(df, by)
    ahead = _ahead(cut, F.count("*"), False)
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(F.col(by), *ties))
    return cut.withColumn("place", ahead + within).drop("_slice")


def semi_or_open(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Semi-join with a key set; an empty key set lets all rows pass."""
    known = keys.select(F.count("*").alias("_n"))
    inside = keys.select(*on).distinct().withColumn("_in", F.lit(True))
    joined = df.join(inside, on, "left").crossJoin(F.broadcast(known))
    return joined.where(F.col("_in") | (F.col("_n") == 0)).drop("_in", "_n")


def open_state(is_open: Column, last: Column, cut: Column) -> Column:
    """'open' while an open status isn't stale, else 'stale' or 'closed'."""
    return F.when(is_open & (last >= cut), "open").when(is_open, "stale").otherwise("closed")


def keep_top_one(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
