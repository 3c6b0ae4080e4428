"""Folds where the next step depends on what was kept before: copies, deals, rounds of work.

Rows of a key come to one task in order, from a sort that spills, as Arrow batches; the state between them is what a fold keeps open.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(df: DataFrame, key: list[str], order: list[str], reads: list[str], added: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """df with the columns ``added`` (DDL): step(state, *values of ``reads``) gives their values, row after row of a key."""
    work = df.withColumn("_key", F.to_json(F.array(*[F.col(k).cast("string") for k in key])))
    spread = work.repartition("_key").sortWithinPartitions("_key", *order)
    names = [c.split()[0] for c in added.split(", ")]
    kinds = [{"long": "Int64", "boolean": "boolean"}[c.split()[1]] for c in added.split(", ")]  # with nulls

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for k, *values in zip(frame["_key"], *[frame[c] for c in reads], strict=True):
                if k != now:
                    now, state = k, start()
                out.append(step(state, *values))
            yield frame.drop(columns="_key").assign(**{n: pd.array([o[i] for o in out], dtype=kinds[i]) for i, n in enumerate(names)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [added])
    return spread.mapInPandas(fold, schema)


def without_copies(df: DataFrame, key: list[str], at: str, id_col: str, gap: int) -> DataFrame:
    """Rows of a key that aren't within ``gap`` after the last row kept: a kept row starts its own span."""

    def step(state: dict, t) -> tuple:
        kept = "last" not in state or t - state["last"] > gap
        if kept:
            state["last"] = t
        return (kept,)

    return in_order(df, key, [at, id_col], [at], "_kept boolean", dict, step).where("_kept").drop("_kept")


#: Points of a candidate deal: equal price, equal kind, amount within a fifth. An announcement joins from NEW points, others from OLD.
PRICE, KIND, AMOUNT, NEW, OLD = 3, 2, 1, 5, 2
OPEN_DAYS = 120


def points(row: tuple, deal: dict) -> int:
    """How well (kind, amount, price) fits an open deal."""
    kind, amount, price = row
    return PRICE * (price == deal["price"]) + KIND * (kind == deal["kind"]) + AMOUNT * (abs(amount - deal["amount"]) <= 0.2 * max(amount, deal["amount"]))


def deals(df: DataFrame, key: list[str], at: str, id_col: str) -> DataFrame:
    """df (role, kind, amount, price) with deal and deal_two: numbers of the deals of a key that a release belongs to.

    A release joins the open deal with the most points, the newest of equals, if they are enough for its role; else it opens a
    deal. Deals close with a final close, or OPEN_DAYS days after their last release. A close of about the sum of two open
    deals, when it fits none better, belongs to both. Releases of a day come in the order announcement, upsize, close.
    """

    def step(state: dict, t, role, kind, amount, price) -> tuple:
        open_deals = state.setdefault("open", [])
        open_deals[:] = [d for d in open_deals if t - d["last"] <= OPEN_DAYS]
        need = NEW if role == "announcement" else OLD
        scored = [(points((kind, amount, price), d), d["n"], d) for d in open_deals]
        best = max(scored, key=lambda s: s[:2], default=(0, 0, None))
        two = None
        if role == "close" and best[0] < PRICE + KIND:
            pairs = [(a["n"], b["n"], a, b) for i, a in enumerate(open_deals) for b in open_deals[i + 1 :] if abs(a["amount"] + b["amount"] - amount) <= 0.02 * amount]
            if pairs:
                _, _, first, two = max(pairs, key=lambda p: p[:2])
                best = (need, first["n"], first)
        deal = best[2] if best[0] >= need else None
        if deal is None:
            state["n"] = state.get("n", 0) + 1
            deal = {"n": state["n"], "kind": kind, "amount": amount, "price": price}
            open_deals.append(deal)
        for d in (deal, two) if two else (deal,):
            d["last"] = t
            if role == "upsize":
                d["amount"] = amount
            if role == "close" and d in open_deals:
                open_deals.remove(d)
        return deal["n"], two["n"] if two else None

    rank = F.when(F.col("role") == "announcement", 0).when(F.col("role") == "upsize", 1).otherwise(2)
    return in_order(df.withColumn("_rank", rank), key, [at, "_rank", id_col], [at, "role", "kind", "amount", "price"], "deal long, deal_two long", dict, step).drop("_rank")


#: Rows of a task that sorts rows of keys.
TASK_ROWS = 500_000


def dealt(df: DataFrame, key: list[str], rows: int | None = None) -> DataFrame:
    """df with the rows of a key together, in as many partitions as keep about ``rows`` (TASK_ROWS) rows in each: what a task sorts
    doesn't grow with the table. No fewer than shuffle partitions; the rows are counted first."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / (rows or TASK_ROWS)))
    return df.repartition(parts, *key)


def near_chains(df: DataFrame, key: list[str], value: str, id_col: str, width: float) -> DataFrame:
    """df with ``chain``: rows of a key whose values, in order, follow within ``width`` of each other. Groups by the key, and by key and
    chain, need no other shuffle."""
    w = Window.partitionBy(*key).orderBy(value, id_col)
    fresh = F.when(F.col(value) - F.lag(value).over(w) <= width, 0).otherwise(1)
    return dealt(df, key).withColumn("_fresh", fresh).withColumn("chain", F.sum("_fresh").over(w)).drop("_fresh")


def filled_latest(df: DataFrame, key: list[str], order: Column, fill: list[str]) -> DataFrame:
    """One row per key: for each column its latest value that isn't null, and from_older, the columns that an older row gave."""
    last = F.max(order).alias("_top")
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fill]
    places = [F.max(F.when(F.col(c).isNotNull(), order)).alias(f"_at_{c}") for c in fill]
    rows = df.groupBy(*key).agg(last, *values, *places, F.count("*").alias("rows"))
    older = F.array_compact(F.array(*[F.when(F.col(f"_at_{c}") < F.col("_top"), F.lit(c)) for c in fill]))
    return rows.select(*key, *fill, "rows", F.array_join(older, ",").alias("from_older"))


def filled_chain(df: DataFrame, key: list[str], order: Column, source: str, fill: list[str], never: dict[str, Column] | None = None, stop: Column | None = None, meant: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: ``source`` of its newest row, ``fill`` with each blank filled by the newest row that has a value, ``rows``, and
    ``provenance``, an array of (field, source) for each field that an older row gave, in the order of ``fill``.

    never: a column isn't taken from rows where its condition holds. stop: rows older than the newest that fulfils it give nothing
    (that row itself still does). meant: where it holds in the newest row, its blank is meant and stays. Blank is null. A null key
    is a key. ``order`` is total within a key. Two aggregations that combine before their shuffle, no list of a key's rows.
    """
    df = df.withColumn("_order", order)
    if stop is not None:
        ends = df.where(F.coalesce(stop, F.lit(False))).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("_order").alias("_stop"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        df = df.join(ends, same, "left").drop(*[f"_{k}" for k in key])
        reach = F.col("_stop").isNull() | (F.col("_order") >= F.col("_stop"))
    else:
        reach = F.lit(True)
    none = F.lit(False)

    def giver(c: str) -> Column:
        fine = F.col(c).isNotNull() & reach & ~F.coalesce((never or {}).get(c, none), none)
        return F.when(fine, F.col("_order"))

    newest = F.max_by(F.struct(F.col(source).alias("id"), *[F.col(c).alias(f"own_{i}") for i, c in enumerate(fill)], *[F.coalesce((meant or {}).get(c, none), none).alias(f"meant_{i}") for i, c in enumerate(fill)]), "_order")
    given = [F.max_by(F.struct(F.col(c).alias("value"), F.col(source).alias("id")), giver(c)).alias(f"_from_{i}") for i, c in enumerate(fill)]
    rows = df.groupBy(*key).agg(newest.alias("_new"), *given, F.count("*").alias("rows"))
    blank = [F.col(f"_new.own_{i}").isNull() & ~F.col(f"_new.meant_{i}") & F.col(f"_from_{i}").isNotNull() for i in range(len(fill))]
    told = F.array_compact(F.array(*[F.when(b, F.struct(F.lit(c).alias("field"), F.col(f"_from_{i}.id").alias("source"))) for i, (c, b) in enumerate(zip(fill, blank))]))
    values = [F.when(b, F.col(f"_from_{i}.value")).otherwise(F.col(f"_new.own_{i}")).alias(c) for i, (c, b) in enumerate(zip(fill, blank))]
    return rows.select(*key, F.col("_new.id").alias(source), *values, "rows", told.alias("provenance"))


def greedy_pairs(labels: DataFrame, predicted: DataFrame, key: list[str], id_col: str, kind: str, amount: str) -> DataFrame:
    """(key, label_id, row_id, points): each label of a key, by id, takes the free predicted row with the most points (the smallest id of
    equals); row_id is null where none has any. Unpaired predictions have a null label_id.

    A pair has two points for an equal kind and two for an amount within a tenth. A key's predictions come before its labels
    in one sorted stream; they are what a fold holds, so they must fit a task (rows of one document, not of a corpus).
    """
    both = predicted.withColumn("_side", F.lit(0)).unionByName(labels.withColumn("_side", F.lit(1)))
    work = both.select(*key, id_col, kind, amount, "_side", F.to_json(F.array(*[F.col(k).cast("string") for k in key])).alias("_key"))
    spread = work.repartition("_key").sortWithinPartitions("_key", "_side", id_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema if f.name in key] + ["label_id long, row_id long, points long"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, values, free = None, None, {}
        for frame in frames:
            out = []
            for k, keys, i, a, b, side in zip(frame["_key"], frame[key].itertuples(index=False, name=None), frame[id_col], frame[kind], frame[amount], frame["_side"], strict=True):
                if k != now:
                    out += [(*values, None, j, 0) for j in free] if values else []
                    now, values, free = k, keys, {}
                if not side:
                    free[i] = (a, b)
                    continue
                scored = [(2 * (x == a) + 2 * (abs(y - b) <= 0.1 * max(y, b)), -j) for j, (x, y) in free.items()]
                best = max(scored, default=(0, 0))
                out.append((*keys, i, -best[1] if best[0] else None, best[0]))
                if best[0]:
                    del free[-best[1]]
            yield pd.DataFrame(out, columns=[*key, "label_id", "row_id", "points"]).astype({"label_id": "Int64", "row_id": "Int64"})
        if values:
            yield pd.DataFrame([(*values, None, j, 0) for j in free], columns=[*key, "label_id", "row_id", "points"]).astype({"label_id": "Int64", "row_id": "Int64"})

    return spread.mapInPandas(fold, schema)


def last_fitting(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with ``name``: the last earlier value of the key that differs by more than half a per cent and is within a factor of two.

    Of earlier rows only the last place of each distinct value can be the answer, so that is what the fold keeps.
    """

    def step(state: dict, v: int) -> tuple:
        found = next((w for w in reversed(state) if abs(v - w) * 200 > w and w <= 2 * v and v <= 2 * w), None)
        state.pop(v, None)
        state[v] = True
        return (found,)

    return in_order(df, key, order, [value], f"{name} long", dict, step)
