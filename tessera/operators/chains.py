"""Stateful folds over the rows of one key, where the next step depends on all open groups so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lifecycle(df: DataFrame, key: list[str], at: str, id_col: str, stage: str, amount: str, terminal: list[str], gap: int, reopen: int) -> DataFrame:
    """df with chain (number within the key), chain_items, first_at, latest, closed.

    A row joins the newest chain whose last row is at most ``gap`` before it and that isn't closed, or closed at most
    ``reopen`` before with the same stage; otherwise it starts a chain. A terminal stage closes its chain. A key's rows
    come as Arrow batches in (at, id) order from a sort that spills, and the fold keeps only open chains, so a key with very
    many rows doesn't have to fit in memory. They are one task, though: each step depends on all before it. Null is a value
    of a key like others.
    """
    work = df.withColumn("_key", F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])))
    spread = work.repartition("_key").sortWithinPartitions("_key", at, id_col)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, chain long, closed boolean"

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chains, count = None, [], 0
        for frame in frames:
            numbers, closed = [], []
            for k, t, s in zip(frame["_key"], frame[at], frame[stage], strict=True):
                if k != now:
                    now, chains, count = k, [], 0
                chains = [c for c in chains if t - c["last"] <= gap]
                found = next((c for c in reversed(chains) if c["closed"] is None or (s == c["stage"] and t - c["closed"] <= reopen)), None)
                if found is None:
                    count += 1
                    found = {"n": count, "closed": None}
                    chains.append(found)
                found.update(last=t, stage=s, closed=t if s in terminal else None)
                numbers.append(found["n"])
                closed.append(found["closed"] is not None)
            yield frame.drop(columns="_key").assign(chain=numbers, closed=closed)

    from pyspark.sql import Window

    out = spread.mapInPandas(fold, schema)
    whole = Window.partitionBy(*key, "chain")
    last = F.row_number().over(whole.orderBy(F.desc(at), F.desc(id_col))) == 1
    return out.withColumns({"chain_items": F.count("*").over(whole), "first_at": F.min(at).over(whole), "latest": last})
