"""Keyed state with timers: retries that settle, give up or expire, and late copies that take over a stored row.

Both keep one small row a key in RocksDB and see a key's rows of a batch in order of time, so their results don't depend on how
the input falls into batches, as long as no row comes later than ``late`` behind the newest: such rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"
HOUR_MS = 3_600_000


def with_store(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    spark.conf.set(_SETTING, STORE)


def _ordered(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows of one key by (time, id). Times are milliseconds."""
    rows = [r for frame in frames for r in frame[columns].itertuples(index=False, name=None)]
    return iter(sorted(rows))


def _timed(state: GroupState, held: tuple, due: int) -> bool:
    """Keep a key's row with its timer, which goes off once the watermark is at ``due``; False, and nothing kept, where it is already."""
    if due <= state.getCurrentWatermarkMs():
        return False
    state.update(held)
    state.setTimeoutTimestamp(due - 1)  # goes off after that
    return True


def _retries(most: int, wait: int, longest: int, expiry: int) -> Callable:
    """State (tries, due, expires, ended): expires is a timer, which is set by the first failure."""
    columns = ["key", "ms", "row_id", "state", "tries", "due"]

    def steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, due, expires, ended = state.get if state.exists else (0, 0, 0, "")
        out = []
        for ms, row_id, ok, final in () if state.hasTimedOut else _ordered(frames, ["ms", "row_id", "ok", "final"]):
            if not ended and expires and ms >= expires:
                ended, due = "expired", 0
                out.append((*key, expires, -1, ended, tries, due))
            if ended:
                continue
            tries += not ok
            if ok:
                ended = "settled"
            elif final:
                ended = "final"
            elif tries >= most:
                ended = "given up"
            due = 0 if ended else ms + min(wait * 2 ** (tries - 1), longest)
            if not ended and not expires:
                expires = ms + expiry
            out.append((*key, ms, row_id, ended or "retry", tries, due))
        if not ended and (state.hasTimedOut or not _timed(state, (int(tries), int(due), int(expires), ended), int(expires))):
            ended = "expired"
            out.append((*key, expires, -1, ended, tries, 0))
        if ended:
            state.update((int(tries), 0, 0, ended))
        yield pd.DataFrame(out, columns=columns)

    return steps


def retried(attempts: DataFrame, key: str, at: str, row_id: str, ok: Column, final: Column, most: int = 3, wait: int = 60_000, longest: int = HOUR_MS, expiry: int = 30 * 24 * HOUR_MS, late: str = "1 hour") -> DataFrame:
    """(key, ms, row_id, state, tries, due) for each step of a key's work, from a stream of attempts.

    An attempt that is ``ok`` settles the work, a failure that is ``final`` ends it, the ``most``-th failure gives it up; any
    other is to be tried again at ``due``, after ``wait`` milliseconds, doubled with each failure up to ``longest``. Work that
    hasn't ended ``expiry`` milliseconds after its first failure has expired: a timer says so when the watermark passes, without an
    attempt of that key (row_id is -1). Whatever comes after an end is no step. Null ok and final are false; rows without a key
    or a time are left out.
    """
    with_store(attempts.sparkSession)
    rows = attempts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(row_id).cast("long").alias("row_id"),
        F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(final, F.lit(False)).alias("final"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ms long, row_id long, state string, tries int, due long"
    grouped = rows.withWatermark("at", late).groupBy("key")
    return grouped.applyInPandasWithState(_retries(most, wait, longest, expiry), schema, "tries int, due long, expires long, ended string", "append", GroupStateTimeout.EventTimeTimeout)


def _take_overs(near: int, far: int) -> Callable:
    """State (start, rank, row_id) of the stored copy; it is forgotten by a timer when no copy can belong to it any more."""
    columns = ["key", "ms", "row_id", "verdict", "of"]

    def steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        start, rank, held = state.get if state.exists else (None, 0, 0)
        out = []
        for ms, row_id, its_rank in _ordered(frames, ["ms", "row_id", "rank"]):
            gap = None if start is None else ms - start
            if gap is None or gap > far:
                verdict, of = "new", row_id
                start, rank, held = ms, its_rank, row_id
            elif gap > near:
                verdict, of = "late copy", held
            elif its_rank < rank:
                verdict, of = "takes over", held
                rank, held = its_rank, row_id
            else:
                verdict, of = "copy", held
            out.append((*key, ms, row_id, verdict, of))
        if not _timed(state, (int(start), int(rank), int(held)), int(start) + far + 1) and state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    return steps


def taken_over(copies: DataFrame, key: str, at: str, row_id: str, rank: Column, near: int = 24 * HOUR_MS, far: int = 30 * 24 * HOUR_MS, late: str = "1 hour") -> DataFrame:
    """(key, ms, row_id, verdict, of): what each copy of a key's row is to the one that is stored.

    The first copy is new and stored. Up to ``near`` milliseconds after it a copy of a lower rank takes over (``of`` is the row it
    replaces), others are copies; up to ``far`` they are late copies, which replace nothing; then a new row begins. The
    stored row is forgotten when the watermark has passed ``far``, so state doesn't grow with old keys. Rows without a key
    or a time are left out; a null rank comes last.
    """
    with_store(copies.sparkSession)
    rows = copies.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(row_id).cast("long").alias("row_id"), F.coalesce(rank, F.lit(2**31 - 1)).cast("int").alias("rank"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    grouped = rows.withWatermark("at", late).groupBy("key")
    return grouped.applyInPandasWithState(_take_overs(near, far), f"key {kind}, ms long, row_id long, verdict string, of long", "start long, rank int, row_id long", "append", GroupStateTimeout.EventTimeTimeout)
