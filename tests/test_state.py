"""Keyed state against plain Python: any split of the input in batches, with a restart before each."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.plans.state import in_turns
from tessera.streaming import state as S

DAY = 24 * S.HOUR_MS


def fold_retries(rows, most, expiry):
    out, work = [], {}
    for key, ms, i, ok, final in sorted(rows, key=lambda r: (r[1], r[2])):
        w = work.setdefault(key, {"tries": 0, "expires": None, "ended": None})
        if not w["ended"] and w["expires"] is not None and ms >= w["expires"]:
            w["ended"] = "expired"
            out.append((key, w["expires"], -1, "expired", w["tries"], 0))
        if w["ended"]:
            continue
        w["tries"] += not ok
        w["ended"] = "settled" if ok else "final" if final else "given up" if w["tries"] >= most else None
        if not w["ended"] and w["expires"] is None:
            w["expires"] = ms + expiry
        out.append((key, ms, i, w["ended"] or "retry", w["tries"], 0 if w["ended"] else ms + min(60_000 * 2 ** (w["tries"] - 1), S.HOUR_MS)))
    mark = max(r[1] for r in rows) - S.HOUR_MS
    out += [(k, w["expires"], -1, "expired", w["tries"], 0) for k, w in work.items() if not w["ended"] and w["expires"] <= mark]
    return sorted(out)


def frame(spark, rows, names):
    made = spark.createDataFrame(rows, names)
    return made.withColumn("ts", F.timestamp_millis("ms"))


@pytest.mark.parametrize("batches", [1, 3])
def test_retries_whatever_the_batches(spark, batches):
    dice = random.Random(3)
    rows = [(dice.randrange(12), dice.randrange(40 * 24) * S.HOUR_MS // 1, i, dice.random() < 0.12, dice.random() < 0.05) for i in range(90)]
    rows += [(100, 5 * S.HOUR_MS, 900, False, False), (101, 39 * DAY, 901, False, False), (102, 1 * S.HOUR_MS, 902, False, False), (102, 30 * DAY, 903, True, False)]
    events = frame(spark, rows, "key long, ms long, row_id long, ok boolean, final boolean")
    events = events.unionByName(frame(spark, [(None, 7, 950, True, True), (5, None, 951, True, True)], events.drop("ts").schema))
    got = in_turns(spark, events, lambda e: S.retried(e, "key", "ts", "row_id", F.col("ok"), F.col("final"), expiry=9 * DAY), batches)
    want = fold_retries(rows, 3, 9 * DAY)
    assert sorted(tuple(r) for r in got.collect()) == want
    states = {r[3] for r in want}
    assert states == {"settled", "final", "given up", "expired", "retry"}
    assert (100, 5 * S.HOUR_MS + 9 * DAY, -1, "expired", 1, 0) in want, "a timer without another attempt"


@pytest.mark.parametrize("batches", [1, 4])
def test_take_overs_whatever_the_batches(spark, batches):
    dice = random.Random(4)
    rows = [(dice.randrange(9), dice.randrange(20 * 24) * S.HOUR_MS, i, dice.choice([0, 1, 2, None])) for i in range(160)]
    want, stored = [], {}
    for key, ms, i, rank in sorted(rows, key=lambda r: (r[1], r[2])):
        rank = 2**31 - 1 if rank is None else rank
        start, best, held = stored.get(key, (None, 0, 0))
        if start is None or ms - start > 3 * DAY:
            verdict, of, stored[key] = "new", i, (ms, rank, i)
        elif ms - start > DAY:
            verdict, of = "late copy", held
        elif rank < best:
            verdict, of, stored[key] = "takes over", held, (start, rank, i)
        else:
            verdict, of = "copy", held
        want.append((key, ms, i, verdict, of))
    events = frame(spark, rows, "key long, ms long, row_id long, rank int")
    got = in_turns(spark, events, lambda e: S.taken_over(e, "key", "ts", "row_id", F.col("rank"), DAY, 3 * DAY), batches)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {r[3] for r in want} == {"new", "late copy", "takes over", "copy"}
