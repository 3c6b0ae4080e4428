"""Keyed state over the event log, which arrives by time in a few batches, with a restart before each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import marks as M
from tessera.operators import scoped as SC
from tessera.plans.registry import query
from tessera.sources.tables import shared_folder, table
from tessera.streaming import state as S

BATCHES = 4
EXPIRY = 9 * 24 * S.HOUR_MS
NEAR, FAR = 24 * S.HOUR_MS, 72 * S.HOUR_MS


def in_turns(spark: SparkSession, events: DataFrame, steps: Callable[[DataFrame], DataFrame], batches: int = BATCHES) -> DataFrame:
    """What a streaming query gives of events that arrive by time, in ``batches`` spans of equal length.

    The query is started anew for each span and goes on from its checkpoint.
    """
    folder, out, checkpoint = (shared_folder(spark, name) for name in ("arriving", "steps", "steps-state"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(ms), F.max(ms)).head()
    span = ((last or 0) - (first or 0)) // batches + 1
    for i in range(batches):
        events.where(F.floor((ms - (first or 0)) / span) == i).write.mode("append").parquet(folder)
        found = steps(spark.readStream.schema(events.schema).parquet(folder))
        found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query("sr_retry_stream", f"""
WITH a AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_type = 'purchase' AS ok, event_type = 'error' AND value > 95 AS fin, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id ORDER BY rn) AS tries, min(ms) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id ORDER BY rn) + {EXPIRY} AS expires FROM a),
e AS (SELECT user_id, min(rn) FILTER (WHERE (ok OR fin OR tries >= 3) AND (expires IS NULL OR ms < expires)) AS stop, min(rn) FILTER (WHERE ms >= expires) AS over, min(expires) AS expires FROM f GROUP BY 1),
w AS (SELECT max(ms) - 3600000 AS mark FROM a),
l AS (SELECT f.user_id, arg_max(CASE WHEN ok THEN 'settled' WHEN fin THEN 'final' WHEN tries >= 3 THEN 'given up' ELSE 'retry' END, f.rn) AS state, max(f.tries) AS tries, any_value(e.stop) AS stop, any_value(e.expires) AS expires
  FROM f JOIN e ON f.user_id = e.user_id WHERE (e.stop IS NULL OR f.rn <= e.stop) AND (f.expires IS NULL OR f.ms < f.expires) GROUP BY 1)
SELECT user_id, CASE WHEN stop IS NULL AND expires <= mark THEN 'expired' ELSE state END AS state, CAST(tries AS INT) AS tries FROM l, w""")
def sr_retry_stream(spark, d):
    """Failed work by user: errors are failures, a purchase settles it; timers expire what nobody tries again."""
    attempts = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    settled, final = F.col("event_type") == "purchase", (F.col("event_type") == "error") & (F.col("value") > 95)
    steps = in_turns(spark, attempts, lambda rows: S.retried(rows, "user_id", "ts", "event_id", settled, final, expiry=EXPIRY))
    last = F.max_by(F.struct("state", "tries"), F.struct("ms", F.col("state") != "retry", "row_id")).alias("last")
    return steps.groupBy(F.col("key").alias("user_id")).agg(last).select("user_id", "last.state", "last.tries")


@query("sr_takeover_stream", f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS rank FROM events),
s(user_id, start) AS (SELECT user_id, min(ms) FROM e GROUP BY 1 UNION ALL SELECT s.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = s.user_id AND e.ms > s.start + {FAR}) AS start FROM s WHERE s.start IS NOT NULL),
j AS (SELECT e.*, max(s.start) AS start FROM e JOIN s ON e.user_id = s.user_id AND s.start <= e.ms GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, min(CASE WHEN ms - start <= {NEAR} THEN rank END) OVER (PARTITION BY user_id, start ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM j WINDOW w AS (PARTITION BY user_id, start ORDER BY ms, event_id))
SELECT event_id, user_id, CASE WHEN rn = 1 THEN 'new' WHEN ms - start > {NEAR} THEN 'late copy' WHEN rank < best THEN 'takes over' ELSE 'copy' END AS verdict FROM r""")
def sr_takeover_stream(spark, d):
    """Events of a user as copies of one row: a better kind within a day takes over, up to three days copies are late, then a row begins."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    found = in_turns(spark, table(spark, d, "events"), lambda rows: S.taken_over(rows, "user_id", "ts", "event_id", rank, NEAR, FAR))
    return found.select(F.col("row_id").alias("event_id"), F.col("key").alias("user_id"), "verdict")


@query("sr_marked_runs", """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS late, o_totalprice FROM orders), m AS (SELECT max(o_orderkey) // 2 AS half FROM orders)
SELECT CAST(CASE WHEN late > 0 AND o_orderkey <= half THEN 0 WHEN o_orderkey > half THEN 1 ELSE 2 END AS INT) AS in_run, count(*) AS n, max(o_orderkey) AS mark FROM o, m GROUP BY 1""")
def sr_marked_runs(spark, d):
    """Orders that arrive in two halves, a fifth of the first late: what each of three runs does, the third a full pass."""
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), shared_folder(spark, "marked")
    half = (orders.agg(F.max("o_orderkey")).head()[0] or 0) // 2
    early, late = F.col("o_orderkey") <= half, F.col("o_orderkey") % 5 == 0
    for arrived in (early & ~late, ~early, early & late):
        M.append(orders.where(arrived), path, "o_orderkey")
        M.run(spark, path, "o_orderkey long, o_totalprice double", "o_orderkey", lambda rows: rows.select("o_orderkey"), every=2)
    done = spark.read.schema("o_orderkey long, in_run int").parquet(f"{path}/done")
    return done.groupBy("in_run").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("mark"))


@query("sync_scoped", """
SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(round(CASE WHEN l_suppkey % 9 = 4 THEN l_extendedprice + 1 ELSE l_extendedprice END * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE NOT (l_suppkey % 11 = 2 AND l_linenumber = 1) GROUP BY 1""")
def sync_scoped(spark, d):
    """Totals by supplier, published in buckets, after a refresh that writes the buckets of edited suppliers and checks a tenth of the others."""
    path, old = shared_folder(spark, "published"), table(spark, d, "lineitem")
    edited = old.where("NOT (l_suppkey % 11 = 2 AND l_linenumber = 1)").withColumn("l_extendedprice", F.when(F.col("l_suppkey") % 9 == 4, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")))
    totals = lambda lines: lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    SC.refresh(old, path, ["l_suppkey"], totals, 16)
    SC.refresh(edited, path, ["l_suppkey"], totals, shadow=0.1)
    return SC.published(spark, path, totals(old).schema)
