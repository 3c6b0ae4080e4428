"""Streaming queries run to the end of what is there (availableNow) and read back from their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.tables import micros, shared_folder, table
from tessera.streaming import events as E


def run_to_end(frame: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input and return the sink's rows. Complete mode keeps the last result of all groups."""
    spark = frame.sparkSession
    out, state = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-state")
    if mode == "append":
        running = frame.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out, format="parquet")
    else:

        def last(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        running = frame.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(last).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def _stream(spark, d):
    """The events table (a file, or a folder of files) as a stream."""
    return E.stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


@query("sr_dedup_stream", "SELECT event_id, min(user_id) AS user_id FROM events GROUP BY 1")
def sr_dedup_stream(spark, d):
    """The event log arrives twice (a union of two reads); each event is kept once."""
    twice = _stream(spark, d).union(_stream(spark, d))
    return run_to_end(E.unseen(twice, ["event_id"])).select("event_id", "user_id")


@query("sr_tumbling_hours", "SELECT epoch_us(date_trunc('hour', ts)) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def sr_tumbling_hours(spark, d):
    hourly = run_to_end(E.tumbling(_stream(spark, d), "1 hour", ["event_type"]), "complete")
    return hourly.select(micros(F.col("bucket")).alias("bucket"), "event_type", "n")


@query("sr_sliding_days", """
WITH w AS (SELECT unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 12), date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 12) - INTERVAL 12 HOUR]) AS b FROM events)
SELECT epoch_us(b) AS bucket, count(*) AS n FROM w GROUP BY 1""")
def sr_sliding_days(spark, d):
    daily = run_to_end(E.sliding(_stream(spark, d), "24 hours", "12 hours"), "complete")
    return daily.select(micros(F.col("bucket")).alias("bucket"), "n")


@query("sr_sessions", """
WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, first_at, items FROM (SELECT user_id, session, min(epoch_us(ts)) AS first_at, count(*) AS items FROM s GROUP BY 1, 2)""")
def sr_sessions(spark, d):
    found = run_to_end(E.sessions(_stream(spark, d), "6 hours", "user_id"), "complete")
    return found.select("user_id", micros(F.col("first_at")).alias("first_at"), "items")


@query("sr_guarded_ingest", """
SELECT coalesce(CASE WHEN event_type = 'error' THEN 'kind' WHEN value IS NULL OR value < 0 THEN 'value' WHEN user_id % 10 = 3 THEN 'unknown user' END, 'accepted') AS verdict, count(*) AS n FROM events GROUP BY 1""")
def sr_guarded_ingest(spark, d):
    guards = [("kind", F.col("event_type") != "error"), ("value", F.col("value") >= 0), ("unknown user", F.col("user_id") % 10 != 3)]
    judged = E.guarded(table(spark, d, "events"), guards)
    return judged.groupBy(F.coalesce("refused_by", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


@query("sr_guard_chain", """
SELECT coalesce(CASE WHEN event_id IS NULL THEN 'id' WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error') THEN 'kind' WHEN ts < TIMESTAMP '2024-01-01' THEN 'old' WHEN value IS NULL OR value < 0 THEN 'value' WHEN value > 300 THEN 'outlier' WHEN user_id % 10 = 3 THEN 'unknown user' WHEN event_type = 'error' AND value < 1 THEN 'noise' END, 'accepted') AS verdict, count(*) AS n FROM events GROUP BY 1""")
def sr_guard_chain(spark, d):
    """Seven guards in order over the event stream."""
    known = ("click", "view", "purchase", "signup", "error")
    guards = [
        ("id", F.col("event_id").isNotNull()), ("kind", F.col("event_type").isin(*known)), ("old", F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")), ("value", F.col("value") >= 0),
        ("outlier", F.col("value") <= 300), ("unknown user", F.col("user_id") % 10 != 3), ("noise", ~((F.col("event_type") == "error") & (F.col("value") < 1))),
    ]
    judged = run_to_end(E.guarded(_stream(spark, d), guards).select("event_id", "refused_by"))
    return judged.groupBy(F.coalesce("refused_by", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


@query("sr_merging_stream", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id) AS rn FROM events)
SELECT user_id, event_id, event_type FROM r WHERE rn = 1""")
def sr_merging_stream(spark, d):
    """The event stream merged into a keyed table by the better source: version by version through foreachBatch."""
    folder = shared_folder(spark, "merged")
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    kept = _stream(spark, d).select("user_id", "event_id", "event_type")
    path_of = lambda n: f"{folder}/v{n}"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        E.merging_sink(path_of, ["user_id"], F.struct(-rank, -F.col("event_id")), [])(batch, number)
        last[:] = [number]

    state = shared_folder(spark, "merged-state")
    kept.writeStream.option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path_of(last[0])) if last else spark.createDataFrame([], "user_id long, event_id long, event_type string")


@query("sr_page_views", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS views, count(DISTINCT substr(sha256(strftime(ts, '%Y-%m-%d') || ':' || user_id), 1, 16)) AS visitors FROM events WHERE user_id % 7 > 0 AND event_type <> 'error' GROUP BY 1""")
def sr_page_views(spark, d):
    """A log of views without bots, visitors hashed under a salt of the day, appended as a stream."""
    from tessera.functions.text import salted_id

    day = F.date_format("ts", "yyyy-MM-dd")
    seen = _stream(spark, d).where((F.col("user_id") % 7 > 0) & (F.col("event_type") != "error"))
    log = run_to_end(seen.select(day.alias("day"), salted_id(F.col("user_id").cast("string"), day).alias("visitor")))
    return log.groupBy("day").agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))
