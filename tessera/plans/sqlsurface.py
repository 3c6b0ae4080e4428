"""Queries in Spark SQL over the table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sqlsurface as S
from tessera.plans.extract import C, K, TEMPLATES, _parts, one_of
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("sql_reader_lateral", f"""
SELECT {K} AS id, CAST(round(({K} % 90 + 1 + ({K} % 10) / 10.0) * 1e6) AS BIGINT) AS amount, {one_of(C, 'USD', 'CAD', 'AUD')} AS currency, CAST({K} % 90 + 10 AS BIGINT) AS price_cents, CAST(({K} % 900 + 1) * 1000 + {C} % 900 + 100 AS BIGINT) AS units, 5 AS fields FROM orders""")
def sql_reader_lateral(spark, d):
    """A reader as a table function beside each release."""
    S.register(spark)
    sentence = f"concat('Terms. ', {', '.join(e for _, e in _parts(TEMPLATES['financings']))})"
    releases = table(spark, d, "orders").select(F.col(K).alias("id"), F.lit("A headline").alias("headline"), F.expr(sentence).alias("body"))
    return spark.sql(
        """
        SELECT r.id, CAST(round(max(f.value_num) FILTER (WHERE f.field = 'amount')) AS BIGINT) AS amount, max(f.unit) FILTER (WHERE f.field = 'amount') AS currency,
            CAST(round(max(f.value_num) FILTER (WHERE f.field = 'price') * 100) AS BIGINT) AS price_cents, CAST(max(f.value_num) FILTER (WHERE f.field = 'units') AS BIGINT) AS units,
            CAST(count_if(substring(concat(r.headline, '\\n', r.body), f.span_start + 1, f.span_end - f.span_start) = f.value_text) AS INT) AS fields
        FROM {releases} r, LATERAL reader_financings(r.headline, r.body) f GROUP BY r.id""",
        releases=releases,
    )


@query("sql_gap_sessions", """
WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, CAST(session AS INT) AS session, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at, CAST(count(*) AS INT) AS items FROM s GROUP BY 1, 2""")
def sql_gap_sessions(spark, d):
    """A fold over a table argument, partitioned and ordered by SQL."""
    S.register(spark)
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = spark.sql("SELECT * FROM gap_sessions(gap => 21600000000L, row => TABLE(SELECT key, at FROM {events}) PARTITION BY key ORDER BY at)", events=events)
    return found.withColumnRenamed("key", "user_id")
