"""Ordered operators, set differences and incremental refresh on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sync as S
from tessera.operators import windows as W
from tessera.operators.aggregates import cents
from tessera.operators.chains import lifecycle
from tessera.plans.registry import query
from tessera.sources.tables import micros, stored, table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", micros(F.col("ts")))


@query("wn_sessions_gap", f"""
WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS items, min(epoch_us(ts)) AS first_at, max(event_id) AS latest_id FROM s GROUP BY 1, 2""")
def wn_sessions_gap(spark, d):
    sessions = W.sessionise(_events(spark, d), "user_id", "at", "event_id", 6 * HOUR)
    return sessions.groupBy("user_id", "session").agg(F.count("*").alias("items"), F.min("at").alias("first_at"), F.max("event_id").alias("latest_id"))


@query("wn_latest_group", """
WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey FROM m JOIN lineitem ON l_orderkey = o_orderkey WHERE rn = 1""")
def wn_latest_group(spark, d):
    """Of each customer's latest order, all lines."""
    last = W.latest_group_rows(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate")
    return last.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("wn_chain_columns", """
SELECT o_orderkey, count(*) OVER w AS chain_items, epoch_us(min(o_orderdate) OVER w) AS first_at, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS latest
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)""")
def wn_chain_columns(spark, d):
    orders = table(spark, d, "orders").withColumn("at", micros(F.col("o_orderdate")))
    return W.chain_columns(orders, ["o_custkey", "o_orderpriority"], ["at", "o_orderkey"]).select("o_orderkey", "chain_items", F.col("chain_first").alias("first_at"), "latest")


@query("wn_ffill", """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events),
f AS (SELECT *, last_value(amount IGNORE NULLS) OVER w AS fa, last_value(kind IGNORE NULLS) OVER w AS fk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, fa AS amount, fk AS kind, concat_ws(',', CASE WHEN amount IS NULL AND fa IS NOT NULL THEN 'amount' END, CASE WHEN kind IS NULL AND fk IS NOT NULL THEN 'kind' END) AS filled_from FROM f""")
def wn_ffill(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "at", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return W.fill_forward(e, "user_id", ["at", "event_id"], ["amount", "kind"]).select("event_id", "amount", "kind", F.array_join("filled_from", ",").alias("filled_from"))


@query("wn_change_history", """
WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS previous, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
k AS (SELECT * FROM p WHERE n = 1 OR o_orderstatus IS DISTINCT FROM previous)
SELECT o_custkey, o_orderkey, o_orderstatus, previous, row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS step FROM k""")
def wn_change_history(spark, d):
    kept = W.changes(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return kept.select("o_custkey", "o_orderkey", "o_orderstatus", "previous", F.col("step").cast("bigint").alias("step"))


@query("wn_revised_from", """
WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earlier FROM orders)
SELECT o_orderkey, earlier FROM o WHERE abs(o_totalprice - earlier) > 0.005 * earlier AND o_totalprice BETWEEN 0.5 * earlier AND 2 * earlier""")
def wn_revised_from(spark, d):
    moved = W.changes(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").where("previous is not null")
    now, was = F.col("o_totalprice"), F.col("previous")
    return moved.where((F.abs(now - was) > 0.005 * was) & now.between(0.5 * was, 2 * was)).select("o_orderkey", was.alias("earlier"))


@query("wn_first_seen", """
SELECT event_id, user_id, event_type, k FROM (SELECT event_id, user_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k, row_number() OVER (PARTITION BY user_id, event_type, regexp_extract(props, '([0-9]+)', 1) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def wn_first_seen(spark, d):
    e = _events(spark, d).select("user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).alias("k"), "at", "event_id")
    return W.first_reports(e, ["user_id", "event_type", "k"], ["at", "event_id"]).select("event_id", "user_id", "event_type", "k")


@query("wn_fold_guidance", """
WITH g AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS guided FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, max(l_quantity) AS actual, max(CASE WHEN l_quantity BETWEEN guided * 0.67 AND guided * 1.5 THEN guided END) AS guided FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R') a LEFT JOIN (SELECT l_orderkey AS k, max(guided) AS guided FROM g GROUP BY 1) ON k = l_orderkey GROUP BY 1, 2""")
def wn_fold_guidance(spark, d):
    """A planned value is folded onto the actual row of its order if their ratio is plausible."""
    lines = table(spark, d, "lineitem")
    guided = lines.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("g"))
    rows = lines.where("l_returnflag = 'R'").join(guided, F.col("k") == F.col("l_orderkey"), "left")
    fits = F.col("l_quantity").between(F.col("g") * 0.67, F.col("g") * 1.5)
    return rows.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("actual"), F.max(F.when(fits, F.col("g"))).alias("guided"))


@query("wn_keeper", """
WITH c AS (SELECT doc_id, source, md5(text) AS h FROM documents)
SELECT doc_id, count(*) OVER (PARTITION BY h) AS cluster_size, row_number() OVER (PARTITION BY h ORDER BY CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 1 END, doc_id) = 1 AS keeper FROM c""")
def wn_keeper(spark, d):
    """Which of exact copies stays: preferred sources first, then the smallest id."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    rank = F.when(F.col("source").isin("src1", "src2"), 0).otherwise(1)
    return W.keeper(docs, ["h"], [rank, F.col("doc_id")]).select("doc_id", "cluster_size", "keeper")


@query("wn_period_latest", """
WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, unnest(['Y', 'Q']) AS kind FROM orders), k AS (SELECT *, CASE WHEN kind = 'Y' THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) END AS period FROM p)
SELECT o_custkey, kind, period, o_orderkey FROM (SELECT *, max(period) OVER (PARTITION BY o_custkey, kind) AS last FROM k) WHERE period = last""")
def wn_period_latest(spark, d):
    day = F.col("o_orderdate")
    periods = F.array(F.struct(F.lit("Y").alias("kind"), F.date_format(day, "yyyy").alias("period")), F.struct(F.lit("Q").alias("kind"), F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day)).alias("period")))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.explode(periods).alias("p")).select("o_custkey", "o_orderkey", "p.*")
    last = rows.groupBy("o_custkey", "kind").agg(F.max("period").alias("period"))
    return rows.join(last, ["o_custkey", "kind", "period"]).select("o_custkey", "kind", "period", "o_orderkey")


@query("st_multiset_diff", """
WITH a AS (SELECT l_partkey, l_linenumber, count(*) AS o FROM lineitem WHERE l_tax < 0.06 GROUP BY 1, 2), b AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_discount < 0.06 GROUP BY 1, 2)
SELECT l_partkey, l_linenumber, CAST(least(coalesce(o, 0), coalesce(n, 0)) AS BIGINT) AS kept, CAST(greatest(coalesce(n, 0) - coalesce(o, 0), 0) AS BIGINT) AS inserted, CAST(greatest(coalesce(o, 0) - coalesce(n, 0), 0) AS BIGINT) AS deleted FROM a FULL JOIN b USING (l_partkey, l_linenumber)""")
def st_multiset_diff(spark, d):
    lines = table(spark, d, "lineitem")
    return S.multiset_diff(lines.where("l_tax < 0.06").select("l_partkey", "l_linenumber"), lines.where("l_discount < 0.06").select("l_partkey", "l_linenumber"))


@query("st_keyed_diff", """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 7)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'replace' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def st_keyed_diff(spark, d):
    """Two versions of the orders, made from the table: one misses some keys, the other others and changes a status."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    last = F.col("o_orderkey") % 10
    new = orders.where(last != 7).withColumn("o_orderstatus", F.when(last == 5, "X").otherwise(F.col("o_orderstatus")))
    return S.keyed_diff(orders.where(last != 3), new, ["o_orderkey"])


@query("st_union_narrow", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
def st_union_narrow(spark, d):
    """One scan with OR instead of a union of look-ups: keys are unique."""
    return table(spark, d, "orders").where("o_totalprice > 300000 OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')").select("o_orderkey")


def _totals(lines):
    return lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(cents(F.col("l_extendedprice"))).alias("cents"))


@query("sync_incremental", """
SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(round(CASE WHEN l_suppkey % 9 = 4 THEN l_extendedprice + 1 ELSE l_extendedprice END * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE NOT (l_suppkey % 11 = 2 AND l_linenumber = 1) GROUP BY 1""")
def sync_incremental(spark, d):
    """Totals after an edit of some suppliers' lines, from what the last run stored: its totals and a signature per supplier."""
    old = table(spark, d, "lineitem")
    new = old.where("NOT (l_suppkey % 11 = 2 AND l_linenumber = 1)").withColumn("l_extendedprice", F.when(F.col("l_suppkey") % 9 == 4, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")))
    published, signatures = stored(_totals(old), "totals"), stored(S.signatures(old, ["l_suppkey"]), "signatures")
    return S.refreshed_from(published, signatures, new, ["l_suppkey"], _totals)


@query("ch_lifecycle")
def ch_lifecycle(spark, d):
    """Orders of a customer and priority folded into lifecycles: status P is terminal, gaps end a chain."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", micros(F.col("o_orderdate")).alias("at"), F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").alias("amount"))
    return lifecycle(orders, ["o_custkey", "o_orderpriority"], "at", "o_orderkey", "stage", "amount", terminal=["P"], gap=400 * DAY, reopen=30 * DAY)


@query("wn_adopt_nearest", f"""
WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), c AS (SELECT * FROM events WHERE event_type = 'click'),
m AS (SELECT c.event_id, s.event_id AS adopted, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(s.ts)), s.ts, s.event_id) AS rn FROM c JOIN s ON c.user_id = s.user_id AND abs(epoch_us(c.ts) - epoch_us(s.ts)) <= {12 * HOUR})
SELECT c.event_id, coalesce(m.adopted, -1) AS adopted FROM c LEFT JOIN m ON c.event_id = m.event_id AND rn = 1""")
def wn_adopt_nearest(spark, d):
    from tessera.operators.matching import nearest_match

    e = _events(spark, d)
    clicks = e.where("event_type = 'click'")
    found = nearest_match(clicks, e.where("event_type = 'signup'"), "user_id", "at", "event_id", 12 * HOUR, 12 * HOUR)
    return clicks.join(found, F.col("event_id") == F.col("left_id"), "left").select("event_id", F.coalesce("right_id", F.lit(-1)).alias("adopted"))
