"""Joins and matching on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import predicates as P
from tessera.operators.aggregates import cents
from tessera.plans.registry import query
from tessera.sources.tables import micros, table

MINUTE = 60_000_000


def _events(spark, d, kind=None):
    events = table(spark, d, "events").withColumn("at", micros(F.col("ts")))
    return events.where(F.col("event_type") == kind) if kind else events


@query("jn_left_marker", """
SELECT o_orderkey, count(l_orderkey) AS n_rows, min(l_returnflag) AS flag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity >= 40 GROUP BY 1""")
def jn_left_marker(spark, d):
    """Every order, with a marker row (n_rows 0, flag null) where no line qualifies."""
    lines = table(spark, d, "lineitem").where("l_quantity >= 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_rows"), "flag")


@query("jn_anti_pending", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey)")
def jn_anti_pending(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(runs, "o_orderkey", "left_anti")


@query("jn_exists_notexists", """
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.08)""")
def jn_exists_notexists(spark, d):
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_returnflag") == "R").alias("a"), F.max(F.col("l_discount") > 0.08).alias("b"))
    return table(spark, d, "orders").join(flags.where("a and not b"), "o_orderkey", "left_semi").select("o_orderkey")


@query("jn_corr_min", """
SELECT o_orderkey, coalesce((SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.04), 0) AS first_line FROM orders WHERE o_orderstatus = 'P'""")
def jn_corr_min(spark, d):
    least = table(spark, d, "lineitem").where("l_tax > 0.04").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("first_line"))
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(least, "o_orderkey", "left").select("o_orderkey", F.coalesce("first_line", F.lit(0)).alias("first_line"))


@query("jn_first_child_pref", """
SELECT o_orderkey, l_linenumber, l_partkey, pref FROM orders JOIN (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE 2 END AS pref,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) ON o_orderkey = l_orderkey AND rn = 1""")
def jn_first_child_pref(spark, d):
    pref = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_discount") > 0.05, 1).otherwise(2)
    lines = table(spark, d, "lineitem").withColumn("pref", pref).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("pref", "l_linenumber", "l_partkey", "l_suppkey")).alias("c"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", "c.l_linenumber", "c.l_partkey", "c.pref")


@query("jn_children_array", """
SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children, count(l_orderkey) AS n
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def jn_children_array(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x.l_linenumber, x.l_partkey)), ",")
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce(text, F.lit("")).alias("children"), F.coalesce(F.size("c"), F.lit(0)).cast("bigint").alias("n"))


@query("jn_band_pairs", f"""
SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {30 * MINUTE}""")
def jn_band_pairs(spark, d):
    return M.band_pairs(_events(spark, d), "user_id", "at", 30 * MINUTE, "event_id")


@query("jn_nearest_asof", f"""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
m AS (SELECT p.user_id, p.event_id AS left_id, v.event_id AS right_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS gap,
 row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, v.event_id) AS rn
 FROM p JOIN v ON p.user_id = v.user_id AND epoch_us(v.ts) BETWEEN epoch_us(p.ts) - {360 * MINUTE} AND epoch_us(p.ts) + {60 * MINUTE})
SELECT user_id, left_id, right_id, gap FROM m WHERE rn = 1""")
def jn_nearest_asof(spark, d):
    return M.nearest_match(_events(spark, d, "purchase"), _events(spark, d, "view"), "user_id", "at", "event_id", 360 * MINUTE, 60 * MINUTE)


@query("jn_score_ambiguous", """
WITH s AS (SELECT l_orderkey, p_brand, max((CASE WHEN p_size > 25 THEN 2 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
t AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS r FROM s)
SELECT l_orderkey, min(p_brand) AS p_brand, max(score) AS score FROM t WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1""")
def jn_score_ambiguous(spark, d):
    pairs = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    score = F.when(F.col("p_size") > 25, 2).otherwise(0) + F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    best = pairs.groupBy("l_orderkey", "p_brand").agg(F.max(score).alias("s"))
    return M.unambiguous_top(best, "l_orderkey", "p_brand", F.col("s"))


@query("jn_two_tier", """
WITH e AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, event_id FROM events), own AS (SELECT user_id, day, min(event_id) AS id FROM e WHERE event_type = 'signup' GROUP BY 1, 2),
anyone AS (SELECT day, min(event_id) AS id FROM e WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id, coalesce(own.id, anyone.id) AS match_id, CASE WHEN own.id IS NOT NULL THEN 1 WHEN anyone.id IS NOT NULL THEN 2 END AS tier
FROM e LEFT JOIN own ON e.user_id = own.user_id AND e.day = own.day LEFT JOIN anyone ON e.day = anyone.day WHERE e.event_type = 'purchase'""")
def jn_two_tier(spark, d):
    e = _events(spark, d).withColumn("day", F.date_trunc("day", F.col("ts")))
    signups = e.where("event_type = 'signup'")
    own = signups.groupBy("user_id", "day").agg(F.min("event_id").alias("own"))
    anyone = signups.groupBy("day").agg(F.min("event_id").alias("anyone"))
    rows = e.where("event_type = 'purchase'").join(own, ["user_id", "day"], "left").join(anyone, "day", "left")
    return rows.select("event_id", F.coalesce("own", "anyone").alias("match_id"), F.when(F.col("own").isNotNull(), 1).when(F.col("anyone").isNotNull(), 2).alias("tier"))


@query("jn_coverage", """
WITH o AS (SELECT o_custkey AS k, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day, count(*) AS listed FROM orders GROUP BY 1, 2)
SELECT a.k, a.day, a.listed, CAST(sum(b.listed) AS BIGINT) AS stored FROM o a JOIN o b ON a.k = b.k AND b.day BETWEEN a.day - 1 AND a.day + 1 GROUP BY 1, 2, 3""")
def jn_coverage(spark, d):
    """Rows of a key and day against those of the key within a day: each day is counted once, then spread to its neighbours."""
    day = F.floor(micros(F.col("o_orderdate")) / (1440 * MINUTE))
    listed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), day.alias("day")).agg(F.count("*").alias("listed"))
    near = listed.select("k", F.explode(F.sequence(F.col("day") - 1, F.col("day") + 1)).alias("day"), F.col("listed").alias("n")).groupBy("k", "day").agg(F.sum("n").alias("stored"))
    return listed.join(near, ["k", "day"])


@query("jn_priority_union", """
SELECT key, src, tier FROM (SELECT doc_id AS key, 'document' AS src, 1 AS tier FROM documents WHERE n_chars > 3000
UNION ALL SELECT page_id, 'page', 2 FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 3000))""")
def jn_priority_union(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 3000").select(F.col("doc_id").alias("key"), F.lit("document").alias("src"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.lit("page").alias("src"))
    return M.priority_union([docs, pages], ["key"])


@query("jn_override_merge", """
SELECT c_custkey, coalesce(seg, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'DROP' END AS op, CASE WHEN c_custkey % 5 = 0 THEN 'REVISED' END AS seg
 FROM customer WHERE c_acctbal < 0) ON c_custkey = k WHERE op IS NULL""")
def jn_override_merge(spark, d):
    """Corrections that set or drop: here derived from the accounts below zero."""
    customer = table(spark, d, "customer")
    edits = customer.where("c_acctbal < 0").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 7 == 0, "DROP").alias("op"), F.when(F.col("c_custkey") % 5 == 0, "REVISED").alias("seg"))
    return customer.join(edits, "c_custkey", "left").where("op is null").select("c_custkey", F.coalesce("seg", "c_mktsegment").alias("segment"))


@query("jn_role_side", """
SELECT n_name, count(DISTINCT c_custkey) AS buyers, count(DISTINCT s_suppkey) AS sellers,
 CASE WHEN count(DISTINCT c_custkey) > 0 AND count(DISTINCT s_suppkey) > 0 THEN 'both' WHEN count(DISTINCT c_custkey) > 0 THEN 'buyer' WHEN count(DISTINCT s_suppkey) > 0 THEN 'seller' ELSE 'none' END AS side
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def jn_role_side(spark, d):
    buyers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("buyers"))
    sellers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("sellers"))
    rows = table(spark, d, "nation").join(buyers, "n_nationkey", "left").join(sellers, "n_nationkey", "left").fillna(0, ["buyers", "sellers"])
    side = F.when((F.col("buyers") > 0) & (F.col("sellers") > 0), "both").when(F.col("buyers") > 0, "buyer").when(F.col("sellers") > 0, "seller").otherwise("none")
    return rows.groupBy("n_name").agg(F.sum("buyers").alias("buyers"), F.sum("sellers").alias("sellers"), F.max(side).alias("side"))


@query("jn_tolerance_overlay", """
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, max(b.l_quantity) AS overlay FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'A') a
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey = b.l_orderkey AND abs(a.l_extendedprice - b.l_extendedprice) <= 0.1 * greatest(a.l_extendedprice, b.l_extendedprice) GROUP BY 1, 2, 3, 4""")
def jn_tolerance_overlay(spark, d):
    lines = table(spark, d, "lineitem")
    a = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    b = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    near = F.abs(a.l_extendedprice - b.p) <= 0.1 * F.greatest(a.l_extendedprice, b.p)
    return a.join(b, (a.l_orderkey == b.k) & near, "left").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("q").alias("overlay"))


@query("jn_grouped_max", """
SELECT o_orderkey, CAST(round(m * 100) AS BIGINT) AS best_cents FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice * (1 - l_discount)) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'""")
def jn_grouped_max(spark, d):
    best = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("m"))
    return table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).join(best, "o_orderkey").select("o_orderkey", cents(F.col("m")).alias("best_cents"))


@query("jn_corr_first", """
SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS top_order FROM customer""")
def jn_corr_first(spark, d):
    orders = P.keep_top_one(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("top_order"))
