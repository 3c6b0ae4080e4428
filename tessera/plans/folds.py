"""Deals, studies, copies, latest rows and queues over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import folds as O
from tessera.operators.aggregates import cents
from tessera.plans.registry import query
from tessera.sources.tables import micros, table

HOUR = 3_600_000_000


@query("wn_copies", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
k AS (SELECT event_id, user_id, event_type, t, rn FROM e WHERE rn = 1 UNION ALL
 SELECT n.event_id, n.user_id, n.event_type, n.t, n.rn FROM k JOIN LATERAL (SELECT e.event_id, e.user_id, e.event_type, e.t, e.rn FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.rn > k.rn AND e.t - k.t > {24 * HOUR} ORDER BY e.rn LIMIT 1) n ON true)
SELECT event_id FROM k""")
def wn_copies(spark, d):
    """Events of a user and kind that aren't within a day of the last one kept."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("t"))
    return O.without_copies(rows, ["user_id", "event_type"], "t", "event_id", 24 * HOUR).select("event_id")


def releases(spark, d):
    """Orders as releases of deals: role, kind, amount and price follow from the order."""
    role = F.when(F.col("o_orderstatus") == "O", "announcement").when(F.col("o_orderstatus") == "P", "upsize").otherwise("close")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "units").otherwise("notes")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("ticker"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), role.alias("role"), kind.alias("kind"))
    return rows.join(table(spark, d, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("amount"), (F.col("o_orderkey") % 4).alias("price")), "o_orderkey")


@query("wn_deals")
def wn_deals(spark, d):
    """Releases folded into deals by points, closes of two deals split between them."""
    return O.deals(releases(spark, d), ["ticker"], "day", "o_orderkey").select("ticker", "o_orderkey", "deal", "deal_two")


@query("wn_studies", """
WITH s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(round(l_extendedprice / pow(10.0, floor(log10(l_extendedprice)) - 2)) AS BIGINT) AS figures, CAST(floor(log10(l_extendedprice)) AS BIGINT) AS size, l_returnflag FROM lineitem WHERE l_extendedprice > 0),
f AS (SELECT *, CASE WHEN l_quantity - lag(l_quantity) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY l_suppkey, figures, size ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey, figures, size ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS chain FROM f)
SELECT l_suppkey, figures, size, CAST(chain AS BIGINT) AS chain, count(*) AS rows, count(DISTINCT l_returnflag) AS kinds, min(l_quantity) AS low, max(l_quantity) AS high FROM c GROUP BY 1, 2, 3, 4""")
def wn_studies(spark, d):
    """Rows of a company whose value agrees to three figures and whose rate follows within two points are one study."""
    value = F.col("l_extendedprice")
    size = F.floor(F.log10(value))
    rows = table(spark, d, "lineitem").where("l_extendedprice > 0").withColumns({"size": size.cast("bigint"), "figures": F.round(value / F.pow(F.lit(10.0), size - 2)).cast("bigint"), "id": F.struct("l_orderkey", "l_linenumber", "l_partkey")})
    rows = rows.select("l_suppkey", "figures", "size", "l_quantity", "id", "l_returnflag")
    chained = O.near_chains(rows, ["l_suppkey", "figures", "size"], "l_quantity", "id", 2)
    return chained.groupBy("l_suppkey", "figures", "size", "chain").agg(F.count("*").alias("rows"), F.count_distinct("l_returnflag").alias("kinds"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("wn_filled_latest", """
WITH r AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM r)
SELECT o_custkey, arg_min(price, age) FILTER (WHERE price IS NOT NULL) AS price, arg_min(priority, age) FILTER (WHERE priority IS NOT NULL) AS priority, count(*) AS rows,
 concat_ws(',', CASE WHEN min(age) FILTER (WHERE price IS NOT NULL) > 1 THEN 'price' END, CASE WHEN min(age) FILTER (WHERE priority IS NOT NULL) > 1 THEN 'priority' END) AS from_older FROM p GROUP BY 1""")
def wn_filled_latest(spark, d):
    """The latest row of a customer with its gaps filled from older ones, and which columns those are."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"))
    return O.filled_latest(rows, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["price", "priority"])


@query("wn_filled_chain", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS priority,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age, o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS fresh FROM orders),
s AS (SELECT r.*, coalesce(age <= min(age) FILTER (WHERE fresh) OVER (PARTITION BY o_custkey), true) AS reached FROM r),
g AS (SELECT o_custkey, arg_min(o_orderkey, age) AS newest, min_by(o_orderstatus, age) = 'O' AS is_open, max(price) FILTER (WHERE age = 1) AS own_price, max(priority) FILTER (WHERE age = 1) AS own_priority,
 arg_min(price, age) FILTER (WHERE price IS NOT NULL AND reached) AS older_price, arg_min(o_orderkey, age) FILTER (WHERE price IS NOT NULL AND reached) AS price_from,
 arg_min(priority, age) FILTER (WHERE priority IS NOT NULL AND reached AND o_orderstatus <> 'F') AS older_priority, arg_min(o_orderkey, age) FILTER (WHERE priority IS NOT NULL AND reached AND o_orderstatus <> 'F') AS priority_from, count(*) AS rows FROM s GROUP BY 1)
SELECT o_custkey, newest AS o_orderkey, coalesce(own_price, CASE WHEN NOT is_open THEN older_price END) AS price, coalesce(own_priority, older_priority) AS priority, rows,
 concat_ws(',', CASE WHEN own_price IS NULL AND NOT is_open AND price_from IS NOT NULL THEN 'price:' || price_from END, CASE WHEN own_priority IS NULL AND priority_from IS NOT NULL THEN 'priority:' || priority_from END) AS provenance FROM g""")
def wn_filled_chain(spark, d):
    """The newest order of a customer filled from older ones back to a fresh start; an open order's price stays blank, a closed
    order gives no priority."""
    price, priority = F.when(F.col("o_orderkey") % 4 == 1, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))
    rows = table(spark, d, "orders").withColumns({"price": price, "priority": priority})
    status = F.col("o_orderstatus")
    made = O.filled_chain(rows, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey", ["price", "priority"], {"priority": status == "F"}, (status == "P") & (F.col("o_orderkey") % 5 == 0), {"price": status == "O"})
    told = F.array_join(F.transform("provenance", lambda p: F.concat(p.field, F.lit(":"), p.source)), ",")
    return made.withColumn("provenance", told)


@query("wn_ordered_distinct", """
WITH f AS (SELECT o_custkey, o_orderpriority, min(struct_pack(a := o_orderdate, b := o_orderkey)) AS first FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY first) AS seen FROM f GROUP BY 1""")
def wn_ordered_distinct(spark, d):
    """Values of a customer in the order they were first seen, each once; first places are aggregated before they are listed."""
    first = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    listed = first.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("first", "o_orderpriority"))).alias("x"))
    return listed.select("o_custkey", F.array_join(F.transform("x", lambda v: v.o_orderpriority), "|").alias("seen"))


@query("wn_same_day_rank", """
SELECT o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS day, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS turn FROM orders""")
def wn_same_day_rank(spark, d):
    """Releases of a day: the announcement before the upsize before the close."""
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    w = Window.partitionBy("o_custkey", "day").orderBy(rank, "o_orderkey")
    return table(spark, d, "orders").withColumn("day", day).select("o_custkey", "day", "o_orderkey", F.row_number().over(w).cast("bigint").alias("turn"))


@query("wn_fair_queue", """
WITH q AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS tries, max(ts) AS last FROM events GROUP BY 1), t AS (SELECT user_id, tries, row_number() OVER (ORDER BY tries, last DESC, user_id) - 1 AS place FROM q ORDER BY place LIMIT 40), n AS (SELECT count(*) AS n FROM t)
SELECT user_id, tries, (place - 13 + n) % n AS turn FROM t, n""")
def wn_fair_queue(spark, d):
    """The forty users with the fewest tries, newest first, dealt round from a cursor."""
    page = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("tries"), F.max("ts").alias("last")).orderBy("tries", F.desc("last"), "user_id").limit(40)
    place = F.row_number().over(Window.orderBy("tries", F.desc("last"), "user_id")) - 1  # forty rows
    counted = page.withColumn("place", place).withColumn("n", F.count("*").over(Window.partitionBy()))
    return counted.select("user_id", "tries", ((F.col("place") - 13 + F.col("n")) % F.col("n")).alias("turn"))


@query("jn_greedy_pairs")
def jn_greedy_pairs(spark, d):
    """Predicted rows (odd orders) paired with labelled ones (even orders) of a customer: each label in turn takes the free row with the
    most points, two for the priority, two for a price within a tenth; every row is used once."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", cents(F.col("o_totalprice")).alias("amount"))
    return O.greedy_pairs(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey", "o_orderpriority", "amount")
