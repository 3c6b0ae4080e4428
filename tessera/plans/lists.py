"""List pages, filters, paging and top-k over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import predicates as P
from tessera.operators.aggregates import cents
from tessera.plans.registry import query
from tessera.sources.tables import micros, table


def page(df, order, number: int = 1, size: int = 50, most: int = 200):
    """Rows of one page in a total order; size is clamped to ``most``, the number to 1 or more."""
    size, number = min(max(size, 1), most), max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


@query("or_page_best_child", """
WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'),
best AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem l) WHERE rn = 1)
SELECT o_orderkey, epoch_us(o_orderdate) AS ordered_at, o_totalprice, l_partkey AS best_part, l_linenumber AS best_line, l_extendedprice AS best_price,
 (SELECT count(*) FROM f) AS total
FROM f JOIN best ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def or_page_best_child(spark, d):
    """Newest orders of a state and date range with their highest-value line, page 1 of 50, and the total count."""
    orders = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & P.half_open(F.col("o_orderdate"), "1995-01-01", "1999-01-01"))
    value = F.struct("l_extendedprice", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    # The page is cut first: the lines of its fifty orders are all that is aggregated.
    top = page(orders.join(lines.select("o_orderkey"), "o_orderkey", "left_semi"), [F.desc("o_orderdate"), F.desc("o_orderkey")])
    best = lines.join(F.broadcast(top.select("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.max_by(F.struct("l_partkey", "l_linenumber", "l_extendedprice"), value).alias("b"))
    total = orders.agg(F.count("*").alias("total"))
    rows = top.join(best, "o_orderkey").crossJoin(F.broadcast(total))
    rows = rows.select("o_orderkey", "o_orderdate", "o_totalprice", F.col("b.l_partkey").alias("best_part"), F.col("b.l_linenumber").alias("best_line"), F.col("b.l_extendedprice").alias("best_price"), "total")
    return rows.select("o_orderkey", micros(F.col("o_orderdate")).alias("ordered_at"), "o_totalprice", "best_part", "best_line", "best_price", "total")


@query("fl_status_window", """
SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS ordered_at, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-03-01'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50""")
def fl_status_window(spark, d):
    rows = table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & P.half_open(F.col("o_orderdate"), "1996-03-01", "1997-03-01"))
    return page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("ordered_at"), "o_totalprice")


@query("fl_token_any", """
SELECT p_partkey, p_name, p_type FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'blue', 'hot']) OR list_contains(string_split(p_type, ' '), 'STEEL')""")
def fl_token_any(spark, d):
    part = table(spark, d, "part")
    hit = P.any_token(F.split(F.lower("p_name"), " "), ["red", "blue", "hot"]) | P.any_token(F.split("p_type", " "), ["STEEL"])
    return part.where(hit).select("p_partkey", "p_name", "p_type")


@query("fl_semi_universe", """
WITH top AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM top))""")
def fl_semi_universe(spark, d):
    customer = table(spark, d, "customer")
    top = customer.groupBy("c_nationkey").count().orderBy(F.desc("count"), "c_nationkey").limit(5)
    keys = customer.join(top, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return P.semi_or_open(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


@query("fl_state_staleness", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND last >= TIMESTAMP '1998-01-01' THEN 'open' WHEN o_orderstatus = 'O' THEN 'stale' ELSE 'closed' END AS state
FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def fl_state_staleness(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    state = P.open_state(F.col("o_orderstatus") == "O", F.col("last"), F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").join(last, "o_orderkey").select("o_orderkey", state.alias("state"))


@query("fl_namesake", """
WITH f AS (SELECT p_partkey, p_brand, p_brand = 'Brand#1' AS exact FROM part WHERE p_brand LIKE 'Brand#1%')
SELECT p_partkey, p_brand FROM f WHERE exact OR NOT (SELECT coalesce(bool_or(exact), false) FROM f)""")
def fl_namesake(spark, d):
    return P.exact_else_prefix(table(spark, d, "part"), "p_brand", "Brand#1").select("p_partkey", "p_brand")


@query("fl_row_checks", """
WITH c AS (SELECT unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END,
 CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_shipdate < o_orderdate THEN 'early' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT reason, count(*) AS n FROM c GROUP BY 1""")
def fl_row_checks(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rules = {"large": F.col("l_quantity") > 45, "discount": F.col("l_discount") >= 0.1, "untaxed": F.col("l_tax") == 0, "early": F.col("l_shipdate") < F.col("o_orderdate")}
    return lines.select(F.explode(P.broken_rules(rules)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("fl_hide_list", """
SELECT l_returnflag, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('A', 'F', NULL), ('R', NULL, 3), (NULL, 'O', 1)) e(f, s, k)
 WHERE (f IS NULL OR f = l_returnflag) AND (s IS NULL OR s = l_linestatus) AND (k IS NULL OR k = l_linenumber)) GROUP BY 1""")
def fl_hide_list(spark, d):
    entries = spark.createDataFrame([("A", "F", None), ("R", None, 3), (None, "O", 1)], "l_returnflag string, l_linestatus string, l_linenumber int")
    return P.hidden(table(spark, d, "lineitem"), entries).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("fl_quality_gate", """
SELECT doc_id, CASE WHEN n_chars < 350 THEN 'short' WHEN regexp_matches(text, '[|]{1}.*[|].*[|]') THEN 'table' WHEN regexp_matches(lower(text), 'licensed under|all rights reserved') THEN 'licence'
 WHEN regexp_matches(text, '[a-z0-9._]+@[a-z0-9.]+') THEN 'contact' END AS reason FROM documents""")
def fl_quality_gate(spark, d):
    rules = {
        "short": F.col("n_chars") < 350,
        "table": F.col("text").rlike("[|]{1}.*[|].*[|]"),
        "licence": F.lower("text").rlike("licensed under|all rights reserved"),
        "contact": F.col("text").rlike("[a-z0-9._]+@[a-z0-9.]+"),
    }
    return table(spark, d, "documents").select("doc_id", P.first_rule(rules).alias("reason"))


@query("fl_unranked_split", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity > 45 AS unranked,
 CASE WHEN l_quantity > 45 THEN 0 ELSE rank() OVER (PARTITION BY l_quantity > 45 ORDER BY l_extendedprice DESC) END AS position
FROM lineitem""")
def fl_unranked_split(spark, d):
    """Flagged rows leave the ranking but stay in the result."""
    rows = table(spark, d, "lineitem").withColumn("unranked", F.col("l_quantity") > 45)
    places = P.ranks(rows.where(~F.col("unranked")), "l_extendedprice")
    ranked = rows.join(places, "l_extendedprice", "left")
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "unranked", F.when(~F.col("unranked"), F.col("place")).otherwise(0).alias("position"))


@query("or_typeahead", """
WITH c AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1)
SELECT name, n, CASE WHEN name = 'hot' THEN 3 WHEN starts_with(name, 'hot') THEN 2 ELSE 1 END AS score FROM c
WHERE contains(name, 'hot') OR starts_with(name, 'b') ORDER BY score DESC, n DESC, name LIMIT 20""")
def or_typeahead(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    score = F.when(F.col("name") == "hot", 3).when(F.col("name").startswith("hot"), 2).otherwise(1)
    found = names.where(F.col("name").contains("hot") | F.col("name").startswith("b")).withColumn("score", score)
    return found.orderBy(F.desc("score"), F.desc("n"), "name").limit(20)


@query("or_rank_filter_limit", """
WITH r AS (SELECT event_id, ts, event_type, value, (CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END) + (CASE WHEN value > 100 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS score
 FROM events ORDER BY ts DESC, event_id DESC LIMIT 600)
SELECT event_id, event_type, score FROM r WHERE score >= 2 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def or_rank_filter_limit(spark, d):
    """The newest 600 events, scored, those of little importance left out, at most 50."""
    rules = {"purchase": F.col("event_type") == "purchase", "large": F.col("value") > 100, "error": F.col("event_type") == "error"}
    points = {"purchase": 2, "large": 1, "error": 1}
    score = sum((F.when(c, points[n]).otherwise(0) for n, c in rules.items()), F.lit(0))
    recent = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(600).withColumn("score", score)
    return recent.where("score >= 2").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "score")


@query("sk_export_chunks", """
SELECT CAST((rn - 1) // 500 AS BIGINT) AS chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""")
def sk_export_chunks(spark, d):
    """Fixed-size chunks in key order. Row numbers come from slices with running offsets, not from one sorted task."""
    ranked = P.row_numbers(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").withColumn("chunk", F.floor((F.col("place") - 1) / 500))
    return ranked.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("th_last_turns", """
SELECT conv_id, role, turn AS last_turn, text, n_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id, role) AS n_turns FROM conversations) WHERE rn = 1""")
def th_last_turns(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id", "role")
    return turns.agg(F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("text"), F.count("*").alias("n_turns"))


@query("sc_lookup_keys", """
SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7 OR l_partkey = 11)""")
def sc_lookup_keys(spark, d):
    """Fetch by a key set: a semi-join instead of chunks of IN lists."""
    keys = table(spark, d, "lineitem").where(F.col("l_partkey").isin(7, 11)).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("total_cents"))
