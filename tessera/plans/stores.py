"""Sinks, ids, schedules, dictionary matches and small set queries on the driver's tables."""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import stores as S
from tessera.operators.aggregates import cents
from tessera.plans.registry import query
from tessera.sources.attach import attach
from tessera.sources.tables import micros, shared_folder, table

DAY = 86_400_000_000


@query("sk_undo_restore", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def sk_undo_restore(spark, d):
    """Cancelled orders are removed into an undo log and put back."""
    stay, log = S.removed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderstatus") == "P", "o_orderkey")
    return S.restored(stay, log)


@query("jn_attached", """
WITH v AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderkey % 7 = 0 THEN 'odd' ELSE 'plain' END AS verdict FROM orders WHERE o_orderkey % 5 > 0)
SELECT o_orderstatus, coalesce(verdict, 'none') AS verdict, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders LEFT JOIN v USING (o_orderkey) GROUP BY 1, 2""")
def jn_attached(spark, d):
    """Orders of one database with the verdicts of another, in one SQL statement."""
    verdict = F.when(F.col("o_totalprice") > 200_000, "large").when(F.col("o_orderkey") % 7 == 0, "odd").otherwise("plain")
    folder = shared_folder(spark, "reviews")
    table(spark, d, "orders").where("o_orderkey % 5 > 0").select("o_orderkey", verdict.alias("verdict")).write.parquet(f"{folder}/verdicts.parquet")
    live, kept = f"live_{zlib.crc32(d.encode()):08x}", f"kept_{folder.rsplit('-', 1)[1]}"
    attach(spark, live, d)
    attach(spark, kept, folder)
    return spark.sql(f"""
        SELECT o.o_orderstatus, coalesce(v.verdict, 'none') AS verdict, count(*) AS n, sum(cast(round(o.o_totalprice * 100) AS bigint)) AS total_cents
        FROM {live}.orders o LEFT JOIN {kept}.verdicts v ON o.o_orderkey = v.o_orderkey GROUP BY 1, 2""")


@query("sk_envelopes", """
SELECT event_id, 'log.' || event_type AS event_type, CAST(user_id AS VARCHAR) AS user_id FROM events""")
def sk_envelopes(spark, d):
    made = S.envelopes(table(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id", F.concat(F.lit("log."), F.col("event_type")))
    return made.select("event_id", "event_type", F.get_json_object("payload", "$.user_id").alias("user_id"))


@query("sk_surrogate_ids", """
WITH k AS (SELECT p_name, row_number() OVER (ORDER BY substr(md5(p_name), 1, 15), p_name) AS id FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 3)),
f AS (SELECT p_name, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY substr(md5(p_name), 1, 15), p_name) AS id FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM k)))
SELECT p_partkey, p_name, coalesce(k.id, f.id) AS surrogate_id FROM part LEFT JOIN k USING (p_name) LEFT JOIN f USING (p_name)""")
def sk_surrogate_ids(spark, d):
    """Ids of part names: those of small parts are known, the others are new and follow without gaps."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    known = S.stable_ids(part.where("p_size < 3").select("p_name").distinct(), ["p_name"], spark.createDataFrame([], "p_name string, surrogate_id long"))
    return S.stable_ids(part, ["p_name"], known).select("p_partkey", "p_name", "surrogate_id")


@query("sk_rename_map", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def sk_rename_map(spark, d):
    names = spark.createDataFrame([("1-URGENT", "now"), ("5-LOW", "later")], "old string, new string")
    return S.renamed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", names)


@query("sr_feed_gaps", """
WITH f AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, list(DISTINCT o_orderpriority) AS ids FROM orders GROUP BY 1, 2), b AS (SELECT *, lag(ids) OVER (PARTITION BY o_custkey ORDER BY m) AS before FROM f)
SELECT o_custkey, epoch_us(m) AS month FROM b WHERE before IS NOT NULL AND NOT list_has_any(before, ids)""")
def sr_feed_gaps(spark, d):
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    reads = table(spark, d, "orders").groupBy("o_custkey", month.alias("m")).agg(F.collect_set("o_orderpriority").alias("ids"))
    return S.feed_gaps(reads, "o_custkey", "m", "ids").select("o_custkey", micros(F.col("m")).alias("month"))


@query("sr_pending_newest", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def sr_pending_newest(spark, d):
    """Work without a run yet, newest first, one page."""
    runs = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(runs, "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey")


@query("jn_dictionary_match", f"""
WITH w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM documents)),
g AS (SELECT doc_id, pos, [w, w || ' ' || lead(w, 1) OVER p, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p] AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, max(CASE WHEN g[3] IN ('that the thing') THEN 3 WHEN g[2] IN ('the thing', 'of the', 'that the') THEN 2 WHEN g[1] IN ('thing', 'apache') THEN 1 END) AS n FROM g GROUP BY 1, 2 HAVING n IS NOT NULL),
c AS (SELECT *, max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM f)
SELECT doc_id, n, count(*) AS finds FROM c WHERE covered IS NULL OR covered <= pos GROUP BY 1, 2""")
def jn_dictionary_match(spark, d):
    names = spark.createDataFrame([(n,) for n in ("that the thing", "the thing", "of the", "that the", "thing", "apache")], "name string")
    found = S.dictionary_matches(table(spark, d, "documents"), "doc_id", X.words(F.col("text")), names, 3)
    return found.groupBy("doc_id", F.size(F.split("name", " ")).alias("n")).agg(F.count("*").alias("finds"))


@query("jn_payment_schedule", f"""
WITH pay AS (SELECT o_orderkey, o_custkey, o_orderdate AS at, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F'), due AS (SELECT o_orderkey, o_custkey, o_orderdate AS at, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'O'),
m AS (SELECT p.o_orderkey, due.o_orderkey AS due_key, row_number() OVER (PARTITION BY p.o_orderkey ORDER BY abs(epoch_us(p.at) - epoch_us(due.at)), due.o_orderkey) AS rn FROM pay p JOIN due ON p.o_custkey = due.o_custkey
 AND abs(epoch_us(p.at) - epoch_us(due.at)) <= {120 * DAY} AND abs(p.amount - due.amount) <= 0.1 * greatest(p.amount, due.amount))
SELECT o_orderkey, due_key FROM m WHERE rn = 1""")
def jn_payment_schedule(spark, d):
    """Paid orders with the nearest open order of the customer within 120 days and a tenth of the amount; equi-join on time buckets."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("at"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    width = 120 * DAY
    pay = orders.where("o_orderstatus = 'F'").withColumn("bucket", F.floor(F.col("at") / width))
    near = F.explode(F.sequence(F.floor(F.col("at") / width) - 1, F.floor(F.col("at") / width) + 1))
    due = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("due_key"), "o_custkey", F.col("at").alias("due_at"), F.col("amount").alias("due"), near.alias("bucket"))
    fits = (F.abs(F.col("at") - F.col("due_at")) <= width) & (F.abs(F.col("amount") - F.col("due")) <= 0.1 * F.greatest("amount", "due"))
    best = pay.join(due, ["o_custkey", "bucket"]).where(fits).groupBy("o_orderkey").agg(F.min(F.struct(F.abs(F.col("at") - F.col("due_at")).alias("gap"), "due_key")).alias("b"))
    return best.select("o_orderkey", "b.due_key")


@query("jn_capture_pairs", f"""
WITH e AS (SELECT * FROM events WHERE event_type = 'error'), m AS (SELECT e.event_id, v.event_id AS guard, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(v.ts)), v.ts, v.event_id) AS rn
 FROM e JOIN events v ON v.user_id = e.user_id AND v.event_type <> 'error' AND abs(epoch_us(e.ts) - epoch_us(v.ts)) <= 900000000)
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS errors, count(guard) AS paired FROM e LEFT JOIN m ON e.event_id = m.event_id AND rn = 1 GROUP BY 1""")
def jn_capture_pairs(spark, d):
    from tessera.operators.matching import nearest_match

    events = table(spark, d, "events").withColumn("at", micros(F.col("ts")))
    errors = events.where("event_type = 'error'")
    pairs = nearest_match(errors, events.where("event_type <> 'error'"), "user_id", "at", "event_id", 900_000_000, 900_000_000)
    joined = errors.join(pairs, F.col("event_id") == F.col("left_id"), "left")
    return joined.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("errors"), F.count("right_id").alias("paired"))


@query("wn_best_in_group", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_extendedprice * (1 - l_discount) DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE rn = 1""")
def wn_best_in_group(spark, d):
    """The best line of an order: returned ones first, then by value; a pool to fall back on."""
    value = F.struct((F.col("l_returnflag") == "R").cast("int"), F.col("l_extendedprice") * (1 - F.col("l_discount")), -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "l_partkey", "l_suppkey"), value).alias("b"))
    return best.select("l_orderkey", "b.*")


@query("wn_superseded", """
SELECT o_orderkey, coalesce(nx, -1) AS closed_by FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nx, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nd, o_orderdate FROM orders)
WHERE nx IS NULL OR epoch_us(nd) - epoch_us(o_orderdate) <= 31536000000000""")
def wn_superseded(spark, d):
    """Orders closed by the next one of the customer and priority within a year, and those still open."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").withColumns({"nx": F.lead("o_orderkey").over(w), "gap": micros(F.lead("o_orderdate").over(w)) - micros(F.col("o_orderdate"))})
    return rows.where(F.col("nx").isNull() | (F.col("gap") <= 365 * DAY)).select("o_orderkey", F.coalesce("nx", F.lit(-1)).alias("closed_by"))


@query("st_word_difference", """
WITH p AS (SELECT p_brand, list_distinct(flatten(list(string_split(p_type, ' ')))) AS a FROM part WHERE p_size <= 5 GROUP BY 1), q AS (SELECT p_brand, list_distinct(flatten(list(string_split(p_type, ' ')))) AS b FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p.p_brand, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') AS words FROM p JOIN q ON p.p_brand = q.p_brand""")
def st_word_difference(spark, d):
    """Words that only one of a brand's small and large parts have."""
    part = table(spark, d, "part").withColumn("w", F.split("p_type", " "))
    words = lambda cond, name: part.where(cond).groupBy("p_brand").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias(name))
    both = words("p_size <= 5", "a").join(words("p_size > 45", "b"), "p_brand")
    return both.select("p_brand", F.array_join(F.array_sort(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))), " ").alias("words"))


@query("tx_near_names", "SELECT DISTINCT a.w AS a, b.w AS b FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) a JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) b ON a.w < b.w AND levenshtein(a.w, b.w) <= 2")
def tx_near_names(spark, d):
    """Distinct words of part names within two edits. Candidates share a word with up to two letters left out, not all pairs."""
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()

    def cut(x, n):
        shorter = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.concat(F.array(x), shorter if n == 1 else F.flatten(F.transform(shorter, lambda s: F.when(F.length(s) > 0, cut(s, 1)).otherwise(F.array(s)))))

    keyed = names.select("w", F.explode(F.array_distinct(cut(F.col("w"), 2))).alias("k"))
    pairs = keyed.select(F.col("w").alias("a"), "k").join(keyed.select(F.col("w").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") <= 2)


@query("ag_event_periods", """
SELECT user_id, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(DISTINCT date_trunc('week', ts)) AS weeks, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""")
def ag_event_periods(spark, d):
    at = micros(F.col("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count_distinct(F.date_trunc("week", "ts")).alias("weeks"), F.sum(cents(F.col("value"))).alias("cents"))
