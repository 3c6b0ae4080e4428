"""Aggregations, facets, time buckets, records and evaluation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.plans.registry import query
from tessera.sources.tables import micros, table

VOCABULARY = ["STEEL", "BRASS", "TIN", "COPPER", "NICKEL", "WOOD"]


@query("ag_explode_counts", """
WITH v AS (SELECT unnest(['STEEL', 'BRASS', 'TIN', 'COPPER', 'NICKEL', 'WOOD']) AS tag, unnest(range(6)) AS place), c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1)
SELECT v.tag, v.place, coalesce(n, 0) AS n FROM v LEFT JOIN c ON v.tag = c.tag""")
def ag_explode_counts(spark, d):
    """Tag facet in a fixed order with zeros."""
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(VOCABULARY)], "tag string, place long")
    counts = table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return A.with_zeros(counts, vocabulary, ["tag"], "n").select("tag", "place", "n")


@query("ag_conditional", """
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(DISTINCT CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) AS view_days,
 CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END), 0) AS BIGINT) AS cents FROM events GROUP BY 1""")
def ag_conditional(spark, d):
    is_purchase = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(is_purchase).alias("purchases"),
        F.count_distinct(F.when(F.col("event_type") == "view", F.to_date("ts"))).alias("view_days"),
        F.coalesce(F.sum(F.when(is_purchase, A.cents(F.col("value")))), F.lit(0)).alias("cents"),
    )


@query("ag_topn_groups", """
SELECT user_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'day' ELSE 'evening' END AS part, count(*) AS views, count(DISTINCT event_type) AS kinds
FROM events GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY views DESC, user_id, part LIMIT 40""")
def ag_topn_groups(spark, d):
    hour = F.hour("ts")
    part = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "day").otherwise("evening")
    groups = table(spark, d, "events").groupBy("user_id", part.alias("part")).agg(F.count("*").alias("views"), F.count_distinct("event_type").alias("kinds"))
    return groups.where("views >= 5").orderBy(F.desc("views"), "user_id", "part").limit(40)


def _gap_sql(source, at, unit, where):
    return f"""WITH g AS (SELECT date_trunc('{unit}', {at}) AS b, count(*) AS n FROM {source} WHERE {where} GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(b) FROM g)::TIMESTAMP, (SELECT max(b) FROM g)::TIMESTAMP, INTERVAL 1 {unit})) AS b)
SELECT epoch_us(s.b) AS bucket, coalesce(n, 0) AS n FROM s LEFT JOIN g ON s.b = g.b"""


def _gap(spark, d, source, at, unit, where):
    rows = A.gap_filled(table(spark, d, source).where(where), F.col(at), unit, {"n": F.count("*")})
    return rows.select(micros(F.col("bucket")).alias("bucket"), "n")


@query("ag_gapfill_hour", _gap_sql("events", "ts", "hour", "true"))
def ag_gapfill_hour(spark, d):
    return _gap(spark, d, "events", "ts", "hour", "true")


@query("ag_gapfill_day", _gap_sql("orders", "o_orderdate", "day", "true"))
def ag_gapfill_day(spark, d):
    return _gap(spark, d, "orders", "o_orderdate", "day", "true")


@query("ag_gapfill_month", _gap_sql("orders", "o_orderdate", "month", "true"))
def ag_gapfill_month(spark, d):
    return _gap(spark, d, "orders", "o_orderdate", "month", "true")


@query("ag_gapfill_month_all", _gap_sql("orders", "o_orderdate", "month", "true"))
def ag_gapfill_month_all(spark, d):
    return _gap(spark, d, "orders", "o_orderdate", "month", "true")


@query("ag_eav_pivot", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2, 3, 4""")
def ag_eav_pivot(spark, d):
    """Lines as record-field-value rows, and back."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    named = table(spark, d, "lineitem").select(*key, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return A.pivot_back(A.melt(named, key, ["quantity", "discount", "tax"]), key, ["quantity", "discount", "tax"])


@query("ag_coverage_stats", """
SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled, CAST(count(l.doc_id) AS DOUBLE) / nullif(count(*), 0) AS share, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(l.doc_id), 0) AS good
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def ag_coverage_stats(spark, d):
    labels = table(spark, d, "labels").withColumn("known", F.lit(1))
    joined = table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").groupBy("lang")
    n = joined.agg(F.count("*").alias("docs"), F.count("known").alias("labelled"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("g"))
    return n.select("lang", "docs", "labelled", F.try_divide("labelled", "docs").alias("share"), F.try_divide("g", "labelled").alias("good"))


@query("ag_multi_facets", """
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END, count(*) FROM orders GROUP BY 2""")
def ag_multi_facets(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    dims = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "segment": F.col("c_mktsegment"), "size": F.when(F.col("o_totalprice") > 200000, "large").otherwise("small")}
    return A.facets(rows, dims)


@query("ag_family_facet", """
SELECT string_split(p_type, ' ')[-1] AS family, count(DISTINCT l_orderkey) AS orders, count(*) AS lines, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def ag_family_facet(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    family = F.element_at(F.split("p_type", " "), -1)
    return lines.groupBy(family.alias("family")).agg(F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("ag_signal_map", """
SELECT coalesce(a.k, b.k, c.k) AS key, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events, coalesce(balance, 0) AS in_debt FROM (SELECT o_custkey AS k, count(DISTINCT o_orderdate) AS orders FROM orders GROUP BY 1) a
FULL JOIN (SELECT user_id AS k, count(DISTINCT event_type) AS events FROM events GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT c_custkey AS k, 1 AS balance FROM customer WHERE c_acctbal < 0) c ON c.k = coalesce(a.k, b.k)""")
def ag_signal_map(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count_distinct("o_orderdate").alias("orders"))
    b = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count_distinct("event_type").alias("events"))
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.lit(1).alias("in_debt"))
    return a.join(b, "key", "full").join(c, "key", "full").fillna(0, ["orders", "events", "in_debt"])


@query("ag_digest", """
SELECT l_orderkey, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', l_partkey, l_suppkey, l_linenumber, l_returnflag)), 1, 15) AS BIGINT)) AS VARCHAR) AS hash_sum FROM lineitem GROUP BY 1""")
def ag_digest(spark, d):
    """Order-free digest of each order's lines, by a hash that both engines have."""
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")])
    number = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return table(spark, d, "lineitem").select("l_orderkey", number.alias("h")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("hash_sum"))


@query("ag_table_fingerprint", """
SELECT 'orders' AS name, count(*) AS n, max(o_orderkey) AS top, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'events', count(*), max(event_id), CAST(sum(event_id) AS BIGINT) FROM events""")
def ag_table_fingerprint(spark, d):
    def one(name, key):
        return table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max(key).alias("top"), F.sum(key).alias("total"))

    return one("orders", "o_orderkey").unionByName(one("events", "event_id"))


@query("ag_capture_rate", """
WITH e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS rn FROM e WHERE n >= 10)
SELECT strftime(day, '%Y-%m-%d') AS day, n, ok, CAST(ok AS DOUBLE) / n AS rate, rn <= 3 AS judged FROM q""")
def ag_capture_rate(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok")).where("n >= 10")
    judged = daily.orderBy(F.desc("day")).limit(3).select("day", F.lit(True).alias("j"))
    return daily.join(judged, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "ok", (F.col("ok") / F.col("n")).alias("rate"), F.coalesce("j", F.lit(False)).alias("judged"))


@query("ag_letterhead", """
WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT source, line, count(*) AS docs FROM l WHERE length(line) BETWEEN 10 AND 200 GROUP BY 1, 2 HAVING count(*) >= 4""")
def ag_letterhead(spark, d):
    """Lines that many documents of a source share."""
    lines = table(spark, d, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line"))
    return lines.where(F.length("line").between(10, 200)).groupBy("source", "line").agg(F.count("*").alias("docs")).where("docs >= 4")


@query("ag_pair_range", """
SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2""")
def ag_pair_range(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


JUDGED_SQL = """SELECT l.quality = 1 AS actual, NOT (regexp_matches(text, '[|].*[|].*[|]') OR length(regexp_replace(text, '[^#$%&*!]', '', 'g')) * 20 > length(text)) AS predicted, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _judged(spark, d):
    text = F.col("text")
    junk = text.rlike("[|].*[|].*[|]") | (F.length(F.regexp_replace(text, "[^#$%&*!]", "")) * 20 > F.length(text))
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((F.col("quality") == 1).alias("actual"), (~junk).alias("predicted"), "lang")


@query("ev_precision_recall", f"""
WITH j AS ({JUDGED_SQL}), c AS (SELECT count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT actual) AS tn FROM j)
SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall FROM c""")
def ev_precision_recall(spark, d):
    return A.precision_recall(_judged(spark, d), F.col("predicted"), F.col("actual"))


@query("ev_gate", f"""
WITH j AS ({JUDGED_SQL}), c AS (SELECT lang, count(*) AS items, CAST(count(*) FILTER (WHERE predicted AND actual) AS DOUBLE) / nullif(count(*) FILTER (WHERE predicted), 0) AS p FROM j GROUP BY 1)
SELECT lang, items, coalesce(p >= 0.9 AND items >= 40, false) AS passed, CASE WHEN items < 40 THEN 'few items' WHEN p IS NULL OR p < 0.9 THEN 'precision' END AS reason FROM c""")
def ev_gate(spark, d):
    by = _judged(spark, d).groupBy("lang").agg(F.count("*").alias("items"), F.try_divide(F.count_if(F.col("predicted") & F.col("actual")), F.count_if("predicted")).alias("p"))
    fine = F.coalesce((F.col("p") >= 0.9) & (F.col("items") >= 40), F.lit(False))
    return by.select("lang", "items", fine.alias("passed"), F.when(F.col("items") < 40, "few items").when(F.col("p").isNull() | (F.col("p") < 0.9), "precision").alias("reason"))


@query("ag_name_popularity", """
SELECT name, n FROM (SELECT unnest(string_split(p_name, ' ')) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, name LIMIT 40) ORDER BY name""")
def ag_name_popularity(spark, d):
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.where("n >= 5").orderBy(F.desc("n"), "name").limit(40).orderBy("name")


@query("ag_best_of_ratio", """
SELECT o_custkey, max(l_extendedprice / l_quantity) AS best_unit, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 GROUP BY 1""")
def ag_best_of_ratio(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("o_custkey").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("best_unit"), F.count("*").alias("lines"))


@query("ag_running_share", """
WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS b, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY 1, 2)
SELECT p, epoch_us(b) AS bucket, c, CAST(sum(c) OVER (PARTITION BY p ORDER BY b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM m""")
def ag_running_share(spark, d):
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    sums = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), month.alias("b")).agg(F.sum(A.cents(F.col("o_totalprice"))).alias("c"))
    return sums.select("p", micros(F.col("b")).alias("bucket"), "c", F.sum("c").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
