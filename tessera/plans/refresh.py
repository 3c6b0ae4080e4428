"""Sinks, sources, versions, retries, marks and recency over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import facts as FA
from tessera.operators import sync as S
from tessera.operators.aggregates import cents
from tessera.plans.registry import query
from tessera.sources import tables as T
from tessera.sources.tables import micros, table

HOUR = 3_600_000_000


@query("sk_upsert", """
SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey % 5 = 0""")
def sk_upsert(spark, d):
    """Edits of every fifth order, new or known: prices change, the stored status of known rows stays."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    edits = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus")).otherwise(F.lit("new")).alias("o_orderstatus"))
    return T.upsert(orders.where("o_orderkey % 7 > 0"), edits, ["o_orderkey"], ["o_orderstatus"])


@query("sk_replace_group", """
SELECT l_orderkey, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey % 6 > 0 UNION ALL SELECT l_orderkey, l_quantity * 2 FROM lineitem WHERE l_orderkey % 6 = 0 AND l_linenumber > 1) GROUP BY 1""")
def sk_replace_group(spark, d):
    """The facts of some orders written anew, twice: the second time changes nothing. Orders without facts left stay empty."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    gone = lines.where("l_orderkey % 6 = 0").select("l_orderkey").distinct()
    batch = lines.where("l_orderkey % 6 = 0 and l_linenumber > 1").withColumn("l_quantity", F.col("l_quantity") * 2)
    rest = lines.join(gone, "l_orderkey", "left_anti")
    store = FA.replaced(FA.replaced(rest, batch, ["l_orderkey"]), batch, ["l_orderkey"])
    return store.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("sk_status_change", """
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_custkey % 10 = 1 THEN 'rejected' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 100 <> 9""")
def sk_status_change(spark, d):
    """A status set for the rows of a key frame, and rows deleted by id."""
    keys = table(spark, d, "customer").where("c_acctbal < 0 or c_custkey % 10 = 1").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    marked = orders.join(keys, "o_custkey", "left")
    gone = orders.where("o_orderkey % 100 = 9").select("o_orderkey")
    return marked.join(gone, "o_orderkey", "left_anti").select("o_orderkey", F.when(F.col("hit") | (F.col("o_custkey") % 10 == 1), "rejected").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("sc_envelopes", """
SELECT event_type, count(*) FILTER (WHERE value <= 100 AND event_id % 11 > 0) AS fine, count(*) FILTER (WHERE NOT (value <= 100 AND event_id % 11 > 0)) AS quarantined FROM events GROUP BY 1""")
def sc_envelopes(spark, d):
    """A folder of JSON lines read back: envelopes without an id or with a confidence beyond 0..1 are set aside."""
    folder = T.shared_folder(spark, "envelopes")
    made = table(spark, d, "events").select(F.to_json(F.struct(F.when(F.col("event_id") % 11 > 0, F.col("event_id").cast("string")).alias("event_id"), "event_type", (F.col("value") / 100).alias("confidence"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("payload"))).alias("value"))
    made.write.text(folder)
    fine, aside = T.envelopes(spark, folder)
    both = fine.select("event_type", F.lit(1).alias("ok")).union(aside.select("event_type", F.lit(0).alias("ok")))
    return both.groupBy("event_type").agg(F.sum("ok").alias("fine"), F.sum(1 - F.col("ok")).alias("quarantined"))


@query("sc_sources", """
SELECT 'rss' AS source, count(*) AS n, count(*) FILTER (WHERE page_id % 3 > 0) AS dated FROM pages UNION ALL SELECT 'envelopes', count(*), count(*) FROM pages""")
def sc_sources(spark, d):
    """The pages as an RSS feed and as envelopes, each read by its registered source into the same columns."""
    feed, drop = T.shared_folder(spark, "rss"), T.shared_folder(spark, "drop")
    when = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    pages = table(spark, d, "pages").select("page_id", "url", when.alias("day"))
    item = F.concat(F.lit("<item><title>page "), F.col("page_id").cast("string"), F.lit("</title><guid>"), F.md5(F.col("url").cast("binary")), F.lit("</guid><pubDate>"), F.when(F.col("page_id") % 3 > 0, F.date_format("day", "d MMM yyyy 10:00:00")).otherwise(F.lit("soon")), F.lit("</pubDate></item>"))
    # One feed a file: items are gathered in feeds of a bounded size.
    feeds = pages.select(F.floor(F.col("page_id") / 500).alias("feed"), item.alias("item")).groupBy("feed").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    feeds.select("feed", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).repartition("feed").write.partitionBy("feed").text(feed)
    pages.select(F.to_json(F.struct(F.md5(F.col("url").cast("binary")).alias("event_id"), F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), F.create_map(F.lit("title"), F.lit("a page")).alias("payload"))).alias("value")).write.text(drop)
    both = T.read_source(spark, "rss", feed).withColumn("source", F.lit("rss")).unionByName(T.read_source(spark, "envelopes", drop).withColumn("source", F.lit("envelopes")))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("published_at").alias("dated"))


@query("sc_json_dimension", """
SELECT s_name, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def sc_json_dimension(spark, d):
    """A dimension kept as JSON lines, read with its schema and joined."""
    folder = T.shared_folder(spark, "dimension")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.json(folder)
    names = T.dimension(spark, folder, "s_suppkey bigint, s_name string")
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counts.join(names, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("n").alias("lines"))


@query("sr_versions", """
WITH v(extractor, version, status) AS (VALUES ('lines', 'A', 'active'), ('lines', 'N', 'rejected'), ('lines', 'R', 'candidate'))
SELECT version, status, (SELECT count(*) FROM lineitem WHERE l_returnflag = version AND status <> 'rejected') AS facts, (SELECT count(*) FROM lineitem WHERE l_returnflag = version AND status = 'active') AS seen FROM v""")
def sr_versions(spark, d):
    """A new version activated and rolled back, another rejected and its facts purged; readers see the active one."""
    start = spark.createDataFrame([("lines", "A", "active"), ("lines", "N", "candidate"), ("lines", "R", "candidate")], "extractor string, version string, status string")
    versions = FA.rejected(FA.rolled_back(FA.activate(start, "lines", "R"), "lines"), "lines", "N")
    facts = table(spark, d, "lineitem").select(F.lit("lines").alias("extractor"), F.col("l_returnflag").alias("version"), "l_orderkey")
    left = FA.purged(facts, versions).groupBy("version").agg(F.count("*").alias("facts"))
    seen = FA.active(facts, versions).groupBy("version").agg(F.count("*").alias("seen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return versions.join(left, "version", "left").join(seen, "version", "left").select("version", "status", zero("facts"), zero("seen"))


@query("sr_pending_work", """
SELECT o_orderstatus, count(*) AS pending FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY 1""")
def sr_pending_work(spark, d):
    """Events without a run of the version; runs of another version don't count."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderstatus")
    runs = orders.where("event_id % 4 in (1, 2)").select("event_id", F.lit("lines").alias("extractor"), F.when(F.col("event_id") % 4 == 1, "2").otherwise("1").alias("version"))
    return FA.pending(orders, runs, "lines", "2").groupBy("o_orderstatus").agg(F.count("*").alias("pending"))


@query("sr_lookup_cap", """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE rn <= 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500""")
def sr_lookup_cap(spark, d):
    """A batch of work: the newest three of each look-up, five hundred in all."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    capped = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return capped.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500).select("o_orderkey", "o_custkey")


@query("sr_retry_state", f"""
WITH a AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS tries, bool_or(event_type = 'purchase') AS done, max(value) FILTER (WHERE event_type = 'error') AS worst, max(epoch_us(ts)) AS last FROM events GROUP BY 1), n AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT user_id, tries, CASE WHEN done THEN 'settled' WHEN worst > 90 THEN 'final' WHEN tries >= 3 THEN 'given up' WHEN now - last > {48 * HOUR} THEN 'expired' ELSE 'retry' END AS state FROM a, n""")
def sr_retry_state(spark, d):
    """Whether a key's failed work is settled, final, given up after three tries, expired, or tried again."""
    events = table(spark, d, "events").withColumn("t", micros(F.col("ts")))
    failed = F.col("event_type") == "error"
    state = events.groupBy("user_id").agg(F.count_if(failed).alias("tries"), F.bool_or(F.col("event_type") == "purchase").alias("done"), F.max(F.when(failed, F.col("value"))).alias("worst"), F.max("t").alias("last"))
    now = events.agg(F.max("t").alias("now"))
    step = F.when(F.col("done"), "settled").when(F.col("worst") > 90, "final").when(F.col("tries") >= 3, "given up").when(F.col("now") - F.col("last") > 48 * HOUR, "expired").otherwise("retry")
    return state.crossJoin(F.broadcast(now)).select("user_id", "tries", step.alias("state"))


@query("sr_backoff", """
WITH r AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r WHERE bad)
SELECT event_id, CAST(least(3600, 60 * pow(2, n - 1)) AS BIGINT) AS seconds FROM n""")
def sr_backoff(spark, d):
    """Seconds to wait after each failure in a row: doubled from a minute, an hour at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = table(spark, d, "events").withColumn("run", F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    failures = runs.where("event_type = 'error'").withColumn("n", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")))
    return failures.select("event_id", F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), F.col("n") - 1)).cast("bigint").alias("seconds"))


@query("sr_late_copies", f"""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS rank FROM events), p AS (SELECT *, first_value(rank) OVER w AS r0, first_value(t) OVER w AS t0, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT CASE WHEN t - t0 <= {24 * HOUR} AND rank < r0 THEN 'takes over' WHEN t - t0 <= {24 * HOUR} THEN 'copy' WHEN t - t0 <= {72 * HOUR} THEN 'late copy' ELSE 'new' END AS verdict, count(*) AS n FROM p WHERE rn > 1 GROUP BY 1""")
def sr_late_copies(spark, d):
    """Later copies of a stored row: a better source within a day takes over, others are copies, later ones are late or new."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    e = table(spark, d, "events").select("event_id", "user_id", micros(F.col("ts")).alias("t"), rank.alias("rank"))
    first = e.groupBy("user_id").agg(F.min(F.struct("t", "event_id", "rank")).alias("first"))
    later = e.join(first, "user_id").where(F.col("event_id") != F.col("first.event_id"))
    gap = F.col("t") - F.col("first.t")
    verdict = F.when((gap <= 24 * HOUR) & (F.col("rank") < F.col("first.rank")), "takes over").when(gap <= 24 * HOUR, "copy").when(gap <= 72 * HOUR, "late copy").otherwise("new")
    return later.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def _prints(orders):
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"), F.sum("o_orderkey").alias("keys"))


@query("sr_skip_rebuild", """
SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'rebuild' WHEN '2-HIGH' THEN 'rebuild' WHEN '5-LOW' THEN 'forced' ELSE 'skip' END AS step FROM orders""")
def sr_skip_rebuild(spark, d):
    """Groups whose fingerprint is that of the last build are skipped, unless that is eight hours old."""
    orders = table(spark, d, "orders")
    built = F.when(F.col("o_orderpriority") == "5-LOW", 9).otherwise(2)
    last = T.stored(_prints(orders).withColumn("built_at", built), "prints")
    now = orders.where("NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0)").withColumn("o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")))
    return S.rebuild_steps(last, _prints(now), ["o_orderpriority"], F.col("built_at"), 8)


@query("sr_narrow_check", """
SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0 OR l_tax > 0.04) AS relevant, count(*) AS n FROM lineitem GROUP BY 1""")
def sr_narrow_check(spark, d):
    """New rows that neither have a find nor a tag change nothing: a digest of the others says whether to rebuild."""
    lines = table(spark, d, "lineitem")
    relevant = (F.col("l_discount") > 0) | (F.col("l_tax") > 0.04)
    silent = lines.where(~relevant).withColumn("l_quantity", F.col("l_quantity") + 7)
    grown = lines.unionByName(silent)
    changed = S.changed_keys(lines.where(relevant), grown.where(relevant), ["l_returnflag"])
    counts = lines.groupBy("l_returnflag").agg(F.count_if(relevant).alias("relevant"), F.count("*").alias("n"))
    return counts.join(changed, "l_returnflag", "left_anti")


def _best(lines):
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("intervals"), F.max(cents(F.col("l_extendedprice"))).alias("best"))


@query("sr_refresh_orders", """
SELECT l_orderkey, count(*) AS intervals, max(CAST(round((l_extendedprice + CASE WHEN l_orderkey % 50 = 7 THEN 100 ELSE 0 END) * 100) AS BIGINT)) AS best FROM lineitem WHERE l_orderkey % 90 <> 11 GROUP BY 1""")
def sr_refresh_orders(spark, d):
    """A table of best intervals after an edit: changed and deleted orders are computed again, the rest is taken over."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    new = old.where("l_orderkey % 90 <> 11").withColumn("l_extendedprice", F.col("l_extendedprice") + F.when(F.col("l_orderkey") % 50 == 7, 100).otherwise(0))
    published, signatures = T.stored(_best(old), "best"), T.stored(S.signatures(old, ["l_orderkey"]), "signatures")
    return S.refreshed_from(published, signatures, new, ["l_orderkey"], _best)


@query("sr_high_water", """
WITH m AS (SELECT max(o_orderkey) AS top FROM orders), r AS (SELECT unnest(range(1, 7)) AS run)
SELECT run, (SELECT count(*) FROM orders, m WHERE CASE WHEN run % 5 = 0 THEN o_orderkey <= top * run // 6 ELSE o_orderkey > top * (run - 1) // 6 AND o_orderkey <= top * run // 6 END) AS scanned FROM r""")
def sr_high_water(spark, d):
    """Rows that six runs read: those above the mark of the run before, and all of them on every fifth run."""
    orders = table(spark, d, "orders").select("o_orderkey")
    top = orders.agg(F.max("o_orderkey").alias("top"))
    runs = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("run")
    seen = orders.crossJoin(F.broadcast(top)).select("o_orderkey", "top", runs)
    here = F.col("o_orderkey") <= F.expr("top * run div 6")
    fresh = F.col("o_orderkey") > F.expr("top * (run - 1) div 6")
    return seen.groupBy("run").agg(F.count_if(here & (fresh | (F.col("run") % 5 == 0))).alias("scanned"))


@query("sr_feed_versions", """
SELECT DISTINCT 'orders ' || o_orderpriority AS feed, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 8 ELSE 7 END AS version FROM orders""")
def sr_feed_versions(spark, d):
    """A feed's version goes up by one where its rows changed, and stays otherwise."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    edited = orders.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"), 1).otherwise(0))
    changed = S.changed_keys(orders, edited, ["o_orderpriority"]).withColumn("bump", F.lit(1))
    feeds = orders.select("o_orderpriority").distinct().withColumn("version", F.lit(7))
    return feeds.join(changed, "o_orderpriority", "left").select(F.concat(F.lit("orders "), "o_orderpriority").alias("feed"), (F.col("version") + F.coalesce("bump", F.lit(0))).alias("version"))


@query("sr_recent_feed", f"""
WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT event_id, event_type FROM events, n WHERE epoch_us(ts) > now - {36 * HOUR} AND (value >= 50 OR event_type = 'error') ORDER BY ts DESC, event_id DESC LIMIT 100""")
def sr_recent_feed(spark, d):
    """The last thirty-six hours, important events only, newest first."""
    events = table(spark, d, "events")
    now = events.agg(F.max(micros(F.col("ts"))).alias("now"))
    recent = events.crossJoin(F.broadcast(now)).where((micros(F.col("ts")) > F.col("now") - 36 * HOUR) & ((F.col("value") >= 50) | (F.col("event_type") == "error")))
    return recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")
