"""Listings, scopes, look-ups, matches and facets of a news portal over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import listings as L
from tessera.plans.measures import pick, picked
from tessera.plans.registry import query
from tessera.sources.tables import micros, table

DAY = 86_400_000_000
SUFFIX = (".V", ".US", ".TO", ".CN", ".us")
TICKER_SQL = f"'C' || (c_custkey % 40) || {picked('c_nationkey', SUFFIX)}"


def tickers(spark, d):
    """Customers as listings: a symbol under several suffixes, and two cross-filed tickers."""
    c = table(spark, d, "customer")
    symbol = F.concat(F.lit("C"), (F.col("c_custkey") % 40).cast("string"), pick(F.col("c_nationkey"), SUFFIX))
    more = F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("C"), (F.col("c_custkey") % 7).cast("string"), F.lit(".V")), F.lit("ZZ.TO")))
    return c.select("c_custkey", symbol.alias("ticker"), more.alias("additional"), "c_name", "c_mktsegment", "c_acctbal")


@query("sc_admin_scan", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def sc_admin_scan(spark, d):
    """Rows of any status, a later page."""
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(100).limit(50).select("o_orderkey", "o_orderstatus")


@query("sc_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 4242 OR o_orderkey = 7")
def sc_point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 4242 or o_orderkey = 7")


@query("fl_company_rows", f"""
SELECT c_custkey FROM (SELECT c_custkey, {TICKER_SQL} AS t FROM customer) WHERE upper(t) LIKE 'C3.%' OR (c_custkey % 3 = 0 AND c_custkey % 7 = 3)""")
def fl_company_rows(spark, d):
    """A symbol under any suffix, and rows cross-filed under it."""
    return L.of_company(tickers(spark, d), "ticker", "additional", "C3.V", False).select("c_custkey")


@query("fl_listing_clash", f"""
WITH t AS (SELECT c_custkey, {TICKER_SQL} AS t FROM customer), k AS (SELECT string_split(t, '.')[1] AS b FROM t GROUP BY 1 HAVING bool_or(upper(t) LIKE '%.US') AND bool_or(upper(t) NOT LIKE '%.US'))
SELECT b, (SELECT count(*) FROM t WHERE string_split(t, '.')[1] = b AND upper(t) LIKE '%.US') AS us_rows, (SELECT count(*) FROM t WHERE string_split(t, '.')[1] = b AND upper(t) NOT LIKE '%.US') AS other_rows FROM k""")
def fl_listing_clash(spark, d):
    """Symbols that two companies share across the border, with the rows of each side."""
    rows = tickers(spark, d)
    us = F.upper("ticker").endswith(".US")
    counts = rows.groupBy(L.bare(F.col("ticker")).alias("b")).agg(F.count_if(us).alias("us_rows"), F.count_if(~us).alias("other_rows"))
    return counts.join(L.clashes(rows, "ticker").withColumnRenamed("bare", "b"), "b", "left_semi")


@query("fl_company_side", f"""
SELECT c_custkey FROM (SELECT c_custkey, {TICKER_SQL} AS t FROM customer) WHERE (upper(t) LIKE 'C5.%' OR (c_custkey % 3 = 0 AND c_custkey % 7 = 5)) AND upper(t) LIKE '%.US'""")
def fl_company_side(spark, d):
    """The US side of a clashing symbol, asked for as C5-US."""
    return L.of_company(tickers(spark, d), "ticker", "additional", "C5-US", True).select("c_custkey")


LEADS = ("files a base shelf prospectus", "closes a revolving credit facility", "announces a placement", "receives a letter of interest", "reports drilling")
DEALS = ("units", "ATM", "stream/royalty", "units,warrants", "notes")


@query("fl_deal_class", f"""
WITH t AS (SELECT o_orderkey, {picked("o_orderkey", DEALS)} AS kind, {picked("o_custkey", LEADS)} AS lead FROM orders)
SELECT CASE WHEN kind = 'ATM' THEN 'atm' WHEN kind LIKE 'stream%' THEN 'stream' WHEN lead LIKE '%credit facility%' THEN 'credit_facility' WHEN lead LIKE '%letter of interest%' THEN 'letter_of_interest' WHEN lead LIKE '%shelf prospectus%' THEN 'shelf' ELSE 'raise' END AS class, count(*) AS n FROM t GROUP BY 1""")
def fl_deal_class(spark, d):
    """Classes of deals by kind, else by what the headline says."""
    kinds = [("atm", "ATM"), ("stream", "STREAM")]
    phrases = [("credit_facility", ("credit facility", "loan facility")), ("letter_of_interest", ("letter of interest", "letters of interest")), ("shelf", ("shelf prospectus",))]
    cls = L.deal_class(pick(F.col("o_orderkey"), DEALS), pick(F.col("o_custkey"), LEADS), kinds, phrases, "raise")
    return table(spark, d, "orders").groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query("fl_gate", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS published FROM lineitem WHERE l_returnflag IN ('A', 'N') OR (l_linestatus = 'F' AND l_discount > 0.05) GROUP BY 1")
def fl_gate(spark, d):
    """Rows that a gate lets through: published ones of two kinds, others where they affect something."""
    gate = F.col("l_returnflag").isin("A", "N") | ((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.05))
    return table(spark, d, "lineitem").where(gate).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("published"))


@query("fl_scopes", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS moment FROM orders),
u AS (SELECT o_orderkey, 'upcoming' AS scope, row_number() OVER (ORDER BY moment, o_orderkey) AS place FROM t WHERE moment >= TIMESTAMP '2001-06-01' ORDER BY place LIMIT 40),
r AS (SELECT o_orderkey, 'recent' AS scope, row_number() OVER (ORDER BY moment DESC, o_orderkey DESC) AS place FROM t WHERE moment < TIMESTAMP '2001-06-01' ORDER BY place LIMIT 40),
n AS (SELECT o_orderkey, 'undated' AS scope, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM t WHERE moment IS NULL ORDER BY place LIMIT 40)
SELECT * FROM u UNION ALL SELECT * FROM r UNION ALL SELECT * FROM n""")
def fl_scopes(spark, d):
    """Forty upcoming rows by time, forty recent ones backwards, forty undated ones by key: each scope has its own order."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("moment"))
    line = F.lit("2001-06-01").cast("timestamp_ntz")
    scopes = [("upcoming", F.col("moment") >= line, [F.asc("moment"), F.asc("o_orderkey")]), ("recent", F.col("moment") < line, [F.desc("moment"), F.desc("o_orderkey")]), ("undated", F.col("moment").isNull(), [F.desc("o_orderkey")])]
    out = None
    for name, which, order in scopes:
        page = rows.where(which).orderBy(*order).limit(40)  # forty rows: numbered in one task
        page = page.select("o_orderkey", F.lit(name).alias("scope"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))
        out = page if out is None else out.union(page)
    return out


@query("fl_substantive", r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS h, text FROM documents)
SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(trim(replace(trim(text), trim(h), ''))) < 350 THEN 'short' WHEN regexp_matches(text, '(?i)\.\.\.\s*(?:read\s+more)?\s*$') THEN 'teaser' ELSE 'fine' END AS reason, count(*) AS n FROM t GROUP BY 1""")
def fl_substantive(spark, d):
    """Why bodies aren't news of their own."""
    reason = L.substantive(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"))
    return table(spark, d, "documents").groupBy(F.coalesce(reason, F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


def _gate_sql():
    n = ", ".join(f"[len(list_filter(t, lambda w: w IN ({', '.join(repr(w) for w in some)}))), {-i}]" for i, (_, some) in enumerate(sorted(X.STOP_WORDS.items())))
    names = " ".join(f"WHEN m[2] = {-i} THEN '{lang}'" for i, lang in enumerate(sorted(X.STOP_WORDS)))
    return rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
 trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages),
t AS (SELECT *, array_to_string(string_split(host, '.')[-3:], '.') AS site, regexp_split_to_array(lower(body), '[^a-zà-ÿ]+') AS t FROM p),
l AS (SELECT *, greatest({n}) AS m FROM t), s AS (SELECT *, CASE WHEN m[1] = 0 THEN NULL {names} END AS lang FROM l)
SELECT page_id, CASE WHEN NOT coalesce(list_contains(['example.com', 'example.org'], array_to_string(string_split(host, '.')[-2:], '.')), false) THEN 'external'
 WHEN regexp_matches(path, '^/?$|/[0-9]*[05]$|/(?:index|news|tag)/?$') THEN 'generic' WHEN coalesce(lang NOT IN ('en', 'es'), false) THEN 'language'
 WHEN body = '' THEN 'empty' WHEN length(trim(replace(body, title, ''))) < 600 THEN 'short' WHEN regexp_matches(body, '(?i)\.\.\.\s*(?:read\s+more)?\s*$') THEN 'teaser' END AS reason FROM s"""


@query("fl_page_gate", _gate_sql())
def fl_page_gate(spark, d):
    """Site, kind of page, language and substance of every page."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    # The text is made once, beside its page, rather than again in each rule.
    pages = table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path"), title.alias("title"), X.html_text(F.col("html")).alias("body"))
    reason = L.page_gate(F.col("host"), F.col("path"), F.col("title"), F.col("body"), ("example.com", "example.org"), ("en", "es"), "^/?$|/[0-9]*[05]$|/(?:index|news|tag)/?$", 600)
    return pages.select("page_id", reason.alias("reason"))


@query("fl_auto_approve", """
SELECT event_type, count(*) FILTER (WHERE value / 100 >= CASE event_type WHEN 'error' THEN 0.9 WHEN 'click' THEN 0.5 ELSE 0.7 END) AS approved, count(*) AS n FROM events GROUP BY 1""")
def fl_auto_approve(spark, d):
    """Events at or above the threshold of their type pass without review."""
    least = F.when(F.col("event_type") == "error", 0.9).when(F.col("event_type") == "click", 0.5).otherwise(0.7)
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") / 100 >= least).alias("approved"), F.count("*").alias("n"))


@query("jn_found_subset", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R' AND b.l_quantity > 45)""")
def jn_found_subset(spark, d):
    """All lines of orders of which some line is flagged."""
    lines = table(spark, d, "lineitem")
    return lines.join(lines.where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey"), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("jn_small_to_large", """
SELECT r_name, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1""")
def jn_small_to_large(spark, d):
    """Small tables first, each filtered, then the large one by its key; Spark broadcasts those that are small enough."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    some = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    joined = table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("jn_company_names", """
WITH c AS (SELECT s_suppkey AS t, s_name AS name, 0 AS age FROM supplier UNION ALL SELECT s_suppkey + 60, s_name, 1 FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT t, name, row_number() OVER (PARTITION BY t ORDER BY age, name) AS rn FROM c)
SELECT k.t AS ticker, name, n FROM (SELECT l_partkey % 200 AS t, count(*) AS n FROM lineitem GROUP BY 1) k LEFT JOIN b ON k.t = b.t AND rn = 1""")
def jn_company_names(spark, d):
    """Names by ticker; a previous ticker counts where no company has it now."""
    companies = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.col("s_suppkey") + 60)).otherwise(F.array().cast("array<bigint>")).alias("previous_tickers"))
    rows = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 200).alias("ticker")).agg(F.count("*").alias("n"))
    return L.named(rows.withColumnRenamed("ticker", "k"), "k", companies).select(F.col("k").alias("ticker"), "name", "n")


@query("jn_fuzzy_48h", f"""
WITH o AS (SELECT o_orderkey, o_custkey % 300 AS t, epoch_us(o_orderdate) AS at, replace(lower(p_name), ' ', '') AS h FROM orders JOIN part ON p_partkey = o_orderkey % 200)
SELECT a.o_orderkey, min(b.o_orderkey) AS earlier FROM o a JOIN o b ON a.t = b.t AND b.o_orderkey < a.o_orderkey AND abs(a.at - b.at) <= {2 * DAY} AND (starts_with(a.h, b.h) OR starts_with(b.h, a.h)) GROUP BY 1""")
def jn_fuzzy_48h(spark, d):
    """Rows of a ticker within 48 hours of which one headline begins with the other; a band join on two-day buckets."""
    part = table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("h"))
    rows = table(spark, d, "orders").join(part, F.col("p_partkey") == F.col("o_orderkey") % 200).select("o_orderkey", (F.col("o_custkey") % 300).alias("t"), micros(F.col("o_orderdate")).alias("moment"), "h")
    width = 2 * DAY
    bucket = F.floor(F.col("moment") / width)
    left = rows.withColumn("bucket", bucket)
    right = rows.select(F.col("o_orderkey").alias("other"), "t", F.col("moment").alias("then"), F.col("h").alias("g"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    near = (F.col("other") < F.col("o_orderkey")) & (F.abs(F.col("moment") - F.col("then")) <= width) & (F.startswith("h", "g") | F.startswith("g", "h"))
    return left.join(right, ["t", "bucket"]).where(near).groupBy("o_orderkey").agg(F.min("other").alias("earlier"))


@query("jn_cited_release", f"""
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT o_orderkey, o_custkey, day, day - CAST(30 + o_orderkey % 60 AS INTEGER) AS cited FROM o WHERE o_orderkey % 3 = 0)
SELECT c.o_orderkey, arg_min(o.o_orderkey, struct_pack(g := abs(o.day - c.cited), k := o.o_orderkey)) AS announced FROM c JOIN o ON o.o_custkey = c.o_custkey AND abs(o.day - c.cited) <= 3 AND c.day - o.day <= 150 AND o.o_orderkey <> c.o_orderkey GROUP BY 1""")
def jn_cited_release(spark, d):
    """The release of the company within three days of a date that a later one cites, at most 150 days back."""
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(day).alias("day"))
    cited = rows.where("o_orderkey % 3 = 0").withColumn("cited", (F.col("day") - (30 + F.col("o_orderkey") % 60)).cast("int"))
    cited = cited.select("o_orderkey", "o_custkey", F.col("day").alias("own"), "cited", F.explode(F.sequence(F.col("cited") - 3, F.col("cited") + 3)).alias("day"))
    other = rows.withColumnRenamed("o_orderkey", "announced")
    found = cited.join(other, ["o_custkey", "day"]).where((F.col("own") - F.col("day") <= 150) & (F.col("announced") != F.col("o_orderkey")))
    return found.groupBy("o_orderkey").agg(F.min_by("announced", F.struct(F.abs(F.col("day") - F.col("cited")), "announced")).alias("announced"))


@query("jn_version_fill", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM a)),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey NOT IN (SELECT l_orderkey FROM a) AND l_orderkey NOT IN (SELECT l_orderkey FROM r))
SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM (SELECT * FROM a UNION ALL SELECT * FROM r UNION ALL SELECT * FROM n) GROUP BY 1""")
def jn_version_fill(spark, d):
    """Rows of the active version, and of older ones in order for keys on which it never ran: one window, no chain of joins."""
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", rank.alias("version"))
    best = F.min("version").over(Window.partitionBy("l_orderkey"))
    return lines.withColumn("best", best).where("version = best").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("jn_third_party", """
WITH m AS (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), g AS (SELECT l_partkey, l_quantity, min(l_suppkey) FILTER (WHERE s_nationkey = 3) AS firm FROM m GROUP BY 1, 2)
SELECT coalesce(firm, -1) AS firm, count(*) AS n FROM m JOIN g ON m.l_partkey = g.l_partkey AND m.l_quantity = g.l_quantity GROUP BY 1""")
def jn_third_party(spark, d):
    """A third party named on one row marks all rows of the same figures: a grouped minimum joined back."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    marked = lines.where("s_nationkey = 3").groupBy("l_partkey", "l_quantity").agg(F.min("l_suppkey").alias("firm"))
    return lines.join(marked, ["l_partkey", "l_quantity"], "left").groupBy(F.coalesce("firm", F.lit(-1)).alias("firm")).agg(F.count("*").alias("n"))


@query("ag_tickers_crossed", f"""
WITH t AS (SELECT {TICKER_SQL} AS ticker FROM customer UNION ALL SELECT unnest(['C' || (c_custkey % 7) || '.V', 'ZZ.TO']) FROM customer WHERE c_custkey % 3 = 0)
SELECT ticker, count(*) AS n FROM t GROUP BY 1""")
def ag_tickers_crossed(spark, d):
    """Rows by ticker, cross-filed ones counted under each of theirs."""
    every = F.concat(F.array("ticker"), F.coalesce("additional", F.array().cast("array<string>")))
    return tickers(spark, d).select(F.explode(every).alias("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))


@query("ag_period_pages", """
WITH m AS (SELECT date_trunc('month', ts) AS m, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS period, strftime(m, '%Y-%m-%d') AS first_day, strftime(last_day(m), '%Y-%m-%d') AS last_day, strftime(m - INTERVAL 1 MONTH, '%Y-%m') AS before, strftime(m + INTERVAL 1 MONTH, '%Y-%m') AS after, n FROM m""")
def ag_period_pages(spark, d):
    """Bounds of each month with events, and its neighbours for navigation."""
    m = F.trunc(F.to_date("ts"), "month")
    rows = table(spark, d, "events").groupBy(m.alias("m")).agg(F.count("*").alias("n"))
    name = lambda x: F.date_format(x, "yyyy-MM")
    return rows.select(name("m").alias("period"), F.date_format("m", "yyyy-MM-dd").alias("first_day"), F.date_format(F.last_day("m"), "yyyy-MM-dd").alias("last_day"), name(F.add_months("m", -1)).alias("before"), name(F.add_months("m", 1)).alias("after"), "n")


@query("ag_eav_nested", """
SELECT l_orderkey, count(*) AS n, array_to_string(list_transform(list_sort(list([l_linenumber, l_partkey, l_suppkey])), lambda x: x[1] || ':' || x[2]), ',') AS intervals FROM lineitem GROUP BY 1""")
def ag_eav_nested(spark, d):
    """Facts (record, field, seq, value) back into arrays of structs, one per sequence number."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.explode(F.create_map(F.lit("iv_no"), F.col("l_linenumber").cast("bigint"), F.lit("iv_part"), "l_partkey", F.lit("iv_supplier"), "l_suppkey")).alias("field", "value"))
    wide = lines.groupBy("l_orderkey", "seq").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("iv_no", "iv_part", "iv_supplier")], F.count_if(F.col("field") == "iv_no").alias("times"))
    rows = wide.groupBy("l_orderkey").agg(F.sum("times").alias("n"), F.sort_array(F.flatten(F.collect_list(F.array_repeat(F.struct("iv_no", "iv_part", "iv_supplier"), F.col("times").cast("int"))))).alias("iv"))
    return rows.select("l_orderkey", "n", F.array_join(F.transform("iv", lambda x: F.concat(x.iv_no.cast("string"), F.lit(":"), x.iv_part.cast("string"))), ",").alias("intervals"))


@query("ag_dropdown", "SELECT DISTINCT c_mktsegment AS item FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1")
def ag_dropdown(spark, d):
    return table(spark, d, "customer").where("c_mktsegment is not null").select(F.col("c_mktsegment").alias("item")).distinct().orderBy("item")


@query("ag_status_ledger", "SELECT o_orderstatus AS status, o_orderpriority AS source, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1, 2")
def ag_status_ledger(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))


@query("ag_tag_memory", r"""
WITH t AS (SELECT p_partkey, p_brand, trim(regexp_replace(lower(p_name || ' No. ' || p_size), '[0-9]+', '#', 'g')) AS template, p_type FROM part),
m AS (SELECT p_brand, template, arg_max(p_type, p_partkey) AS tag, max(p_partkey) AS last FROM t WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT t.p_partkey, coalesce(m.tag, t.p_type) AS tag, m.tag IS NOT NULL AS remembered FROM t LEFT JOIN m USING (p_brand, template)""")
def ag_tag_memory(spark, d):
    """The latest correction of an issuer's headline template applies to all headlines of the template."""
    template = F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit(" No. "), F.col("p_size").cast("string"))), "[0-9]+", "#"))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", template.alias("template"), "p_type")
    memory = rows.where("p_partkey % 2 = 0").groupBy("p_brand", "template").agg(F.max_by("p_type", "p_partkey").alias("tag"))
    return rows.join(memory, ["p_brand", "template"], "left").select("p_partkey", F.coalesce("tag", "p_type").alias("tag"), F.col("tag").isNotNull().alias("remembered"))


@query("or_base_first", """
SELECT o_custkey, array_to_string(list_concat(list_filter(k, lambda x: x % 5 = 0)[1:1], list_filter(k, lambda x: x <> coalesce(list_filter(k, lambda y: y % 5 = 0)[1], -1))), ',') AS shown FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY 1)""")
def or_base_first(spark, d):
    """The first base case goes to the head of its list, the others keep their order."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    base = F.slice(F.filter("k", lambda x: x % 5 == 0), 1, 1)
    rest = F.filter("k", lambda x: ~F.coalesce(x == F.get(base, F.lit(0)), F.lit(False)))
    return rows.select("o_custkey", F.array_join(F.concat(base, rest), ",").alias("shown"))


@query("st_ordered_union", """
WITH u AS (SELECT o_orderkey AS id, 'release' AS kind, o_orderdate AS moment, o_orderstatus AS state, NULL AS mode FROM orders UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'bulletin', l_shipdate, NULL, l_returnflag FROM lineitem WHERE l_quantity = 50)
SELECT id, kind, strftime(moment, '%Y-%m-%d') AS day, state, mode FROM u ORDER BY moment DESC, kind, id, state, mode LIMIT 300""")
def st_ordered_union(spark, d):
    """Two sources of different columns as one stream, newest first."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("release").alias("kind"), F.col("o_orderdate").alias("moment"), F.col("o_orderstatus").alias("state"))
    b = table(spark, d, "lineitem").where("l_quantity = 50").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("bulletin").alias("kind"), F.col("l_shipdate").alias("moment"), F.col("l_returnflag").alias("mode"))
    both = a.unionByName(b, allowMissingColumns=True).orderBy(F.desc("moment"), "kind", "id", "state", "mode").limit(300)
    return both.select("id", "kind", F.date_format("moment", "yyyy-MM-dd").alias("day"), "state", "mode")


@query("aj_tag_changes", """
WITH v(tag, place) AS (VALUES ('ECONOMY', 0), ('LARGE', 1), ('MEDIUM', 2), ('PROMO', 3), ('SMALL', 4), ('STANDARD', 5), ('Corporate', 6)),
t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ['Corporate'] ELSE [p_type, 'PROMO'] END AS tags FROM part), w AS (SELECT p_partkey, tags, list_distinct(list_append(list_filter(tags, lambda x: x <> 'Corporate'), 'LARGE')) AS added, list_filter(tags, lambda x: x <> 'PROMO') AS cut FROM t)
SELECT p_partkey, (SELECT string_agg(tag, '|' ORDER BY place) FROM v WHERE list_contains(added, tag)) AS added, coalesce((SELECT string_agg(tag, '|' ORDER BY place) FROM v WHERE list_contains(cut, tag)), 'Corporate') AS cut FROM w""")
def aj_tag_changes(spark, d):
    """A tag added and a tag taken off, in the vocabulary's order; the default tag stands only alone."""
    from tessera.functions.text import with_tag, without_tag

    vocabulary = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "Corporate"]
    tags = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("Corporate"))).otherwise(F.array("p_type", F.lit("PROMO")))
    return table(spark, d, "part").select("p_partkey", F.array_join(with_tag(tags, "LARGE", vocabulary, "Corporate"), "|").alias("added"), F.array_join(without_tag(tags, "PROMO", vocabulary, "Corporate"), "|").alias("cut"))


@query("aj_small_json", """
SELECT event_id, least(2, 1 + CAST(json_extract(props, '$.k') AS BIGINT) % 4) AS items, substr(event_type || ' of user ' || user_id, 1, 12) AS label, CASE WHEN event_id % 5 > 0 THEN value END AS amount FROM events""")
def aj_small_json(spark, d):
    """Lists from JSON kept small: two items at most, short text, finite numbers."""
    from tessera.functions.text import small_json

    k = F.get_json_object("props", "$.k").cast("bigint")
    item = F.struct(F.concat_ws(" of user ", "event_type", F.col("user_id").cast("string")).alias("label"), F.when(F.col("event_id") % 5 > 0, F.col("value").cast("string")).otherwise(F.lit("Infinity")).alias("amount"))
    raw = F.to_json(F.array_repeat(item, (1 + k % 4).cast("int")))
    rows = table(spark, d, "events").select("event_id", small_json(raw, 2, 12).alias("items"))
    return rows.select("event_id", F.size("items").cast("bigint").alias("items"), F.col("items")[0].label.alias("label"), F.col("items")[0].amount.alias("amount"))


@query("aj_fenced_json", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def aj_fenced_json(spark, d):
    """JSON out of a fenced or chatty answer; null where there is none."""
    from tessera.functions.text import fenced_json

    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure. "), "props")).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise(F.lit("I can't say {"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(fenced_json(said), "$.k").cast("bigint"), F.lit(-1)).alias("k"))


@query("aj_json_keys", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT unnest(from_json('[3,5,7,11,13,17,900,901,902]', '["BIGINT"]')))""")
def aj_json_keys(spark, d):
    """Rows whose key is in a JSON list: the list as a frame, a semi-join."""
    keys = spark.range(1).select(F.explode(F.from_json(F.lit("[3,5,7,11,13,17,900,901,902]"), "array<bigint>")).alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")
