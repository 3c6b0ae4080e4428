"""Gates, bands with similarity, filled columns, references, letterheads and windows of titles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.measures import let
from tessera.operators import stores as S
from tessera.operators.matching import shingles
from tessera.plans.registry import query
from tessera.sources.tables import micros, table

DAY = 86_400_000_000
WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("sk_surrogate_refs", """
WITH k AS (SELECT p_name, row_number() OVER (ORDER BY substr(md5(p_name), 1, 15), p_name) AS id FROM (SELECT DISTINCT p_name FROM part))
SELECT k.id AS name_id, count(*) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey JOIN k USING (p_name) GROUP BY 1""")
def sk_surrogate_refs(spark, d):
    """References rewritten to surrogate ids: lines point at the id of their part's name."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    ids = S.stable_ids(part, ["p_name"], spark.createDataFrame([], "p_name string, surrogate_id long"))
    lines = S.rewritten(table(spark, d, "lineitem").select("l_partkey"), "l_partkey", ids.select(F.col("p_partkey").alias("old"), F.col("surrogate_id").alias("new")))
    return lines.groupBy(F.col("l_partkey").alias("name_id")).agg(F.count("*").alias("lines"))


@query("fl_universe_gate", """
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'pending_review' ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey""")
def fl_universe_gate(spark, d):
    """Rows of companies that aren't in the universe wait for a review."""
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    joined = table(spark, d, "orders").join(known, "o_custkey", "left")
    return joined.select("o_orderkey", F.when(F.col("known"), F.col("o_orderstatus")).otherwise("pending_review").alias("status"))


@query("fl_drop_markers", """
SELECT o_orderkey, count(l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 GROUP BY 1""")
def fl_drop_markers(spark, d):
    """Markers (tagged, nothing found) made by a left join, and dropped where only finds are asked for: null and blank alike."""
    found = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("kind"))
    published = table(spark, d, "orders").select("o_orderkey").join(found, "o_orderkey", "left")
    return published.where(F.coalesce(F.trim("kind"), F.lit("")) != "").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("jn_band_similar", f"""
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t, list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS w FROM orders JOIN part ON p_partkey = o_orderkey % 100)
SELECT a.o_orderkey AS a, b.o_orderkey AS b, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS shared, CAST(len(list_distinct(list_concat(a.w, b.w))) AS BIGINT) AS together FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.t - b.t) <= {4 * DAY}
WHERE 2 * len(list_intersect(a.w, b.w)) >= len(list_distinct(list_concat(a.w, b.w)))""")
def jn_band_similar(spark, d):
    """Rows of a company within four days whose words agree by half: the band first, similarity on its pairs."""
    from tessera.operators.matching import band_pairs

    part = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("w"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("t"), (F.col("o_orderkey") % 100).alias("p_partkey"))
    pairs = band_pairs(rows, "o_custkey", "t", 4 * DAY, "o_orderkey")
    named = rows.join(part, "p_partkey").select("o_orderkey", "w")
    both = pairs.join(named.withColumnsRenamed({"o_orderkey": "id_a", "w": "x"}), "id_a").join(named.withColumnsRenamed({"o_orderkey": "id_b", "w": "y"}), "id_b")
    counted = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"), F.size(F.array_union("x", "y")).cast("bigint").alias("together"))
    return counted.where(2 * F.col("shared") >= F.col("together"))


@query("jn_fill_columns", """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 5 > 0), a AS (SELECT o_orderkey AS k, o_totalprice + 1 AS price, 'ai' AS priority FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(r.k, a.k) AS k, coalesce(r.price, a.price) AS price, coalesce(r.priority, a.priority) AS priority, CASE WHEN r.k IS NULL THEN 'other' WHEN (r.price IS NULL AND a.price IS NOT NULL) OR (r.priority IS NULL AND a.priority IS NOT NULL) THEN 'filled' ELSE 'own' END AS how FROM r FULL JOIN a ON r.k = a.k""")
def jn_fill_columns(spark, d):
    """Rows of a second reader fill the gaps of the first's, and stand for keys that it doesn't have."""
    orders = table(spark, d, "orders")
    first = orders.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("priority"))
    second = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("price"), F.lit("ai").alias("priority"))
    return S.gaps_filled(first, second, ["k"], "how")


@query("ag_letterhead_share", """
WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), c AS (SELECT source, line, count(*) AS n FROM l WHERE length(line) BETWEEN 4 AND 200 GROUP BY 1, 2)
SELECT c.source, line, n, docs FROM c JOIN n ON n.source IS NOT DISTINCT FROM c.source WHERE 100 * n >= 2 * docs AND n >= 3""")
def ag_letterhead_share(spark, d):
    """Lines that two in a hundred of a source's documents hold, three at least: its letterhead."""
    docs = table(spark, d, "documents")
    lines = docs.select("source", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).where(F.length("line").between(4, 200))
    counts = lines.groupBy("source", "line").agg(F.count("*").alias("n"))
    sizes = docs.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("docs"))
    joined = counts.join(sizes, F.col("source").eqNullSafe(F.col("s")))
    return joined.where((100 * F.col("n") >= 2 * F.col("docs")) & (F.col("n") >= 3)).select("source", "line", "n", "docs")


@query("wn_closed_by_match", f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, epoch_us(o_orderdate) AS t, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)
SELECT a.o_orderkey, min(struct_pack(t := b.t, k := b.o_orderkey)).k AS closed_by FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.t > a.t AND b.t - a.t <= {180 * DAY} AND abs(a.v - b.v) * 4 <= greatest(a.v, b.v) GROUP BY 1""")
def wn_closed_by_match(spark, d):
    """The first later row of the same event: same company and kind, within 180 days, value within a quarter. Joined by time buckets."""
    width = 180 * DAY
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", micros(F.col("o_orderdate")).alias("t"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    bucket = F.floor(F.col("t") / width)
    left = rows.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    right = rows.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderpriority", F.col("t").alias("u"), F.col("v").alias("w"), bucket.alias("bucket"))
    fits = (F.col("u") > F.col("t")) & (F.col("u") - F.col("t") <= width) & (F.abs(F.col("v") - F.col("w")) * 4 <= F.greatest("v", "w"))
    return left.join(right, ["o_custkey", "o_orderpriority", "bucket"]).where(fits).groupBy("o_orderkey").agg(F.min(F.struct("u", "k")).alias("b")).select("o_orderkey", F.col("b.k").alias("closed_by"))


@query("tx_shingle_sizes", f"""
WITH w AS (SELECT doc_id, ({WORDS_SQL})[1:1200] AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) < 60 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) END AS INT) AS n FROM w""")
def tx_shingle_sizes(spark, d):
    """Eight-word phrases of the first 1,200 words; none for texts under sixty words."""
    w = F.slice(X.words(F.col("text")), 1, 1200)
    n = let(w, lambda x: F.when(F.size(x) < 60, 0).otherwise(F.size(shingles(x, 8))))
    return table(spark, d, "documents").select("doc_id", F.coalesce(n, F.lit(0)).alias("n"))


@query("tx_meta_description", r"""
WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages)
SELECT page_id, CASE WHEN length(body) <= 155 THEN body ELSE regexp_extract(substr(body, 1, 152), '^(.*) ', 1) || '...' END AS description FROM b""")
def tx_meta_description(spark, d):
    """The text of a page up to 155 characters, cut at a blank."""
    body = let(X.html_text(F.col("html")), lambda b: F.when(F.length(b) <= 155, b).otherwise(F.concat(F.regexp_extract(F.substring(b, 1, 152), r"^((?s).*) ", 1), F.lit("..."))))
    return table(spark, d, "pages").select("page_id", body.alias("description"))


@query("tx_title_window", """
SELECT p_partkey, p_name || ' of the north' AS title, CAST(4 AS INT) AS place FROM part""")
def tx_title_window(spark, d):
    """The run of words of a text that has most in common with a headline: its words and its place."""
    headline = F.concat("p_name", F.lit(" of the north"))
    text = F.concat(F.lit("news from our mill "), "p_name", F.lit(" of the north and then much else"))
    rows = table(spark, d, "part").select("p_partkey", X.best_window(F.split(text, " "), F.split(headline, " ")).alias("x"))
    return rows.select("p_partkey", F.array_join("x.words", " ").alias("title"), "x.place")


@query("wn_first_labelled", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_returnflag = 'A' THEN 'repeat' ELSE 'new' END AS label FROM lineitem), f AS (SELECT *, min(CASE WHEN label = 'new' THEN struct_pack(d := l_shipdate, o := l_orderkey) END) OVER (PARTITION BY l_suppkey, l_partkey) AS first FROM r)
SELECT count(*) FILTER (WHERE label = 'repeat') AS declared, count(*) FILTER (WHERE label = 'new' AND first.o = l_orderkey AND first.d = l_shipdate) AS fresh, count(*) FILTER (WHERE label = 'new' AND NOT (first.o = l_orderkey AND first.d = l_shipdate)) AS seen FROM f""")
def wn_first_labelled(spark, d):
    """Intervals of a company that are new, seen before, or declared repeats; only new ones register their key."""
    repeat = F.col("l_returnflag") == "A"
    first = F.min(F.when(~repeat, F.struct("l_shipdate", "l_orderkey"))).over(Window.partitionBy("l_suppkey", "l_partkey"))
    rows = table(spark, d, "lineitem").withColumn("first", first)
    own = F.coalesce(F.col("first") == F.struct("l_shipdate", "l_orderkey"), F.lit(False))
    return rows.agg(F.count_if(repeat).alias("declared"), F.count_if(~repeat & own).alias("fresh"), F.count_if(~repeat & ~own).alias("seen"))


@query("sc_html_entities", r"""
SELECT page_id, md5(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS digest FROM pages WHERE NOT regexp_matches(html, '&(#39|apos|nbsp);')""")
def sc_html_entities(spark, d):
    """Text of pages with its entities decoded (pages with quotes and blanks as entities aside, whose SQL differs)."""
    from tessera.functions.headlines import unescaped

    pages = table(spark, d, "pages").where(~F.col("html").rlike("&(#39|apos|nbsp);"))
    return pages.select("page_id", F.md5(unescaped(X.html_text(F.col("html"))).cast("binary")).alias("digest"))
