"""Text, similarity, value and search queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import values as V
from tessera.functions.measures import let
from tessera.operators.matching import containment, jaccard_pairs, shingle_classes, shingle_members
from tessera.plans.registry import query
from tessera.sources.tables import table



def _shingles_sql(name: str, key: str, source: str, n: int) -> str:
    """Distinct n-word shingles by row, from words at their places and the words after them."""
    after = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER p" for k in range(1, n)]])
    return f"""{name} AS (SELECT DISTINCT {key}, s FROM (SELECT {key}, {after} AS s FROM (SELECT {key}, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT {key}, {WORDS_SQL} AS w FROM {source}))
WINDOW p AS (PARTITION BY {key} ORDER BY i)) WHERE s IS NOT NULL)"""


WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("tx_slug_norm", """
SELECT p_partkey, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', ''), ''), 'release') AS slug,
 substr(regexp_replace(regexp_replace(lower(p_name), '^(update|correction|press release)[ :-]+', ''), '[^a-z0-9]+', '', 'g'), 1, 120) AS key FROM part""")
def tx_slug_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), X.headline_key(F.col("p_name")).alias("key"))


@query("tx_shingle_overlap", f"""
WITH {_shingles_sql("bs", "item_id", "benchmark", 8)}, {_shingles_sql("ds", "doc_id", "documents", 8)},
n AS (SELECT item_id, count(*) AS "of" FROM bs GROUP BY 1), x AS (SELECT item_id, doc_id, count(*) AS shared FROM bs JOIN ds ON bs.s = ds.s GROUP BY 1, 2)
SELECT x.item_id, doc_id, shared, "of" FROM x JOIN n ON x.item_id = n.item_id WHERE shared >= 0.8 * "of" """)
def tx_shingle_overlap(spark, d):
    """Benchmark passages whose 8-word shingles a document holds to 80 % or more."""
    small = table(spark, d, "benchmark").select("item_id", X.words(F.col("text")).alias("words"))
    large = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("words"))
    return containment(small, large, "item_id", "doc_id", 8, 0.8)


@query("tx_exact_dups", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def tx_exact_dups(spark, d):
    by = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest"))
    return by.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).where("copies > 1")


@query("tx_html_text", r"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links, regexp_extract(html, '<img[^>]*src="([^"]*)"', 1) AS image,
 trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages)
SELECT page_id, title, CAST(links AS BIGINT) AS links, image, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS digest FROM p""")
def tx_html_text(spark, d):
    body = X.html_text(F.col("html"))
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("links"), F.regexp_extract("html", '<img[^>]*src="([^"]*)"', 1).alias("image"), body.alias("body"))
    return pages.select("page_id", "title", "links", "image", F.length("body").cast("bigint").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


@query("tx_search_prefix", f"""
WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS w FROM documents)
SELECT doc_id FROM w WHERE starts_with(w, 'tion') OR starts_with(w, 'heat') OR starts_with(w, 'ston') GROUP BY 1
HAVING bool_or(starts_with(w, 'tion')) AND bool_or(starts_with(w, 'heat')) AND bool_or(starts_with(w, 'ston')) ORDER BY doc_id DESC LIMIT 200""")
def tx_search_prefix(spark, d):
    """All terms must start some word of the document; newest first, 200."""
    terms = ["tion", "heat", "ston"]
    def all_found(words):
        return F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.exists(words, lambda w: F.startswith(w, t)))

    docs = table(spark, d, "documents").where(let(X.words(F.col("text")), all_found))  # one scan, no shuffle of words
    return docs.orderBy(F.desc("doc_id")).limit(200).select("doc_id")


def _language_sql():
    n = ", ".join(f"[len(list_filter(t, lambda w: w IN ({', '.join(repr(w) for w in s)}))), {-i}] AS s{i}" for i, (_, s) in enumerate(sorted(X.STOP_WORDS.items())))
    names = " ".join(f"WHEN m[2] = {-i} THEN '{lang}'" for i, lang in enumerate(sorted(X.STOP_WORDS)))
    return f"""WITH t AS (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^a-zà-ÿ]+') AS t FROM documents), n AS (SELECT lang, {n} FROM t), b AS (SELECT lang, greatest(s0, s1, s2, s3) AS m FROM n)
    SELECT lang, CASE WHEN m[1] = 0 THEN NULL {names} END AS guess, count(*) AS n FROM b GROUP BY 1, 2"""


@query("tx_language", _language_sql())
def tx_language(spark, d):
    docs = table(spark, d, "documents").select("lang", X.stop_word_language(F.col("text")).alias("guess"))
    return docs.groupBy("lang", "guess").agg(F.count("*").alias("n"))


@query("tx_jaccard_pairs", f"""
WITH {_shingles_sql("s", "doc_id", "documents", 5)}, k AS (SELECT doc_id, list_sort(list(s)) AS k FROM s GROUP BY 1), c AS (SELECT min(doc_id) AS rep, k FROM k GROUP BY k), r AS (SELECT rep, unnest(k) AS s, len(k) AS n FROM c),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared, x.n + y.n - count(*) AS together FROM r x JOIN r y ON x.s = y.s AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n)
SELECT a, b, shared, together FROM p WHERE shared * 100 >= 80 * together""")
def tx_jaccard_pairs(spark, d):
    """Pairs of all documents with 5-word Jaccard similarity of 0.8 or more, one document for each set of shingles."""
    return jaccard_pairs(shingle_classes(table(spark, d, "documents"), "doc_id", X.words_text(F.col("text")), 5), 5, 80)


@query("tx_jaccard_all")
def tx_jaccard_all(spark, d):
    """The pairs of tx_jaccard_pairs, without SQL; tx_jaccard_members has the documents that each of them stands for."""
    return jaccard_pairs(shingle_classes(table(spark, d, "documents"), "doc_id", X.words_text(F.col("text")), 5), 5, 80)


@query("tx_jaccard_members")
def tx_jaccard_members(spark, d):
    return shingle_members(table(spark, d, "documents"), "doc_id", X.words_text(F.col("text")), 5)


@query("ma_units", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_retailprice * 1000.0 WHEN 1 THEN p_retailprice * 1.0 WHEN 2 THEN p_retailprice * 0.45359237 WHEN 3 THEN p_retailprice * 0.0311034768 END AS kg FROM part""")
def ma_units(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("t", "kg", "lb", "oz", "stone", "bale")]), F.col("p_size") % 6 + 1)
    return table(spark, d, "part").select("p_partkey", V.converted(F.col("p_retailprice"), unit, V.WEIGHT_KG).alias("kg"))


@query("ma_sigfig", """
SELECT l_orderkey, CAST(round(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / pow(10.0, floor(log10(sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE)) - 2)) AS BIGINT) AS figures FROM lineitem GROUP BY 1""")
def ma_sigfig(spark, d):
    """First three significant figures of each order's cents."""
    totals = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("c"))
    scale = F.pow(F.lit(10.0), F.floor(F.log10("c")) - 2)
    return totals.select("l_orderkey", F.round(V.significant(F.col("c"), 3) / scale).cast("bigint").alias("figures"))


@query("ma_tolerance", """
SELECT count(*) AS n, count(*) FILTER (WHERE abs(p_retailprice - a) <= 0.05 * greatest(abs(p_retailprice), abs(a))) AS near FROM (SELECT p_retailprice, avg_c / 100.0 AS a FROM part JOIN (SELECT p_brand AS b, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) // count(*) AS avg_c FROM part GROUP BY 1) ON p_brand = b)""")
def ma_tolerance(spark, d):
    part = table(spark, d, "part")
    mean = part.groupBy("p_brand").agg(F.expr("sum(cast(round(p_retailprice * 100) as bigint)) div count(*)").alias("avg_c"))
    a = F.col("avg_c") / 100.0
    return part.join(mean, "p_brand").agg(F.count("*").alias("n"), F.count_if(V.close(F.col("p_retailprice"), a, 0.05)).alias("near"))


@query("dt_addmonths_period", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(last_day(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(quarter(o_orderdate) * 3 AS BIGINT), CAST(1 AS BIGINT))), '%Y-%m-%d') AS quarter_end,
 CAST(o_orderdate AS DATE) < DATE '2001-01-01' - INTERVAL 15 MONTH AS stale FROM orders""")
def dt_addmonths_period(spark, d):
    day = F.to_date("o_orderdate")
    end = V.period_end(F.year(day), F.quarter(day))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(V.add_months(day, 1), "yyyy-MM-dd").alias("next_month"), F.date_format(end, "yyyy-MM-dd").alias("quarter_end"), (day < V.add_months(F.lit("2001-01-01").cast("date"), -15)).alias("stale"))


@query("aj_tokens_vocab", """
WITH v(tag, place) AS (VALUES ('STEEL', 0), ('BRASS', 1), ('TIN', 2), ('LARGE', 3), ('SMALL', 4), ('ECONOMY', 5)), t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS tag FROM part)
SELECT p_partkey, coalesce(string_agg(v.tag, '|' ORDER BY place), 'other') AS tags FROM part LEFT JOIN t USING (p_partkey) LEFT JOIN v ON v.tag = t.tag GROUP BY 1""")
def aj_tokens_vocab(spark, d):
    """Tokens in the vocabulary's order, with a default."""
    vocabulary = F.array(*[F.lit(t) for t in ("STEEL", "BRASS", "TIN", "LARGE", "SMALL", "ECONOMY")])
    tags = F.array_join(F.array_intersect(vocabulary, F.split("p_type", " ")), "|")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(tags, F.lit("")), F.lit("other")).alias("tags"))


@query("aj_salted_ids", "SELECT event_id, substr(sha256(strftime(ts, '%Y-%m-%d') || ':' || user_id), 1, 16) AS visitor, sha256(concat_ws('|', user_id, event_type, epoch_us(ts))) AS key FROM events")
def aj_salted_ids(spark, d):
    from tessera.sources.tables import micros

    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", micros(F.col("ts")).cast("string")), 256)
    return table(spark, d, "events").select("event_id", X.salted_id(F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("visitor"), key.alias("key"))
