"""Readers and categories over the driver's documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.readers import Reader, Rule, categories, read
from tessera.plans.registry import query
from tessera.sources.tables import table

NUMBERS = Reader("numbers", "1.0.0", "Figures", (Rule("address", r"\b(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "ip"), Rule("card", r"\b(\d{13,16})\b", "digits")))
LICENCE = Reader("licence", "1.0.0", "Licence", (Rule("version", r"License, Version (\d+\.\d+)", "version"),))


@query("rd_facts", r"""
WITH f AS (SELECT doc_id, 'numbers' AS extractor, 'address' AS field, unnest(regexp_extract_all(text, '\b(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', 1)) AS v FROM documents
UNION ALL SELECT doc_id, 'numbers', 'card', unnest(regexp_extract_all(text, '\b(\d{13,16})\b', 1)) FROM documents UNION ALL SELECT doc_id, 'licence', 'version', unnest(regexp_extract_all(text, 'License, Version (\d+\.\d+)', 1)) FROM documents)
SELECT doc_id, extractor, field, count(*) AS n, max(CAST(v AS DOUBLE)) AS top FROM f GROUP BY 1, 2, 3""")
def rd_facts(spark, d):
    """Figures that two readers find, folded per document and field."""
    facts = read(table(spark, d, "documents"), [NUMBERS, LICENCE], "doc_id", "text")
    return facts.groupBy("doc_id", "extractor", "field").agg(F.count("*").alias("n"), F.max("value_num").alias("top"))


@query("cl_categories", r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS h, text FROM documents), c AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[|].*[|]') THEN 'Table' END,
 CASE WHEN regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|@[a-z]+\.') THEN 'Contact' END, CASE WHEN regexp_matches(h, '^(The|Der|Le|El) ') THEN 'Article' END], lambda x: x IS NOT NULL) AS tags, regexp_matches(text, 'Licensed under') AS lic FROM t),
k AS (SELECT doc_id, CASE WHEN lic THEN list_filter(tags, lambda x: x <> 'Article') ELSE tags END AS tags FROM c)
SELECT doc_id, CASE WHEN len(tags) = 0 THEN 'Other' ELSE array_to_string(tags, '|') END AS tags FROM k""")
def cl_categories(spark, d):
    layers = [("Table", "[|].*[|]", "any"), ("Contact", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|@[a-z]+\.", "any"), ("Article", "^(The|Der|Le|El) ", "headline"), ("Article", "Licensed under", "not")]
    headline = F.element_at(F.split("text", "\n"), 1)
    return table(spark, d, "documents").select("doc_id", F.array_join(categories(headline, F.col("text"), layers, "Other"), "|").alias("tags"))


@query("cl_importance", """
WITH b AS (SELECT o_orderkey, o_custkey, (CASE WHEN o_totalprice > 250000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS s,
 concat_ws(',', CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS reasons FROM orders)
SELECT o_orderkey, greatest(1, least(3, s)) AS importance, reasons FROM b""")
def cl_importance(spark, d):
    price, urgent = F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT"
    score = F.when(price > 250000, 2).when(price > 100000, 1).otherwise(0) + F.when(urgent, 1).otherwise(0)
    reasons = F.concat_ws(",", F.when(price > 250000, "large").when(price > 100000, "medium"), F.when(urgent, "urgent"))
    return table(spark, d, "orders").select("o_orderkey", F.greatest(F.lit(1), F.least(F.lit(3), score)).alias("importance"), reasons.alias("reasons"))


@query("tx_url_domains", r"""
SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)) AS paths FROM pages GROUP BY 1""")
def tx_url_domains(spark, d):
    host, path = F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(path).alias("paths"))


@query("tx_excerpts", r"""
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_extract(substr(text, 1, 80), '^((?s).*)[ \n]', 1) END AS excerpt FROM documents""")
def tx_excerpts(spark, d):
    """The first 80 characters, cut at the last blank."""
    cut = F.regexp_extract(F.substring("text", 1, 80), r"^((?s).*)[ \n]", 1)
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") <= 80, F.col("text")).otherwise(cut).alias("excerpt"))


@query("aj_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS tag FROM events")
def aj_json_props(spark, d):
    k = F.from_json("props", "k BIGINT").k
    return table(spark, d, "events").select("event_id", k.alias("k"), F.concat_ws(":", "event_type", k.cast("string")).alias("tag"))
