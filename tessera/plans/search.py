"""Full-text search on a stored index of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.dictionary import names_in
from tessera.plans.registry import query
from tessera.plans.texts import WORDS_SQL
from tessera.sources.tables import shared_folder, table

_FOUND = f"""
WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS w FROM documents)
SELECT doc_id FROM w WHERE starts_with(w, 'tion') OR starts_with(w, 'heat') OR starts_with(w, 'ston') GROUP BY 1
HAVING bool_or(starts_with(w, 'tion')) AND bool_or(starts_with(w, 'heat')) AND bool_or(starts_with(w, 'ston'))"""


@query("tx_search_index", f"{_FOUND} ORDER BY doc_id DESC LIMIT 200")
def tx_search_index(spark, d):
    """All terms must start some word of the document; newest first, 200; from the index."""
    path = shared_folder(spark, "index")
    S.build(table(spark, d, "documents"), path)
    return S.search(spark, path, ["tion", "heat", "ston"])


@query("tx_search_refreshed", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'heat tions stone ' || text ELSE text END AS text FROM documents WHERE doc_id % 11 > 0), w AS (SELECT doc_id, unnest({WORDS_SQL}) AS w FROM d)
SELECT doc_id FROM w GROUP BY 1 HAVING bool_or(starts_with(w, 'tion')) AND bool_or(starts_with(w, 'heat')) AND bool_or(starts_with(w, 'ston'))""")
def tx_search_refreshed(spark, d):
    """The same, all finds, after some documents changed and others were removed."""
    path, docs = shared_folder(spark, "index"), table(spark, d, "documents")
    S.build(docs, path)
    changed = docs.where("doc_id % 7 = 0 or doc_id % 11 = 0")
    S.refresh(changed.select("doc_id", F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("heat tions stone "), "text")).alias("text")), path)
    return S.search(spark, path, ["tion", "heat", "ston"], None)


@query("cl_names_in_documents", f"""
WITH w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {WORDS_SQL} AS t FROM documents)),
n AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) FROM part UNION SELECT unnest(['the', 'of the', 'in the', 'that'])),
g AS (SELECT doc_id, pos, w, w || ' ' || lead(w, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS two FROM w),
f AS (SELECT doc_id, pos, CASE WHEN two IN (SELECT name FROM n) THEN two ELSE w END AS name, CASE WHEN two IN (SELECT name FROM n) THEN 2 ELSE 1 END AS k FROM g WHERE two IN (SELECT name FROM n) OR w IN (SELECT name FROM n)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos - lag(pos + k) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM f),
s AS (SELECT *, sum(CASE WHEN gap < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS j FROM s)
SELECT doc_id, name, count(*) AS n FROM t WHERE j = 1 GROUP BY 1, 2""")
def cl_names_in_documents(spark, d):
    """Names of parts, their first words and a few more, in all documents: the longest first, none over another."""
    parts = table(spark, d, "part").select(F.lower("p_name").alias("name"))
    more = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ("the", "of the", "in the", "that")])).alias("name"))
    names = parts.union(parts.select(F.split_part("name", F.lit(" "), F.lit(1)))).union(more)
    found = names_in(table(spark, d, "documents"), "doc_id", "text", names)
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("n"))
