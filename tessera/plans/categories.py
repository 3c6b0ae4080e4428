"""The categoriser layer by layer, admission of readers' finds and the state of tags, over releases written from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import readers as R
from tessera.operators import tagging as T
from tessera.plans.measures import pick, picked
from tessera.plans.registry import query
from tessera.sources.tables import table

#: (headline, body, tags of the base layer, after rescue, after conflicts, of all layers).
CASES = (
    ("Acme intersects 12 m of ore", "Good ground.", "Drill Results", "Drill Results", "Drill Results", "Drill Results"),
    ("Acme closes private placement and credit facility", "A convertible part is included.", "Financings|Debt & Credit Facilities", "Financings|Debt & Credit Facilities", "Debt & Credit Facilities", "Debt & Credit Facilities"),
    ("Acme closes bought deal and a loan", "Plain terms.", "Financings|Debt & Credit Facilities", "Financings|Debt & Credit Facilities", "Financings|Debt & Credit Facilities", "Financings|Debt & Credit Facilities"),
    ("Permit Gold reports on its year", "All is well.", "Permits & Approvals", "Permits & Approvals", "Permits & Approvals", "Corporate Updates"),
    ("Corporate update of Acme", "Ms. Bell was appointed chair. Gross proceeds of the year were fine.", "", "Management Changes|Financings", "Management Changes|Financings", "Financings|Management Changes"),
    ("Resource estimate and assays of Acme", "More drilling planned.", "Drill Results|Resource Estimates", "Drill Results|Resource Estimates", "Resource Estimates", "Resource Estimates"),
    ("Acme intersects value", "A paid advertisement.", "Drill Results", "Drill Results", "Drill Results", "Paid Promotion"),
    ("Exploration report of Acme", "Hole 7 intersected 9 m.", "", "Drill Results", "Drill Results", "Drill Results"),
    ("Drills Resources wins a permit", "", "Drill Results|Permits & Approvals", "Drill Results|Permits & Approvals", "Drill Results|Permits & Approvals", "Permits & Approvals"),
    ("A letter to holders", "Nothing else.", "", "", "", "Corporate Updates"),
    ("Acme no longer in production: quarterly production", "The end.", "Production Results", "Production Results", "", "Corporate Updates"),
)


def _text(at: int):
    return pick(F.col("o_orderkey"), [c[at] for c in CASES])


def _sql(at: int, name: str = "tags") -> str:
    return f"""SELECT o_orderkey, {picked("o_orderkey", [c[at] for c in CASES])} AS {name} FROM orders"""


def _joined(tags):
    return F.array_join(tags, "|").alias("tags")


@query("cl_base", _sql(2))
def cl_base(spark, d):
    return table(spark, d, "orders").select("o_orderkey", _joined(R.base_tags(_text(0), R.MINING)))


@query("cl_rescue", _sql(3))
def cl_rescue(spark, d):
    """Base tags and those that headline and body earn together."""
    rows = table(spark, d, "orders").select("o_orderkey", _text(0).alias("h"), _text(1).alias("b"))
    return rows.select("o_orderkey", _joined(R.rescued(R.base_tags(F.col("h"), R.MINING), F.col("h"), F.col("b"), R.MINING)))


@query("cl_conflicts", _sql(4))
def cl_conflicts(spark, d):
    """Tags that other tags and the text rule out, rule after rule."""
    rows = table(spark, d, "orders").select("o_orderkey", _text(0).alias("h"), _text(1).alias("b"))
    tags = R.rescued(R.base_tags(F.col("h"), R.MINING), F.col("h"), F.col("b"), R.MINING)
    return rows.select("o_orderkey", _joined(R.settled(tags, F.col("h"), F.col("b"), R.MINING)))


@query("cl_name_masks", f"""
SELECT o_orderkey, replace(replace({picked("o_orderkey", [c[0] for c in CASES])}, 'Permit Gold', 'Xyz'), 'Drills Resources', 'Xyz') AS masked FROM orders""")
def cl_name_masks(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.masked(_text(0), R.MINING.names).alias("masked"))


@query("cl_composed", _sql(5))
def cl_composed(spark, d):
    """All layers: masks, base, rescue, conflicts, default, and promotion over all."""
    rows = table(spark, d, "orders").select("o_orderkey", _text(0).alias("h"), _text(1).alias("b"))
    return rows.select("o_orderkey", _joined(R.categorize(F.col("h"), F.col("b"), R.MINING)))


def _layers_sql(layers: R.Layers) -> str:
    """The layers over documents, first lines as headlines: each a list of tags, rule after rule."""
    hit = lambda column, p: "regexp_matches({}, '(?i){}')".format(column, p.replace("'", "''"))
    some = lambda pairs: "list_filter([{}], lambda x: x IS NOT NULL)".format(", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in pairs))
    names = "|".join(sorted(layers.names, key=len, reverse=True))
    steps = "s0"
    chain = []
    for k, (held, p, dropped) in enumerate(layers.conflicts, 1):
        chain.append(f"c{k} AS (SELECT * EXCLUDE (settled), CASE WHEN list_contains(settled, '{held}') AND list_contains(settled, '{dropped}') AND {hit('lead', p)} THEN list_filter(settled, lambda x: x <> '{dropped}') ELSE settled END AS settled FROM {steps})")
        steps = f"c{k}"
    ordered = f"list_filter({list(layers.vocabulary)!r}, lambda x: list_contains(settled, x))"
    return f"""
WITH t AS (SELECT doc_id, regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '(?i)\\b(?:{names})\\b', 'Xyz', 'g') AS h, coalesce(text, '') AS b FROM documents),
b0 AS (SELECT *, h || chr(10) || substr(b, 1, {R.LEAD}) AS lead, {some([(tag, hit("h", p)) for tag, p in layers.base])} AS base FROM t),
r0 AS (SELECT *, list_concat(base, {some([(tag, f"NOT list_contains(base, '{tag}') AND {hit('h', x)} AND {hit('b', y)}") for tag, x, y in layers.rescue])}) AS rescued FROM b0),
s0 AS (SELECT *, rescued AS settled FROM r0), {", ".join(chain)}
SELECT doc_id, md5(h) AS masked, array_to_string(base, '|') AS base, array_to_string(rescued, '|') AS rescued, array_to_string(settled, '|') AS settled,
 CASE WHEN {hit("b", layers.promotion[0])} THEN '{layers.promotion[1]}' WHEN len({ordered}) = 0 THEN '{layers.default}' ELSE array_to_string({ordered}, '|') END AS tags FROM {steps}"""


@query("cl_document_tags", _layers_sql(R.DOCUMENTS))
def cl_document_tags(spark, d):
    """Tags of all documents by the rules, with what each layer leaves."""
    rows = table(spark, d, "documents").select("doc_id", R.traced(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), R.DOCUMENTS).alias("t"))
    joined = [F.array_join(f"t.{layer}", "|").alias(layer) for layer in ("base", "rescued", "settled", "tags")]
    return rows.select("doc_id", F.md5(F.col("t.masked").cast("binary")).alias("masked"), *joined)


RULES = [("letter of intent", False, r"\bletter of intent\b"), ("assays given", True, r"\bassays?\b|\bintersects?\b"), ("only planned", False, r"\bplan(?:s|ned)\b")]
ADMIT = ("assays are in", "plans to drill", "a letter of intent and assays", "intersects ore", "nothing")


@query("cl_admission", f"""
WITH t AS (SELECT o_orderkey, {picked("o_custkey", ADMIT)} AS h, o_orderkey % 4 > 0 AS found FROM orders)
SELECT o_orderkey, found AND h IN ('assays are in', 'intersects ore') AS admit, CASE WHEN NOT found THEN 'nothing found' WHEN h LIKE '%letter of intent%' THEN 'letter of intent' WHEN h IN ('assays are in', 'intersects ore') THEN 'assays given' WHEN h = 'plans to drill' THEN 'only planned' ELSE 'no rule' END AS reason FROM t""")
def cl_admission(spark, d):
    """Whether a find outside its tag earns the tag, and why."""
    verdict = R.admitted(F.col("o_orderkey") % 4 > 0, pick(F.col("o_custkey"), ADMIT), F.lit(""), RULES)
    return table(spark, d, "orders").select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.admit", "v.reason")


@query("cl_tag_state", """
WITH g AS (SELECT o_orderkey AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'dropped' ELSE 'active' END AS status FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT o_orderkey AS e, o_custkey % 2 = 0 AS admit FROM orders WHERE o_orderkey % 4 > 0)
SELECT coalesce(g.e, s.e) AS event_id, CASE WHEN coalesce(admit, false) THEN 'active' ELSE CASE WHEN g.e IS NOT NULL THEN 'dropped' END END AS status, CASE WHEN coalesce(admit, false) AND coalesce(status, '') <> 'active' THEN 'added' WHEN NOT coalesce(admit, false) AND status = 'active' THEN 'dropped' ELSE 'kept' END AS step
FROM g FULL JOIN s ON g.e = s.e WHERE g.e IS NOT NULL OR admit""")
def cl_tag_state(spark, d):
    """Decisions settled into tags: added, dropped, kept."""
    orders = table(spark, d, "orders")
    tags = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 5 == 0, "dropped").otherwise("active").alias("status"), F.array(F.lit("Old")).alias("before"))
    decisions = orders.where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 2 == 0).alias("admit"), F.array("o_orderpriority").alias("categories"))
    return T.settle(tags, decisions).select("event_id", "status", "step")


@query("cl_reassert", """
SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'Old' ELSE o_orderpriority || '|Drill Results' END AS tags FROM orders""")
def cl_reassert(spark, d):
    """Categories after tags were put on, and put back where they were dropped."""
    orders = table(spark, d, "orders")
    tags = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 5 == 0, "dropped").otherwise("active").alias("status"), F.array(F.lit("Old")).alias("before"))
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.array("o_orderpriority").alias("categories"))
    return T.reasserted(events, tags, "Drill Results", "Corporate Updates").select("event_id", _joined(F.col("categories")))


@query("cl_relevance", r"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\b(?:apache|license|software|the)\b')) AS BIGINT) AS hits, len(regexp_extract_all(lower(text), '\b(?:apache|license|software|the)\b')) >= 3 AS relevant FROM documents""")
def cl_relevance(spark, d):
    """Texts with at least three words of a field."""
    hits = F.regexp_count(F.lower("text"), F.lit(r"\b(?:apache|license|software|the)\b")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", hits.alias("hits"), (hits >= 3).alias("relevant"))


@query("cl_tickers", f"""
SELECT c_custkey, {picked("c_custkey", ("ABC.V", "ABC.TO|XYZ.US", "", "QQ.CN|QQ.AX"))} AS tickers FROM customer""")
def cl_tickers(spark, d):
    said = pick(F.col("c_custkey"), ("Acme (TSXV: ABC) reports", "Acme (TSX: ABC; NYSE: XYZ), again TSX:ABC", "Acme (OTCQB: ABCDF) reports", "CSE:QQ and ASX: QQ"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(R.tickers_in(said), "|").alias("tickers"))
