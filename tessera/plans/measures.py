"""Metals, grades, quantities, money and dates over figures and texts that the driver's tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import measures as M
from tessera.functions import periods as P
from tessera.functions import values as V
from tessera.plans.registry import query
from tessera.sources.tables import table


def pick(n, items):
    """The item of a short list that a number chooses."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(n, F.lit(len(items))) + 1).cast("int"))


def picked(n: str, items) -> str:
    """The same in SQL."""
    return f"list_value({', '.join(repr(x) for x in items)})[({n}) % {len(items)} + 1]"


def cases(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {'NULL' if v is None else repr(v)}" for k, v in table.items()) + " END"


#: What people write for metals, and what is meant ("" for nothing known).
TOKENS = {
    "gold": "Au", " Silver ": "Ag", "Cu": "Cu", "AU": "Au", "AuEq": "AuEq", "gold equivalent": "AuEq", "Au-Eq": "AuEq", "copper eq.": "CuEq", "Au+Ag": "Au+Ag", "copper-gold": "Cu+Au", "Zn / Pb": "Zn+Pb",
    "zinc and lead": "Zn+Pb", "u3o8": "U3O8", "lithium carbonate equivalent": "LCE", "TREO": "TREO", "total copper": "Cu", "graphite": "Cg", "iron": "", "Total": "", "gold+dust": "", "as": "", "Li2O": "Li2O",
}
UNITS = ("g/t", "%", "ppm", "ppb", "oz/t", "kg/t", "opt", "grams  per tonne", "Pct", "g per bag")
CANON = {"g/t": "g/t", "%": "%", "ppm": "ppm", "ppb": "ppb", "oz/t": "oz/t", "kg/t": "kg/t", "opt": "oz/t", "grams  per tonne": "g/t", "Pct": "%", "g per bag": None}
PPM = {"g/t": 1.0, "ppm": 1.0, "ppb": 0.001, "%": 10000.0, "oz/t": 34.2857, "kg/t": 1000.0}
METALS = ("Au", "Ag", "Cu", "AuEq", "Zn+Pb", "Pt+Pd", "U3O8", "U", "AgEq", "Mo")
FIVE = ("g/t", "%", "ppm", "oz/t", "kg/t", "ppb")


@query("ma_metals", f"""
WITH t AS (SELECT p_partkey, {picked("p_partkey", list(TOKENS))} AS token FROM part)
SELECT p_partkey, {cases("token", TOKENS)} AS symbols FROM t""")
def ma_metals(spark, d):
    token = pick(F.col("p_partkey"), list(TOKENS))
    return table(spark, d, "part").select("p_partkey", F.array_join(M.metals(token), "+").alias("symbols"))


@query("ma_family", f"""
WITH t AS (SELECT p_partkey, {picked("p_partkey", list(METALS))} AS m FROM part)
SELECT p_partkey, {cases("m", {"Au": "Au", "Ag": "Ag", "Cu": "Cu", "AuEq": "Au", "Zn+Pb": "Zn", "Pt+Pd": "PGE", "U3O8": "U", "U": "U", "AgEq": "Ag", "Mo": "Mo"})} AS family,
 {cases("m", {"Au": "AU", "Ag": "AG", "Cu": "CU", "AuEq": "AU", "Zn+Pb": "ZN+PB", "Pt+Pd": "PT+PD", "U3O8": "U3O8", "U": "U", "AgEq": "AG", "Mo": "MO"})} AS ranking, m IN ('Au', 'Ag', 'AuEq', 'Pt+Pd', 'AgEq') AS precious FROM t""")
def ma_family(spark, d):
    m = pick(F.col("p_partkey"), METALS)
    return table(spark, d, "part").select("p_partkey", M.family(m).alias("family"), M.ranking_family(m).alias("ranking"), M.is_precious(m).alias("precious"))


@query("ma_grade_ppm", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, {picked("l_partkey", UNITS)} AS token FROM lineitem), u AS (SELECT *, {cases("token", CANON)} AS unit FROM t)
SELECT unit, count(*) AS n, coalesce(sum(CAST(round(l_quantity * {cases("unit", PPM)} * 1000) AS BIGINT))::BIGINT, -1) AS milli_ppm FROM u GROUP BY 1""")
def ma_grade_ppm(spark, d):
    """Grades in any spelling of a unit, in parts per million by unit."""
    rows = table(spark, d, "lineitem").select("l_quantity", M.grade_unit(pick(F.col("l_partkey"), UNITS)).alias("unit"))
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.round(M.grade_ppm(F.col("l_quantity"), F.col("unit")) * 1000).cast("bigint")), F.lit(-1)).alias("milli_ppm"))


@query("ma_plausible", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS grade, {picked("l_partkey", FIVE)} AS unit, {picked("l_suppkey", METALS)} AS metal FROM lineitem),
c AS (SELECT *, string_split(metal, '+')[1] || ' ' || unit AS both_keys FROM t)
SELECT unit, metal, count(*) AS n, count(*) FILTER (WHERE grade <= coalesce({cases("both_keys", M.LIMITS)}, {cases("unit", M.LIMITS)})) AS plausible FROM c GROUP BY 1, 2""")
def ma_plausible(spark, d):
    """Intercept grades that can be meant, by unit and metal."""
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") * 3).alias("grade"), pick(F.col("l_partkey"), FIVE).alias("unit"), pick(F.col("l_suppkey"), METALS).alias("metal"))
    return rows.groupBy("unit", "metal").agg(F.count("*").alias("n"), F.count_if(M.plausible_grade(F.col("grade"), F.col("unit"), F.col("metal"))).alias("plausible"))


QUANTITIES = {"m": ("m", 1.0), "Feet": ("m", 0.3048), "Mt": ("t", 1e6), "million  tonnes": ("t", 1e6), "metric tonnes": ("t", 1.0), "short tons": ("t", 0.90718474), "tons": ("", None), "koz": ("oz", 1e3), "troy ounces": ("oz", 1.0), "Mlb": ("lb", 1e6), "pounds": ("lb", 1.0), "bushels": ("", None)}


@query("ma_quantities", f"""
WITH t AS (SELECT p_partkey, p_size, {picked("p_partkey", list(QUANTITIES))} AS u FROM part)
SELECT p_partkey, (p_size * {cases("u", {k: f for k, (kind, f) in QUANTITIES.items() if kind == "m"})})::DOUBLE AS metres, (p_size * {cases("u", {k: f for k, (kind, f) in QUANTITIES.items() if kind == "t"})})::DOUBLE AS tonnes,
 (p_size * {cases("u", {k: f for k, (kind, f) in QUANTITIES.items() if kind == "oz"})})::DOUBLE AS ounces, (p_size * {cases("u", {k: f for k, (kind, f) in QUANTITIES.items() if kind == "lb"})})::DOUBLE AS pounds FROM t""")
def ma_quantities(spark, d):
    """Lengths, tonnages, ounces and pounds in base units; ambiguous units give nothing."""
    unit, size = pick(F.col("p_partkey"), list(QUANTITIES)), F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", *[M.quantity(size, unit, t).alias(n) for n, t in (("metres", M.METRES), ("tonnes", M.TONNES), ("ounces", M.OUNCES), ("pounds", M.POUNDS))])


@query("ma_contained", f"""
WITH t AS (SELECT p_partkey, p_retailprice * 1000 AS tonnage, CAST(p_size AS DOUBLE) AS grade, {picked("p_partkey", FIVE)} AS unit, {picked("p_size", METALS)} AS metal FROM part), m AS (SELECT *, tonnage * (grade * {cases("unit", PPM)}) / 1e6 AS t FROM t)
SELECT p_partkey, CAST(round(t * 100) AS BIGINT) AS t_cents, CASE WHEN metal IN ('Au', 'Ag', 'AuEq', 'AgEq') THEN CAST(round(t * 1e6 / 31.1035) AS BIGINT) ELSE -1 END AS oz, CASE WHEN metal IN ('Cu', 'U3O8', 'Mo') THEN CAST(round(t * 2204.62) AS BIGINT) ELSE -1 END AS lb FROM m""")
def ma_contained(spark, d):
    c = M.contained(F.col("p_retailprice") * 1000, F.col("p_size").cast("double"), pick(F.col("p_partkey"), FIVE), pick(F.col("p_size"), METALS))
    rows = table(spark, d, "part").select("p_partkey", c.alias("c"))
    return rows.select("p_partkey", F.round(F.col("c.t") * 100).cast("bigint").alias("t_cents"), F.coalesce(F.round("c.oz").cast("bigint"), F.lit(-1)).alias("oz"), F.coalesce(F.round("c.lb").cast("bigint"), F.lit(-1)).alias("lb"))


@query("ma_interval_value", f"""
WITH t AS (SELECT l_orderkey, l_quantity * 3 AS grade, l_linenumber * 1.5 AS metres, {picked("l_partkey", FIVE)} AS unit, {picked("l_suppkey", METALS)} AS metal FROM lineitem),
f AS (SELECT *, CASE WHEN unit = '%' AND grade > 100 THEN NULL WHEN metal IN ('Au', 'Ag', 'AuEq', 'AgEq', 'Pt+Pd') THEN CASE WHEN unit = '%' THEN NULL ELSE {cases("unit", PPM)} END ELSE {cases("unit", PPM)} / 10000.0 END AS f FROM t)
SELECT metal, unit, count(*) AS n, count(f) AS valued, coalesce(CAST(round(sum(grade * f * metres)) AS BIGINT), -1) AS total FROM f GROUP BY 1, 2""")
def ma_interval_value(spark, d):
    """Grade times length in the display unit of the metal's class."""
    value = M.interval_value(F.col("l_quantity") * 3, F.col("unit"), F.col("metal"), F.col("l_linenumber") * 1.5)
    rows = table(spark, d, "lineitem").select("l_quantity", "l_linenumber", pick(F.col("l_partkey"), FIVE).alias("unit"), pick(F.col("l_suppkey"), METALS).alias("metal")).withColumn("v", value)
    return rows.groupBy("metal", "unit").agg(F.count("*").alias("n"), F.count("v").alias("valued"), F.coalesce(F.round(F.sum("v")).cast("bigint"), F.lit(-1)).alias("total"))


@query("ma_thresholds", f"""
WITH t AS (SELECT l_quantity AS grade, l_linenumber AS metres, {picked("l_partkey", FIVE)} AS unit, {picked("l_suppkey", METALS)} AS metal FROM lineitem),
f AS (SELECT *, CASE WHEN unit IN ('g/t', 'ppm') AND metal LIKE 'Au%' THEN 'au_gm' WHEN unit IN ('g/t', 'ppm') AND metal LIKE 'Ag%' THEN 'ag_gm' WHEN unit = '%' AND metal LIKE 'Cu%' THEN 'cu_pm' WHEN unit = 'g/t' THEN 'other_gt' WHEN unit = '%' THEN 'other_pct' ELSE 'other' END AS family FROM t)
SELECT family, count(*) AS n, CAST(sum(grade * metres) AS BIGINT) AS total FROM f GROUP BY 1""")
def ma_thresholds(spark, d):
    rows = table(spark, d, "lineitem").select(M.threshold_family(F.col("l_quantity"), pick(F.col("l_partkey"), FIVE), pick(F.col("l_suppkey"), METALS), F.col("l_linenumber").cast("double")).alias("f"))
    return rows.groupBy("f.family").agg(F.count("*").alias("n"), F.sum("f.value").cast("bigint").alias("total"))


MARKS = {"US$": "USD", "C$": "CAD", "$": None, "A$": "AUD", "£": "GBP", "€": "EUR", "CDN$": "CAD", "NZ$": "NZD"}
SIZES = {" million": 1e6, "M": 1e6, " billion": 1e9, "": 1.0, " thousand": 1e3, "-million": 1e6}


@query("ma_money", f"""
WITH t AS (SELECT o_orderkey, {picked("o_orderkey", list(MARKS))} AS mark, {picked("o_custkey", list(SIZES))} AS size, CAST(floor(o_totalprice) AS BIGINT) % 1000 + 1 AS a, CAST(floor(o_totalprice) AS BIGINT) % 10 AS b FROM orders),
f AS (SELECT o_orderkey, mark, a + b / 10.0 AS x, {cases("size", SIZES)} AS times, length('Raised ' || mark || a || '.' || b || size) AS e FROM t)
SELECT o_orderkey, CAST(7 AS INT) AS s0, CAST(e AS INT) AS e0, CAST(e + 5 AS INT) AS s1, CAST(round(x * times * 10) AS BIGINT) AS tenths, {cases("mark", MARKS)} AS currency, 2 AS finds, CAST(2000000 AS DOUBLE) AS second FROM f""")
def ma_money(spark, d):
    """Two amounts a text, with their places: the first in many spellings, the second a slip of the pen."""
    whole = F.floor("o_totalprice")
    text = F.concat(F.lit("Raised "), pick(F.col("o_orderkey"), list(MARKS)), (whole % 1000 + 1).cast("string"), F.lit("."), (whole % 10).cast("string"), pick(F.col("o_custkey"), list(SIZES)), F.lit(" and $2,000, 000 million more."))
    rows = table(spark, d, "orders").select("o_orderkey", M.money(text).alias("m"))
    first = F.col("m")[0]
    return rows.select("o_orderkey", first.start.alias("s0"), first.end.alias("e0"), F.col("m")[1].start.alias("s1"), F.round(first.value * 10).cast("bigint").alias("tenths"), first.currency.alias("currency"), F.size("m").alias("finds"), F.col("m")[1].value.alias("second"))


@query("ma_rank_fx", f"""
SELECT o_orderkey, CAST(round(o_totalprice * coalesce({cases(picked("o_orderkey", ("CAD", "usd", "AUD", "GBP", "EUR", "JPY")), {"CAD": 1.0, "usd": 1.38, "AUD": 0.9, "GBP": 1.85, "EUR": 1.6})}, 1.0)) AS BIGINT) AS cad FROM orders""")
def ma_rank_fx(spark, d):
    currency = pick(F.col("o_orderkey"), ("CAD", "usd", "AUD", "GBP", "EUR", "JPY"))
    return table(spark, d, "orders").select("o_orderkey", F.round(M.ranked_cad(F.col("o_totalprice"), currency)).cast("bigint").alias("cad"))


@query("ma_consolidation", """
WITH t AS (SELECT p_partkey, p_size AS n, p_partkey % 5 AS form FROM part)
SELECT p_partkey, CASE WHEN form = 4 THEN '10:1' WHEN n > 1 THEN n || ':1' END AS ratio FROM t""")
def ma_consolidation(spark, d):
    """Ratios read from five ways to say them."""
    n, form = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    said = [F.concat(F.lit("one new share for every "), n, F.lit(" old shares")), F.concat(F.lit("a "), n, F.lit(":1 consolidation")), F.concat(F.lit("consolidated "), n, F.lit(" existing shares into one common share")), F.concat(F.lit("a 1-for-"), n, F.lit(" roll back")), F.lit("one post-consolidation share for each ten old shares")]
    text = F.when(form == 0, said[0]).when(form == 1, said[1]).when(form == 2, said[2]).when(form == 3, said[3]).otherwise(said[4])
    return table(spark, d, "part").select("p_partkey", M.consolidation(text).alias("ratio"))


@query("ma_significant", """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 0.0 ELSE round(o_totalprice * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * pow(10.0, 2 - floor(log10(o_totalprice)))) / pow(10.0, 2 - floor(log10(o_totalprice))) END AS figures FROM orders""")
def ma_significant(spark, d):
    """Three significant figures, of negative values and of zero too."""
    price = F.when(F.col("o_orderkey") % 97 == 0, 0.0).otherwise(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1))
    return table(spark, d, "orders").select("o_orderkey", V.significant(price, 3).alias("figures"))


@query("dt_lenient", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def dt_lenient(spark, d):
    """Dates written in five formats, and one that isn't a date."""
    written = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")] + [F.lit("soon")]
    text = F.element_at(F.array(*written), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(V.lenient_date(text), "yyyy-MM-dd").alias("day"))


@query("dt_period_kinds", """
WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 5 AS form FROM orders),
p AS (SELECT *, CASE form WHEN 0 THEN 'Q' || ((m + 2) // 3) || ' ' || y WHEN 1 THEN 'H' || (CASE WHEN m <= 6 THEN 1 ELSE 2 END) || ' ' || y WHEN 2 THEN '9M ' || y WHEN 3 THEN 'FY ' || y ELSE y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') END AS period,
 CASE form WHEN 0 THEN (m + 2) // 3 * 3 WHEN 1 THEN CASE WHEN m <= 6 THEN 6 ELSE 12 END WHEN 2 THEN 9 WHEN 3 THEN 12 ELSE m END AS last FROM t)
SELECT o_orderkey, period, strftime(last_day(make_date(y, CAST(last AS BIGINT), CAST(1 AS BIGINT))), '%Y-%m-%d') AS period_end, list_value('quarter', 'half', 'nine months', 'year', 'month')[form + 1] AS kind,
 last_day(make_date(y, CAST(last AS BIGINT), CAST(1 AS BIGINT))) < DATE '2001-08-01' - INTERVAL (CASE WHEN form = 3 THEN 15 ELSE 7 END) MONTH AS stale FROM p""")
def dt_period_kinds(spark, d):
    """Quarters, halves, nine months, years and months: their last day, kind and staleness (15 months for years, 7 for others)."""
    y, m, form = F.year("o_orderdate").cast("string"), F.month("o_orderdate"), F.col("o_orderkey") % 5
    period = F.when(form == 0, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), y)).when(form == 1, F.concat(F.when(m <= 6, "H1 ").otherwise("H2 "), y)).when(form == 2, F.concat(F.lit("9M "), y)).when(form == 3, F.concat(F.lit("FY "), y)).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    rows = table(spark, d, "orders").select("o_orderkey", period.alias("period"))
    return rows.select("o_orderkey", "period", F.date_format(P.end_of(F.col("period")), "yyyy-MM-dd").alias("period_end"), P.kind_of(F.col("period")).alias("kind"), P.stale(F.col("period"), F.lit("2001-08-01").cast("date")).alias("stale"))


@query("dt_fiscal_named", """
WITH t AS (SELECT o_orderkey, quarter(o_orderdate) AS q, year(o_orderdate) AS y, o_orderkey % 6 AS form, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, form IN (0, 1, 2) AND last_day(make_date(y, q * 3, CAST(1 AS BIGINT))) > day AS named FROM t""")
def dt_fiscal_named(spark, d):
    """Whether a headline names the quarter that isn't over yet, as a result and not as a plan."""
    q, y, form = F.quarter("o_orderdate"), F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 6
    ordinal = F.element_at(F.array(*[F.lit(w) for w in ("First", "Second", "Third", "Fourth")]), q)
    said = [F.concat(F.lit("Reports Q"), q.cast("string"), F.lit(" "), y, F.lit(" results")), F.concat(F.lit("Results of the "), ordinal, F.lit("-quarter of "), y), F.concat(ordinal, F.lit(" quarter "), y, F.lit(" production")),
            F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), y, F.lit(" guidance and results")), F.concat(F.lit("Expects to double production by Q"), q.cast("string"), F.lit(" "), y), F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), y, F.lit(" shareholder letter"))]
    headline = F.element_at(F.array(*said), (form + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", headline.alias("h"), F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), y).alias("period"), F.to_date("o_orderdate").alias("day"))
    return rows.select("o_orderkey", P.fiscal_named(F.col("period"), F.col("h"), F.col("day")).alias("named"))


@query("dt_day_gap", """
SELECT o_orderkey, coalesce(abs(CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 7 > 0 THEN DATE '1998-02-28' END), 1000000) AS days FROM orders""")
def dt_day_gap(spark, d):
    other = F.when(F.col("o_orderkey") % 7 > 0, F.lit("1998-02-28").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", P.day_gap(F.to_date("o_orderdate"), other).cast("bigint").alias("days"))


@query("dt_cited_year", """
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 20 AS INTEGER) AS cited FROM orders)
SELECT o_orderkey, strftime(CASE WHEN cited - day > 3 THEN CASE WHEN month(cited) = 2 AND day(cited) = 29 THEN cited ELSE cited - INTERVAL 1 YEAR END ELSE cited END, '%Y-%m-%d') AS fixed FROM t""")
def dt_cited_year(spark, d):
    """A cited date more than three days after the release is last year's (29 February stays)."""
    day = F.to_date("o_orderdate")
    cited = F.date_add(day, (F.col("o_orderkey") % 40 - 20).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(P.cited_before(F.array(cited), day)[0], "yyyy-MM-dd").alias("fixed"))


CLAIMS = ("cancelled", "postponed held", "proposed", "proposed effective", "done", "done proposed", "held", "")
STRONGEST = ("cancelled", "postponed", "proposed", "effective", "done", "done", "held", "")


@query("dt_event_status", f"""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INTEGER) END AS moment, {picked("o_custkey", STRONGEST)} AS claim, o_custkey % 3 = 0 AS meeting FROM orders),
s AS (SELECT o_orderkey, meeting, CASE claim {" ".join(f"WHEN {c!r} THEN {list(found)!r}" for c, found in P.STATUS.items())} END[CASE WHEN moment < day THEN 1 WHEN moment = day THEN 2 WHEN moment > day THEN 3 ELSE 4 END] AS status FROM t)
SELECT o_orderkey, CASE WHEN meeting AND status = 'proposed' THEN 'scheduled' ELSE status END AS status FROM s""")
def dt_event_status(spark, d):
    """Status of an event from what a text claims of it and its date against the text's."""
    day = F.to_date("o_orderdate")
    at = F.when(F.col("o_orderkey") % 9 > 0, F.date_add(day, (F.col("o_orderkey") % 9 - 4).cast("int")))
    kind = F.when(F.col("o_custkey") % 3 == 0, "meeting").otherwise("split")
    return table(spark, d, "orders").select("o_orderkey", P.event_status(F.split(pick(F.col("o_custkey"), CLAIMS), " "), kind, at, day, ("split",)).alias("status"))


@query("dt_trading_hours", """
WITH t AS (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto' AS local FROM events)
SELECT event_id, isodow(local) < 6 AND hour(local) * 60 + minute(local) >= 570 AND hour(local) * 60 + minute(local) < 960 AS open FROM t""")
def dt_trading_hours(spark, d):
    return table(spark, d, "events").select("event_id", P.trading_hours(F.col("ts").cast("timestamp")).alias("open"))
