"""One query per reader: releases are written from the orders, read back, and compared with what was written.

A release has sentences with figures of the order, between sentences that say much the same but nothing to read. Templates hold
expressions that Spark and DuckDB share; the expected facts are those expressions, so the SQL never reads a text.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions.extractors import READERS, extracted
from tessera.plans.registry import query
from tessera.sources.tables import table

K, C = "o_orderkey", "o_custkey"


def one_of(n: str, *items: str) -> str:
    return f"(CASE ({n}) % {len(items)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END)"


def text(n: str) -> str:
    return f"CAST({n} AS STRING)"


def decimal(n: str, most: int) -> str:
    return f"concat({text(f'{n} % {most} + 1')}, '.', {text(f'{n} % 10')})"


DAY = f"concat({text(f'2000 + {K} % 25')}, '-0', {text(f'{K} % 9 + 1')}, '-1', {text(f'{C} % 10')})"
PROJECT = f"concat({one_of(K, 'Aurora', 'Blue Ridge', 'Cedar', 'Dunmore East')}, {one_of(C, '', ' North', ' Deep')})"
MARK = one_of(C, "US$", "C$", "A$")
MILLIONS = f"concat({MARK}, {decimal(K, 90)}, ' million')"
CENTS = f"concat({MARK}, '0.', {text(f'{K} % 90 + 10')})"
THOUSANDS = f"concat({text(f'{K} % 900 + 1')}, ',', {text(f'{C} % 900 + 100')})"
PCT, GRAMS, LONG = decimal(C, 9), decimal(K, 40), decimal(f"({K} + {C})", 300)
METAL, UNIT = one_of(K, "gold", "silver", "Cu", "AuEq"), one_of(K, "g/t", "g/t", "%", "g/t")
FILLER = ("Work went on at the hole. It was a private placement of trust, an estimate of resources in words only. ", "\nThe base case is that nobody resigned; production is as planned. The mill ran on 3 May.")

#: Templates by reader: {field: expression} in the order of the text, and what stands between.
TEMPLATES: dict[str, str] = {
    "drill_results": f"Hole {{hole|concat('DH-', {text(K)})}} intersected {{length|{LONG}}} metres of {{grade|{GRAMS}}} {{unit|{UNIT}}} {{metal|{METAL}}} from {{from|{text(f'{C} + 3')}}} m.",
    "financings": f"The company {{role|{one_of(K, 'announces', 'closes', 'upsizes')}}} a non-brokered {{type|{one_of(C, 'private placement', 'bought deal')}}} of {{units|{THOUSANDS}}} units at a price of {{price|{CENTS}}} per unit for gross proceeds of {{amount|{MILLIONS}}}.",
    "management": f"{{person|concat({one_of(K, 'Ann', 'Bo', 'Cy')}, ' ', {one_of(C, 'Arden', 'Bell', 'Cole', 'Drew')})}} {one_of(K, 'has been', 'was')}~{{action|{one_of(C, 'appointed', 'named')}}} as {{role|{one_of(K, 'Chief Financial Officer', 'Director', 'President')}}}.",
    "resources": f"{{category|{one_of(K, 'Indicated', 'inferred', 'Measured and Indicated')}}} mineral resources of {{tonnes|{LONG}}} {{tonnes_unit|{one_of(C, 'Mt', 'million tonnes')}}} grading {{grade|{GRAMS}}} {{unit|{UNIT}}} {{metal|{METAL}}} for {{contained|{THOUSANDS}}} {{contained_unit|{one_of(K, 'ounces', 'oz', 'pounds')}}}.",
    "economics": f"The {{scenario|{one_of(K, 'base case', 'spot case')}}} has an {{basis|{one_of(C, 'after-tax', 'pre-tax')}}} NPV ({{discount|{text(f'{C} % 8 + 3')}}}%) of {{npv|{MILLIONS}}} and an IRR of {{irr|{PCT}}}%.",
    "production": f"The mine produced {{quantity|{THOUSANDS}}} {{unit|{one_of(C, 'ounces', 'pounds', 'tonnes')}}} of {{metal|{METAL}}} in {{period|concat({one_of(K, 'Q1', 'Q4', 'H2', 'FY')}, ' 20', {text(f'{C} % 15 + 10')})}}.",
    "royalties": f"It {{action|{one_of(K, 'acquires', 'sells', 'grants')}}} a {{rate|{PCT}}}% {{kind|{one_of(C, 'NSR', 'gross royalty', 'stream')}}} on the {{project|{PROJECT}}} for {{price|{MILLIONS}}}.",
    "exploration": f"It {{status|{one_of(K, 'begins', 'completes', 'plans')}}} a {{metres|{THOUSANDS}}} metre {{work|{one_of(C, 'diamond drilling', 'RC drilling', 'trenching')}}} program at the {{project|{PROJECT}}}.",
    "technical": f"It {{status|{one_of(K, 'files', 'amends')}}} an independent {{standard|{one_of(C, 'NI 43-101', 'JORC')}}} technical report on the {{project|{PROJECT}}} dated {{dated|{DAY}}}.",
    "permits": f"It {{stage|{one_of(K, 'receives', 'renews', 'applies for')}}} its {{permit|{one_of(C, 'mining permit', 'drill permit', 'water licence')}}} for the {{project|{PROJECT}}} valid until {{until|{DAY}}}.",
    "options": f"It {{deal|{one_of(K, 'options', 'acquires')}}} up to a {{interest|{text(f'{C} % 99 + 1')}}}% interest in the {{project|{PROJECT}}} by paying {{cash|{MILLIONS}}} and issuing {{shares|{THOUSANDS}}} shares over {{years|{text(f'{C} % 5 + 2')}}} years.",
    "debt": f"It {{stage|{one_of(K, 'signs', 'draws', 'extends')}}} a {{amount|{MILLIONS}}} {{instrument|{one_of(C, 'credit facility', 'term loan', 'bridge loan')}}} bearing {{rate|{PCT}}}% interest, due {{matures|{DAY}}}.",
    "mine_dev": f"It {{event|{one_of(K, 'starts', 'suspends', 'restarts')}}} {{what|{one_of(C, 'commercial production', 'construction', 'commissioning')}}} at the {{project|{PROJECT}}} on {{on|{DAY}}}.",
    "sampling": f"{{type|{one_of(K, 'Grab samples', 'channel samples')}}} from the {{project|{PROJECT}}} returned up to {{grade|{GRAMS}}} {{unit|{UNIT}}} {{metal|{METAL}}} from {{n|{text(f'{C} % 80 + 2')}}} samples.",
    "warrant_changes": f"It {{change|{one_of(K, 'extends', 'reprices')}}} {{warrants|{THOUSANDS}}} warrants exercisable at {{price|{CENTS}}} to {{until|{DAY}}}.",
    "calendar": f"The {{kind|{one_of(K, 'annual meeting', 'conference call', 'record date')}}} is on {{on|{DAY}}} at {{at|concat({text(f'{C} % 9 + 10')}, ':30')}}.",
    "royalty_terms": f"It holds a {{interest|{text(f'{C} % 4 + 2')}}}% {{kind|{one_of(K, 'NSR', 'GOR', 'NPI')}}}, of which {{buyback|{text(f'{K} % 2 + 1')}}}% may be bought back for {{buyback_price|{MILLIONS}}} before {{before|{DAY}}}.",
    "bulletins": f"BULLETIN TYPE: {{type|{one_of(K, 'Halt', 'Resume Trading', 'Name Change')}}}\nBULLETIN DATE: {{date|{DAY}}}\n{{issuer|{PROJECT}}} (\"{{symbol|{one_of(C, 'ABC', 'DEF.H', 'XY')}}}\").",
    "drill_depths": f"{{hole|concat('DD-', {text(K)})}} | {{from|{decimal(C, 90)}}} | {{to|{LONG}}} | {{length|{PCT}}} | {{grade|{GRAMS}}} |",
    "drill_results_old": f"Assays gave {{grade|{GRAMS}}} {{unit|{UNIT}}} {{metal|{METAL}}} over {{length|{LONG}}} metres.",
}
TEMPLATES["management"] = TEMPLATES["management"].replace(f"{one_of(K, 'has been', 'was')}~", "has been ")


def _parts(template: str) -> list[tuple[str, str]]:
    """(field or "", expression) of a template, in order."""
    out = []
    for piece in re.split(r"(\{[a-z_]+\|.*?\}(?=[^']|$))", template):
        if piece.startswith("{") and "|" in piece:
            field, expression = piece[1:-1].split("|", 1)
            out.append((field, expression))
        elif piece:
            out.append(("", "'" + piece.replace("'", "''") + "'"))
    return out


def _register(name: str) -> None:
    parts = _parts(TEMPLATES[name])
    sentence = f"concat({', '.join(e for _, e in parts)})"
    twice = f"concat('{FILLER[0]}', {sentence}, CASE WHEN {K} % 3 = 0 THEN concat(' And: ', {sentence}) ELSE '' END, '{FILLER[1]}')"
    facts = "concat(" + ", ';', ".join(f"'{f}=', {e}" for f, e in parts if f) + ")"
    n = sum(1 for f, _ in parts if f)
    sql = f"""SELECT {K} AS id, CAST(unnest(range(CASE WHEN {K} % 3 = 0 THEN 2 ELSE 1 END)) AS INT) AS ordinal, {facts} AS facts, CAST({n} AS BIGINT) AS n, CAST({n} AS BIGINT) AS true_places FROM orders"""
    fields = [f for f, _ in parts if f]

    def run(spark, d):
        releases = table(spark, d, "orders").select(F.col(K).alias("id"), F.expr(twice.replace("\n", "\\n")).alias("body"))
        found = extracted(releases, READERS[name], "id", "body", keep=("body",))
        placed = found.withColumn("there", F.substring("body", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")))
        pair = F.concat(F.col("field"), F.lit("="), F.col("there"))
        place = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
        right = (F.col("there") == F.col("value_text")) | F.col("value_num").isNotNull()
        records = placed.groupBy("id", "ordinal").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), pair.alias("t")))).alias("x"), F.count("*").alias("n"), F.count_if(right).alias("true_places"))
        return records.select("id", "ordinal", F.array_join(F.transform("x", lambda v: v.t), ";").alias("facts"), "n", "true_places")

    run.__doc__ = f"Records of the reader {name}: each field as it stands at its place in the text."
    query(f"rd_{name}", sql)(run)


for _name in TEMPLATES:
    _register(_name)


@query("rd_values", f"""
SELECT {K} AS id, CAST({K} % 90 + 1 + ({K} % 10) / 10.0 AS DOUBLE) * 1e6 AS amount, {one_of(C, 'USD', 'CAD', 'AUD')} AS currency, CAST(round(({K} % 90 + 10)) AS BIGINT) AS price_cents, CAST(({K} % 900 + 1) * 1000 + {C} % 900 + 100 AS DOUBLE) AS units FROM orders""")
def rd_values(spark, d):
    """Numbers and money of one reader as values, pivoted to a row per release."""
    sentence = f"concat({', '.join(e for _, e in _parts(TEMPLATES['financings']))})"
    facts = extracted(table(spark, d, "orders").select(F.col(K).alias("id"), F.expr(sentence).alias("body")), READERS["financings"], "id", "body")
    value = lambda f, c="value_num": F.max(F.when(F.col("field") == f, F.col(c)))
    wide = facts.groupBy("id").agg(value("amount").alias("amount"), value("amount", "unit").alias("currency"), value("price").alias("price"), value("units").alias("units"))
    return wide.select("id", "amount", "currency", F.round(F.col("price") * 100).cast("bigint").alias("price_cents"), "units")


@query("rd_silence", f"""
SELECT 'drill_results' AS extractor, count(*) AS runs, count(*) FILTER (WHERE {K} % 4 <> 0) AS silent FROM orders""")
def rd_silence(spark, d):
    """Runs without records are kept: a release that says nothing isn't read again."""
    sentence = f"CASE WHEN {K} % 4 = 0 THEN concat({', '.join(e for _, e in _parts(TEMPLATES['drill_results']))}) ELSE 'Nothing was drilled.' END"
    releases = table(spark, d, "orders").select(F.col(K).alias("id"), F.expr(sentence).alias("body"))
    spoken = extracted(releases, READERS["drill_results"], "id", "body").groupBy("id").agg(F.count("*").alias("n"))
    runs = releases.select("id").join(spoken, "id", "left")
    return runs.agg(F.lit("drill_results").alias("extractor"), F.count("*").alias("runs"), F.count_if(F.col("n").isNull()).alias("silent"))
