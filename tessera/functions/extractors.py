"""Readers of releases: sentences into records of facts with true places.

A reader is one or more sentence forms; a form is a list of pieces, some of them fields. All pieces together are one regular
expression, so a form finds all its records in a text; a field's place follows from the pieces before it. Everything is
built-in expressions: a text is scanned where it is read, and no reader calls another language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.measures import MONEY_TEXT, first_money, let, spans
from tessera.functions.values import lenient_date, parsed_number

NUMBER = r"\d[\d,]*(?:\.\d+)?"
NAME = r"[A-Z][A-Za-z0-9'-]*(?: [A-Z][A-Za-z0-9'-]*){0,4}"
MONEY = MONEY_TEXT
DATE = r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2}"
PERIOD = r"(?:Q[1-4]|H[12]|9M|FY) \d{4}"
METAL = r"(?i:gold|silver|copper|zinc|lead|nickel|uranium|lithium)|AuEq|Au|Ag|Cu|Zn|Pb|Ni|U3O8"
GRADE = r"g/t|%|ppm|ppb|oz/t|kg/t"


@dataclass(frozen=True)
class Piece:
    pattern: str
    field: str = ""
    kind: str = "text"  # text, number, money or date


def word(pattern: str) -> Piece:
    return Piece(pattern)


def part(field: str, pattern: str, kind: str = "text") -> Piece:
    return Piece(pattern, field, kind)


@dataclass(frozen=True)
class Extractor:
    name: str
    version: str
    tag: str
    forms: tuple[tuple[Piece, ...], ...]


def _cut(form: tuple[Piece, ...], found: Column) -> Column:
    """array<string>: what each piece of a form takes of a record, in order."""
    whole = "^" + "".join(f"({p.pattern})" for p in form) + "$"
    return F.array(*[F.regexp_extract(found, whole, i + 1) for i in range(len(form))])


def _fields(form: tuple[Piece, ...], r: Column) -> Column:
    """array<struct<field, kind, text, first>>: the fields of one record, with their places."""

    def of(texts: Column, i: int) -> Column:
        ahead = F.length(F.array_join(F.slice(texts, 1, i), ""))
        return F.struct(F.lit(form[i].field).alias("field"), F.lit(form[i].kind).alias("kind"), F.get(texts, F.lit(i)).alias("text"), (r.start + ahead).alias("first"))

    return let(_cut(form, r.found), lambda texts: F.array(*[of(texts, i) for i, piece in enumerate(form) if piece.field]))


def records(text: Column, reader: Extractor) -> Column:
    """array<struct<start, form, found>>: the records of a text in its order; form counts the reader's forms from 0."""

    def of(i: int, form: tuple[Piece, ...]) -> Column:
        whole = "".join(f"(?:{p.pattern})" for p in form)
        return F.transform(spans(text, whole), lambda x: F.struct(x.start.alias("start"), F.lit(i).alias("form"), x.found.alias("found")))

    found = [of(i, form) for i, form in enumerate(reader.forms)]
    return F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]


def extracted(events: DataFrame, reader: Extractor, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The facts of a reader: id, extractor, version, ordinal, field, value_num, value_text, unit, span_start, span_end, and the
    columns of the events that ``keep`` names (the text itself, say, which then needs no join).

    Texts without a record give no rows; a run ledger takes note of those (measured silence) by an anti-join. Records, fields and
    values are three steps over rows: a kind of value is one expression, however many fields and forms have it.
    """
    found = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: records(t, reader))  # the text is evaluated once
    each = events.select(id_col, *keep, F.posexplode(found).alias("ordinal", "r"))
    fields = F.array().cast("array<struct<field: string, kind: string, text: string, first: int>>")
    for i, form in enumerate(reader.forms):
        fields = F.when(F.col("r.form") == i, _fields(form, F.col("r"))).otherwise(fields)
    cut = each.select(id_col, *keep, "ordinal", F.explode(fields).alias("x")).filter(F.length("x.text") > 0)
    kind, text, start = F.col("x.kind"), F.col("x.text"), F.col("x.first")
    read = cut.withColumn("amount", F.when(kind == "money", first_money(text)))
    number = F.when(kind == "number", parsed_number(text)).otherwise(F.col("amount.value"))
    shown = F.when(kind == "date", F.date_format(lenient_date(text), "yyyy-MM-dd")).otherwise(text)
    place = start.alias("span_start"), (start + F.length(text)).alias("span_end")
    return read.select(id_col, F.lit(reader.name).alias("extractor"), F.lit(reader.version).alias("version"), "ordinal", "x.field", number.alias("value_num"), shown.alias("value_text"), F.col("amount.currency").alias("unit"), *place, *keep)


READERS = {
    r.name: r
    for r in (
        Extractor("drill_results", "1.0.0", "Drill Results", (
            (word("(?i:hole) "), part("hole", r"[A-Z]{1,5}-?\d+[A-Z0-9-]*"), word(" (?:intersected|returned|cut) "), part("length", NUMBER, "number"), word(r" ?(?:m|metres|meters) (?:of|grading|at|averaging) "), part("grade", NUMBER, "number"), word(" ?"), part("unit", GRADE), word(" "), part("metal", METAL), word("(?: from )?"), part("from", f"(?<= from ){NUMBER}|", "number"), word("(?: ?m(?:etres)?)?")),
        )),
        Extractor("financings", "1.0.0", "Financings", (
            (part("role", "(?i:announces|closes|upsizes|amends)"), word(r" (?:an? |its )?(?:[a-z-]+ )*?"), part("type", "private placement|bought deal|offering"), word(" of "), part("units", NUMBER, "number"), word(" (?:units|shares) at (?:a price of )?"), part("price", MONEY, "money"), word(" (?:per (?:unit|share) )?for (?:gross )?proceeds of "), part("amount", MONEY, "money")),
        )),
        Extractor("management", "1.0.0", "Management Changes", (
            (part("person", NAME), word(" (?:has been|was) "), part("action", "appointed|named|promoted"), word(" (?:as |to )?"), part("role", r"(?:[A-Z][a-z]+ )*(?:Officer|Director|President|Chair|Secretary)")),
            (part("person", NAME), word(" "), part("action", "resigned|retired|stepped down"), word(" as "), part("role", r"(?:[A-Z][a-z]+ )*(?:Officer|Director|President|Chair|Secretary)")),
        )),
        Extractor("resources", "1.0.0", "Resource Estimates", (
            (part("category", "(?i:measured and indicated|measured|indicated|inferred)"), word(" (?:mineral )?resources? of "), part("tonnes", NUMBER, "number"), word(" "), part("tonnes_unit", "Mt|kt|million tonnes|tonnes"), word(" (?:grading|at|averaging) "), part("grade", NUMBER, "number"), word(" ?"), part("unit", GRADE), word(" "), part("metal", METAL), word("(?: for| containing) "), part("contained", NUMBER, "number"), word(" "), part("contained_unit", "ounces|oz|Moz|pounds|lb|tonnes")),
        )),
        Extractor("economics", "1.0.0", "Economic Studies", (
            (part("scenario", "(?i:base|spot|upside) case"), word(" (?:has an )?"), part("basis", "after-tax|pre-tax"), word(r" NPV ?\(?"), part("discount", f"{NUMBER}(?=%)", "number"), word(r"%\)? of "), part("npv", MONEY, "money"), word(" and (?:an )?IRR of "), part("irr", NUMBER, "number"), word("%")),
        )),
        Extractor("production", "1.0.0", "Production Results", (
            (word("(?i:produced) "), part("quantity", NUMBER, "number"), word(" "), part("unit", "ounces|oz|pounds|lb|tonnes"), word(" of "), part("metal", METAL), word(" in "), part("period", PERIOD)),
        )),
        Extractor("royalties", "1.0.0", "Royalties & Streams", (
            (part("action", "acquires|sells|grants|buys back"), word(" an? "), part("rate", NUMBER, "number"), word("% "), part("kind", "net smelter return royalty|NSR|gross royalty|stream"), word(" (?:on|over) (?:the )?"), part("project", NAME), word(" (?:Project |Mine )?for "), part("price", MONEY, "money")),
        )),
        Extractor("exploration", "1.0.0", "Exploration Programs", (
            (part("status", "(?i:begins|completes|plans)"), word(" an? "), part("metres", NUMBER, "number"), word("[ -]met(?:re|er)s? "), part("work", "diamond drilling|RC drilling|trenching|drilling"), word(" program(?:me)? at (?:the )?"), part("project", NAME)),
        )),
        Extractor("technical", "1.0.0", "Technical Reports", (
            (part("status", "(?i:files|will file|amends)"), word(" an? (?:independent )?"), part("standard", "NI 43-101|JORC"), word(" technical report (?:for|on) (?:the )?"), part("project", NAME), word(" (?:Project )?dated "), part("dated", DATE, "date")),
        )),
        Extractor("permits", "1.0.0", "Permits & Approvals", (
            (part("stage", "(?i:receives|applies for|renews|is refused)"), word(" (?:an?|its|the) "), part("permit", "mining permit|environmental permit|drill permit|water licence"), word(" for (?:the )?"), part("project", NAME), word("(?: Project)?(?: valid until )?"), part("until", f"(?<=until )(?:{DATE})|", "date")),
        )),
        Extractor("options", "1.0.0", "Property Options & Staking", (
            (part("deal", "(?i:options|stakes|acquires)"), word(" (?:up to )?(?:an? )?"), part("interest", f"{NUMBER}(?=%)", "number"), word("%(?: interest)? in (?:the )?"), part("project", NAME), word(" (?:Property )?by paying "), part("cash", MONEY, "money"), word(" and issuing "), part("shares", NUMBER, "number"), word(" shares over "), part("years", NUMBER, "number"), word(" years")),
        )),
        Extractor("debt", "1.0.0", "Debt & Credit Facilities", (
            (part("stage", "(?i:signs|draws|repays|extends)"), word(" (?:an?|its) "), part("amount", MONEY, "money"), word(" "), part("instrument", "credit facility|term loan|convertible debenture|bridge loan"), word(" (?:bearing|at) "), part("rate", NUMBER, "number"), word("%(?: interest)?(?:,)? (?:due|maturing) "), part("matures", DATE, "date")),
        )),
        Extractor("mine_dev", "1.0.0", "Mine Development & Operations", (
            (part("event", "(?i:pours first|starts|suspends|restarts|completes)"), word(" "), part("what", "gold|commercial production|construction|mining operations|commissioning"), word(" at (?:the )?"), part("project", NAME), word(" (?:(?:Mine|Project|Mill) )?on "), part("on", DATE, "date")),
        )),
        Extractor("sampling", "1.0.0", "Sampling & Geoscience", (
            (part("type", "(?i:grab|channel|soil|chip) samples?"), word(" (?:from |at )(?:the )?"), part("project", NAME), word(" (?:Zone |Property )?(?:returned|assayed) up to "), part("grade", NUMBER, "number"), word(" ?"), part("unit", GRADE), word(" "), part("metal", METAL), word(" from "), part("n", NUMBER, "number"), word(" samples")),
        )),
        Extractor("warrant_changes", "1.0.0", "Warrant Changes", (
            (part("change", "(?i:extends|reprices|accelerates)"), word(" "), part("warrants", NUMBER, "number"), word(" warrants (?:exercisable )?(?:from|at) "), part("price", MONEY, "money"), word(" to "), part("until", DATE, "date")),
        )),
        Extractor("calendar", "1.0.0", "Corporate Calendar", (
            (part("kind", "annual meeting|special meeting|conference call|record date|share consolidation"), word(" (?:is |will be held |will take place )?(?:on|for) "), part("on", DATE, "date"), word("(?: at )?"), part("at", r"(?<= at )\d{1,2}:\d{2}|")),
        )),
        Extractor("royalty_terms", "1.0.0", "Royalty Terms", (
            (part("interest", f"{NUMBER}(?=%)", "number"), word("% "), part("kind", "NSR|GOR|NPI|stream"), word(", of which "), part("buyback", f"{NUMBER}(?=%)", "number"), word("% may be bought back for "), part("buyback_price", MONEY, "money"), word(" before "), part("before", DATE, "date")),
        )),
        Extractor("bulletins", "1.0.0", "Exchange Bulletins", (
            (word(r"BULLETIN TYPE: "), part("type", "Halt|Resume Trading|Consolidation|Name Change|New Listing"), word(r"\s+BULLETIN DATE: "), part("date", DATE, "date"), word(r"\s+"), part("issuer", NAME), word(r" \(\"?"), part("symbol", r"[A-Z]{2,5}(?:\.[A-Z])?"), word(r"\"?\)")),
        )),
        Extractor("drill_depths", "1.0.0", "Drill Depths", (
            (part("hole", r"[A-Z]{1,5}-\d+"), word(r"\s*\|\s*"), part("from", NUMBER, "number"), word(r"\s*\|\s*"), part("to", NUMBER, "number"), word(r"\s*\|\s*"), part("length", NUMBER, "number"), word(r"\s*\|\s*"), part("grade", NUMBER, "number")),
        )),
        Extractor("drill_results_old", "0.9.0", "Drill Results", (
            (part("grade", NUMBER, "number"), word(" ?"), part("unit", GRADE), word(" "), part("metal", METAL), word(" over "), part("length", NUMBER, "number"), word(r" ?(?:m|metres|meters)")),
        )),
    )
}
