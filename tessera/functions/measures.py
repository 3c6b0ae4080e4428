"""Metals, grades, quantities and money as expressions. Nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import GRADE_PPM, converted

#: What a metal is called besides its symbol, and whether others are given as its equivalent.
METALS = {
    "Au": (("gold",), True), "Ag": (("silver",), True), "Cu": (("copper", "total copper", "TCu"), True), "Ni": (("nickel",), True), "Zn": (("zinc",), True), "Pb": (("lead",), True),
    "Sn": (("tin",), True), "Pt": (("platinum",), True), "Pd": (("palladium",), True), "Mo": (("molybdenum",), True), "W": (("tungsten",), True), "U3O8": ((), True), "Li2O": (("lithium oxide",), True),
    "Co": (("cobalt",), False), "Sb": (("antimony",), False), "Rh": (("rhodium",), False), "Cg": (("graphite",), False), "Mn": (("manganese",), False), "Li": (("lithium",), False), "V": (("vanadium",), False),
    "U": (("uranium",), False), "WO3": (("tungsten trioxide",), False), "V2O5": ((), False), "TREO": (("total rare earth oxides",), False), "PGE": ((), False), "3E": ((), False), "LCE": (("lithium carbonate equivalent",), False),
}
EQUIVALENT_ENDS = ("eq", "equiv", "equivalent")
#: Families of symbols that stand for one metal.
FAMILIES = {"U3O8": "U", "Li2O": "Li", "LCE": "Li", "WO3": "W", "V2O5": "V", "TREO": "REE", "PGE": "PGE", "3E": "PGE", "Pt": "PGE", "Pd": "PGE", "Rh": "PGE", "Cg": "C"}
PRECIOUS = ("AU", "AG", "PT", "PD", "RH")
#: Spellings of grade units; metres, tonnes, ounces and pounds for one of a unit; grams of a troy ounce; pounds of a tonne.
GRADE_UNITS = {"g/t": "g/t", "gpt": "g/t", "g/tonne": "g/t", "grams per tonne": "g/t", "%": "%", "percent": "%", "pct": "%", "ppm": "ppm", "ppb": "ppb", "oz/t": "oz/t", "opt": "oz/t", "oz/ton": "oz/t", "kg/t": "kg/t"}
METRES = {"m": 1.0, "metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048}
TONNES = {"t": 1.0, "tonne": 1.0, "tonnes": 1.0, "kt": 1e3, "thousand tonnes": 1e3, "mt": 1e6, "million tonnes": 1e6, "bt": 1e9, "billion tonnes": 1e9, "short ton": 0.90718474, "short tons": 0.90718474}
OUNCES = {"oz": 1.0, "ounce": 1.0, "ounces": 1.0, "koz": 1e3, "thousand ounces": 1e3, "moz": 1e6, "million ounces": 1e6}
POUNDS = {"lb": 1.0, "lbs": 1.0, "pound": 1.0, "pounds": 1.0, "mlb": 1e6, "million pounds": 1e6, "blb": 1e9, "billion pounds": 1e9}
TROY_OUNCE_G, POUNDS_A_TONNE = 31.1035, 2204.62
OUNCE_METALS = ("Au", "Ag", "AuEq", "AgEq", "Pt", "Pd", "PGE", "3E")
POUND_METALS = ("Cu", "Ni", "Zn", "Pb", "CuEq", "NiEq", "ZnEq", "U3O8", "Mo", "Co")
#: Largest grades that can be meant, by unit, and by metal and unit where that says more.
LIMITS = {
    "%": 100.0, "g/t": 20000.0, "ppm": 100000.0, "ppb": 1000000.0, "oz/t": 600.0, "kg/t": 50.0, "Ag g/t": 100000.0, "AgEq g/t": 100000.0, "Ag oz/t": 3000.0, "AgEq oz/t": 3000.0,
    "Au %": 5.0, "Ag %": 20.0, "Pt %": 5.0, "Pd %": 5.0, "U %": 30.0,
}
#: What one of a currency is worth for ranking only.
RANK_RATES = {"CAD": 1.0, "USD": 1.38, "AUD": 0.90, "GBP": 1.85, "EUR": 1.60}


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looked_up(key: Column, table: dict) -> Column:
    """Value of a literal table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _key(word: str) -> str:
    return re.sub("[^a-z0-9]", "", word.lower())


#: Letters and digits of each way to write a metal or an equivalent, and its symbol.
SPELLED = {_key(w): symbol for symbol, (names, _) in METALS.items() for w in (symbol, *names)}
SPELLED |= {_key(w) + end: f"{symbol}Eq" for symbol, (names, is_base) in METALS.items() if is_base for w in (symbol, *names) for end in EQUIVALENT_ENDS}


def metals(token: Column) -> Column:
    """Symbols that a token names ("Au+Ag", "copper-gold"); empty where one of its parts is no metal."""
    parts = F.split(F.coalesce(token, F.lit("")), r"(?i)[+/&,]|\band\b|-(?!\s*eq)")
    symbols = F.transform(parts, lambda w: looked_up(F.regexp_replace(F.lower(w), "[^a-z0-9]", ""), SPELLED))
    return let(symbols, lambda x: F.when(F.array_contains(F.transform(x, lambda m: m.isNull()), True), F.array().cast("array<string>")).otherwise(x))


def family(symbol: Column) -> Column:
    """One name for a metal, its compounds and its equivalents; of a sum the first part counts."""
    first = F.regexp_replace(F.split_part(symbol, F.lit("+"), F.lit(1)), "Eq$", "")
    return F.coalesce(looked_up(first, FAMILIES), first)


def ranking_family(metal: Column) -> Column:
    """For rankings a sum is a family of its own: AuEq is AU, Zn+Pb is ZN+PB."""
    plain = F.regexp_replace(F.upper(F.coalesce(metal, F.lit(""))), r"\s|EQ(?=\s*(?:\+|$))", "")
    return F.regexp_replace(plain, r"^\++|\++$|(?<=\+)\++", "")


def is_precious(metal: Column) -> Column:
    """Whether a metal, or every metal of a sum, is precious."""
    one = "|".join(PRECIOUS)
    return ranking_family(metal).rlike(rf"^(?:{one})(?:\+(?:{one}))*$")


def grade_unit(token: Column) -> Column:
    return looked_up(F.regexp_replace(F.lower(F.trim(token)), r"\s+", " "), GRADE_UNITS)


def grade_ppm(grade: Column, unit: Column) -> Column:
    return converted(grade, unit, GRADE_PPM)


def plausible_grade(grade: Column, unit: Column, metal: Column) -> Column:
    """Whether an intercept's grade can be what it says: above zero and within the limit of its metal and unit."""
    leading = F.regexp_extract(F.coalesce(metal, F.lit("")), r"^[^+]*", 0)
    limit = F.coalesce(looked_up(F.concat_ws(" ", leading, unit), LIMITS), looked_up(unit, LIMITS), F.lit(float("inf")))
    return F.coalesce((grade > 0) & (grade <= limit), F.lit(False))


def quantity(value: Column, unit: Column, table: dict[str, float]) -> Column:
    """value in the base unit of METRES, TONNES, OUNCES or POUNDS; null for unknown units."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(unit)), r"\s+", " "), "^(metric|troy) ", "")
    return converted(value, plain, table)


def contained(tonnage: Column, grade: Column, unit: Column, metal: Column) -> Column:
    """struct (t, oz, lb) of metal in a tonnage; ounces and pounds only for metals given in them."""
    t = F.when(tonnage != 0, tonnage * grade_ppm(grade, unit) / 1e6)
    return F.struct(t.alias("t"), F.when(metal.isin(*OUNCE_METALS), t * 1e6 / TROY_OUNCE_G).alias("oz"), F.when(metal.isin(*POUND_METALS), t * POUNDS_A_TONNE).alias("lb"))


def interval_value(grade: Column, unit: Column, metal: Column, metres: Column) -> Column:
    """grade x length as gram metres of precious metals, as per cent metres of others; null for precious metals in per cent and for
    more than all of the rock."""
    parts = grade_ppm(grade, unit)
    shown = F.when(is_precious(metal), F.when(unit != "%", parts)).otherwise(parts / 10000.0)
    return F.when((unit != "%") | (grade <= 100), F.round(shown * metres, 6))


def threshold_family(grade: Column, unit: Column, metal: Column, metres: Column) -> Column:
    """struct (family, value): which table of thresholds an intercept goes by, and its grade x length."""
    low, u = F.lower(metal), F.lower(unit)
    u = F.when((u == "ppm") & low.rlike("^(au|ag)"), "g/t").otherwise(u)
    name = F.when(u.isin("g/t", "gpt"), F.when(low.startswith("au"), "au_gm").when(low.startswith("ag"), "ag_gm").otherwise("other_gt"))
    name = F.coalesce(name, F.when((u == "%") & low.startswith("cu"), "cu_pm").when(u == "%", "other_pct").otherwise("other"))
    known = grade.isNotNull() & metres.isNotNull()
    return F.struct(F.when(known, name).alias("family"), F.when(known, grade * metres).alias("value"))


def ranked_cad(value: Column, currency: Column) -> Column:
    return value * F.coalesce(looked_up(F.upper(currency), RANK_RATES), F.lit(1.0))


#: Marks of currencies (a bare dollar tells none), and words for powers of ten.
MARKS = {
    "US$": "USD", "U.S.$": "USD", "USD": "USD", "C$": "CAD", "CA$": "CAD", "CAD$": "CAD", "CDN$": "CAD", "CAD": "CAD", "CDN": "CAD", "A$": "AUD", "AU$": "AUD", "AUD": "AUD", "AUD$": "AUD",
    "NZ$": "NZD", "HK$": "HKD", "£": "GBP", "€": "EUR", "$": None,
}
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "mln": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9}


def _any_of(words, written=re.escape) -> str:
    """Alternatives of a pattern, longest first."""
    return "|".join(written(w) for w in sorted(words, key=len, reverse=True))


def _mark(mark: str) -> str:
    """A mark with room before its dollar; codes without one need room and a figure after them, letters none before."""
    written = re.escape(mark).replace(r"\$", r"\s?\$") if len(mark) > 1 else re.escape(mark)
    return (r"(?<![A-Za-z])" if mark[0].isalpha() else "") + written + (r"(?=\s\d)" if mark.isalpha() else "")


_NUMBER = r"\d+(?:, ?\d{3}(?!\d))*(?:\.\d+)?"
_PARTS = (_any_of(MARKS, _mark), _NUMBER, rf"(?i:{_any_of(SCALES)})")
MONEY = r"({})\s?({})(?:[\s-]*({})\b)?".format(*_PARTS)
#: The same without groups, to be a part of other patterns.
MONEY_TEXT = r"(?:{})\s?(?:{})(?:[\s-]*(?:{})\b)?".format(*_PARTS)
#: Figures from which on a word for a million or more is a slip.
WRITTEN_OUT = 100_000


#: Stands for a find where only the text around it counts.
_MARK = "\x00"
#: Letters up to which a text is short.
_SHORT = 2000


def spans(text: Column, pattern: str) -> Column:
    """array<struct<found, start, end>>: all finds of a pattern in text order with their true places, from 0.

    Places add up the text between the finds and the finds themselves, so a find that stands twice has two places. Finds are marked
    before a short text is split, since a split by a pattern compiles it anew for each row; long texts, where that is little, and
    texts that hold the mark are split by the pattern.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.when(text.contains(_MARK) | (F.length(text) > _SHORT), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1))

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + F.length(x.gap)
        end = start + F.length(x.found)
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(x.found.alias("found"), start.alias("start"), end.alias("end")))).alias("out"))

    def placed(finds: Column, gaps: Column) -> Column:
        pairs = F.transform(finds, lambda x, i: F.struct(x.alias("found"), F.get(gaps, i).alias("gap")))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<found: string, start: int, end: int>>").alias("out"))
        return F.aggregate(pairs, nothing, step, lambda acc: acc.out)

    return F.get(F.transform(F.array(F.struct(found.alias("f"), between.alias("b"))), lambda x: placed(x.f, x.b)), F.lit(0))


def _amount(found: Column) -> tuple[Column, Column]:
    """Value and currency of the first amount of a text."""
    mark, number, word = (F.regexp_extract(found, MONEY, k) for k in (1, 2, 3))
    figure = F.translate(number, ", ", "").try_cast("double")
    scale = F.coalesce(looked_up(F.lower(word), SCALES), F.lit(1.0))
    scale = F.when((figure >= WRITTEN_OUT) & (scale >= 1e6), 1.0).otherwise(scale)
    return figure * scale, looked_up(F.regexp_replace(mark, r"\s", ""), MARKS)


def money(text: Column) -> Column:
    """array<struct<value, currency, start, end>>: amounts with a currency mark.

    Blanks after commas are repaired; "2,000,000 million" is a slip and stays two millions.
    """

    def read(x: Column) -> Column:
        value, currency = _amount(x.found)
        return F.struct(value.alias("value"), currency.alias("currency"), x.start.alias("start"), x.end.alias("end"))

    return F.transform(spans(text, MONEY), read)


def first_money(text: Column) -> Column:
    """struct<value, currency>: the first amount of a text, without its place; nulls without one."""
    value, currency = _amount(text)
    return F.struct(value.alias("value"), currency.alias("currency"))


#: Numbers in words.
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "hundred": 100}
_COUNT = rf"(?<![\d.,:])(\d+(?:\.\d+)?|\b(?:{_any_of(NUMBER_WORDS)})\b)"
#: Two numbers of shares that stand for each other: "10:1", "one-for-ten", "1 new share for every 10 old shares".
EXCHANGED = rf"(?i){_COUNT}(?:\s*:\s*|(?:[\s-]+(?:\([^)]*\)|[a-z]+)){{0,16}}?[\s-]+(?:for|to|into|per)[\s-]+(?:(?:each|every)[\s-]+)?)(\d+(?:\.\d+)?|\b(?:{_any_of(NUMBER_WORDS)})\b)(?![\d:]|[.,]\d)"


def consolidation(text: Column) -> Column:
    """The first two numbers of shares that stand for each other, one of them 1, as a ratio n:1; null if none or n is beyond 1000."""

    def number(found: Column) -> Column:
        return F.coalesce(looked_up(F.lower(found), {w: float(n) for w, n in NUMBER_WORDS.items()}), found.try_cast("double"))

    pairs = F.transform(F.regexp_extract_all(text, F.lit(EXCHANGED), F.lit(0)), lambda x: F.array_sort(F.array(*[number(F.regexp_extract(x, EXCHANGED, k)) for k in (1, 2)])))
    fit = F.filter(pairs, lambda p: (F.get(p, F.lit(0)) == 1) & (F.get(p, F.lit(1)) > 1) & (F.get(p, F.lit(1)) <= 1000))
    return let(F.get(F.get(fit, F.lit(0)), F.lit(1)), lambda n: F.concat(F.regexp_replace(n.cast("string"), r"\.0$", ""), F.lit(":1")))
