"""Text to records: small rule readers behind one contract, and a multi-label categoriser.

A reader is a list of rules; a rule is a name, a pattern with one number group, and the unit group or a fixed unit. All rules of all
readers run as built-in regular expressions inside one projection, so no text leaves the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.measures import let, spans
from tessera.functions.values import parsed_number


@dataclass(frozen=True)
class Rule:
    field: str
    pattern: str  # group 1: the number
    unit: str


@dataclass(frozen=True)
class Reader:
    name: str
    version: str
    tag: str
    rules: tuple[Rule, ...]


def read(events: DataFrame, readers: list[Reader], id_col: str, text_col: str) -> DataFrame:
    """Facts: id, extractor, version, ordinal (place of the find within its field), field, value_num, unit, span_start, span_end.

    Every rule reports all its finds in text order with their true places, from 0; numbers that don't parse are left out.
    """

    def finds(text: Column, reader: Reader, rule: Rule) -> Column:
        return F.transform(
            spans(text, rule.pattern),
            lambda x, i: F.struct(
                F.lit(reader.name).alias("extractor"),
                F.lit(reader.version).alias("version"),
                i.alias("ordinal"),
                F.lit(rule.field).alias("field"),
                parsed_number(F.regexp_extract(x.found, rule.pattern, 1)).alias("value_num"),
                F.lit(rule.unit).alias("unit"),
                x.start.alias("span_start"),
                x.end.alias("span_end"),
            ),
        )

    every = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: F.concat(*[finds(t, reader, rule) for reader in readers for rule in reader.rules]))
    return events.select(id_col, F.explode(every).alias("f")).select(id_col, "f.*").where("value_num is not null")


def categories(headline: Column, body: Column, layers: list[tuple[str, str, str]], default: str) -> Column:
    """Tags in layer order. A layer is (tag, pattern, where): where is headline, any, or not (removes the tag if it matches)."""
    added = [F.when(headline.rlike(p) | (body.rlike(p) if where == "any" else F.lit(False)), F.lit(tag)) for tag, p, where in layers if where != "not"]
    removed = [F.when(headline.rlike(p) | body.rlike(p), F.lit(tag)) for tag, p, where in layers if where == "not"]
    kept = F.array_distinct(F.filter(F.array(*added), lambda x: x.isNotNull()))
    if removed:
        kept = F.array_except(kept, F.filter(F.array(*removed), lambda x: x.isNotNull()))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


@dataclass(frozen=True)
class Layers:
    """The layers of a categoriser, applied in this order; every pattern is case-insensitive.

    base: (tag, pattern) on the headline. rescue: (tag, headline pattern, body pattern), for releases without the tag.
    conflicts: (tag held, pattern in headline and lead, tag dropped), in order: a later rule sees what the earlier ones left.
    names: words of names that rules must not read. promotion: a body pattern that overrides all. vocabulary: order of tags.
    """

    base: tuple[tuple[str, str], ...]
    rescue: tuple[tuple[str, str, str], ...]
    conflicts: tuple[tuple[str, str, str], ...]
    names: tuple[str, ...]
    promotion: tuple[str, str]
    vocabulary: tuple[str, ...]
    default: str


LEAD = 600


def masked(headline: Column, names: tuple[str, ...]) -> Column:
    """The headline with names, longest first, replaced by a word that no rule knows."""
    if not names:
        return headline
    either = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(headline, rf"(?i)\b(?:{either})\b", "Xyz")


def base_tags(headline: Column, layers: Layers) -> Column:
    return F.array_compact(F.array(*[F.when(headline.rlike(f"(?i){p}"), F.lit(tag)) for tag, p in layers.base]))


def rescued(tags: Column, headline: Column, body: Column, layers: Layers) -> Column:
    more = [F.when(~F.array_contains(tags, tag) & headline.rlike(f"(?i){h}") & body.rlike(f"(?i){b}"), F.lit(tag)) for tag, h, b in layers.rescue]
    return F.concat(tags, F.array_compact(F.array(*more)))


def settled(tags: Column, headline: Column, body: Column, layers: Layers) -> Column:
    """tags after the conflict rules, one after the other."""
    text = F.concat_ws("\n", headline, F.substring(body, 1, LEAD))
    for held, pattern, dropped in layers.conflicts:
        tags = let(tags, _conflict(text, held, pattern, dropped))
    return tags


def _conflict(text: Column, held: str, pattern: str, dropped: str):
    return lambda t: F.when(F.array_contains(t, held) & F.array_contains(t, dropped) & text.rlike(f"(?i){pattern}"), F.array_remove(t, dropped)).otherwise(t)


def categorize(headline: Column, body: Column, layers: Layers) -> Column:
    """Tags of a release in the vocabulary's order: masks, base, rescue, conflicts, default; promotion overrides all."""

    def whole(h: Column) -> Column:
        return let(base_tags(h, layers), lambda base: let(rescued(base, h, body, layers), lambda more: _in_order(settled(more, h, body, layers), layers)))

    return _promoted(body, let(masked(headline, layers.names), whole), layers)


def _in_order(tags: Column, layers: Layers) -> Column:
    """Tags in the vocabulary's order, the default if there are none."""
    ordered = F.array_intersect(F.array(*[F.lit(t) for t in layers.vocabulary]), tags)
    return let(ordered, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(layers.default))))


def _promoted(body: Column, tags: Column, layers: Layers) -> Column:
    pattern, tag = layers.promotion
    return F.when(body.rlike(f"(?i){pattern}"), F.array(F.lit(tag))).otherwise(tags)


def traced(headline: Column, body: Column, layers: Layers) -> Column:
    """struct (masked, base, rescued, settled, tags): what each layer of ``categorize`` leaves; null texts are empty."""

    def layered(t: Column) -> Column:
        h = masked(t.h, layers.names)

        def order(x: Column) -> Column:
            return F.struct(x.masked, x.base, x.rescued, x.settled, _promoted(t.b, _in_order(x.settled, layers), layers).alias("tags"))

        def settle(x: Column) -> Column:
            return let(F.struct(x.masked, x.base, x.rescued, settled(x.rescued, x.masked, t.b, layers).alias("settled")), order)

        def rescue(x: Column) -> Column:
            return let(F.struct(x.masked, x.base, rescued(x.base, x.masked, t.b, layers).alias("rescued")), settle)

        return let(h, lambda m: let(F.struct(m.alias("masked"), base_tags(m, layers).alias("base")), rescue))

    return let(F.struct(F.coalesce(headline, F.lit("")).alias("h"), F.coalesce(body, F.lit("")).alias("b")), layered)


#: A categoriser of documents of any kind: what a text holds besides prose. Headlines are first lines.
DOCUMENTS = Layers(
    base=(("Figures", r"[0-9]{2,}"), ("Contact Data", r"@|[0-9]{3}-[0-9]{4}"), ("Exclamations", r"!"), ("Symbols", r"[#$%&*]{2,}"), ("Dates", r"(?:19|20)[0-9]{2}")),
    rescue=(
        ("Licensing", r"^", r"licen[cs]e"), ("Secrets", r"^", r"(?:token|password|secret|key) = "), ("Contact Data", r"^", r"[a-z0-9]@[a-z0-9]|[0-9]{3}-[0-9]{4}"), ("Figures", r"[0-9]", r"[0-9]{2,}"),
        ("Symbols", r"[#$%&*]", r"[#$%&*]{3,}"), ("Exclamations", r"^", r"!!"), ("Menus", r"[|>]", r"[|>]"), ("Code", r"^", r"[a-z_]+ = \"|[{};]\n"),
    ),
    conflicts=(("Secrets", r"(?:token|password|secret|key) = ", "Code"), ("Dates", r"(?:19|20)[0-9]{2}", "Figures"), ("Contact Data", r"@", "Figures"), ("Licensing", r"licen[cs]e", "Exclamations"), ("Symbols", r"[#$%&*]{3,}", "Exclamations")),
    names=("A1 Heat", "Letre 2000", "Eron"),
    promotion=(r"[A-Z]{20}", "Shouting"),
    vocabulary=("Licensing", "Secrets", "Contact Data", "Code", "Menus", "Symbols", "Figures", "Dates", "Exclamations"),
    default="Prose",
)
#: The categoriser of the library.
MINING = Layers(
    base=(
        ("Drill Results", r"\b(?:intersects|drills|drilling results|assays)\b"), ("Financings", r"\b(?:private placement|bought deal|financing|offering)\b"), ("Resource Estimates", r"\b(?:resource|reserve) (?:estimate|update)\b"),
        ("Production Results", r"\b(?:produces|production results|quarterly production)\b"), ("Management Changes", r"\b(?:appoints|resigns|names new)\b"), ("Permits & Approvals", r"\bpermit\b"), ("Debt & Credit Facilities", r"\b(?:credit facility|loan|debenture)s?\b"),
    ),
    rescue=(("Management Changes", r"\bupdate\b", r"\b(?:has been|was) appointed\b"), ("Drill Results", r"\bexploration\b", r"\bintersected \d"), ("Financings", r"\bcorporate\b", r"\bgross proceeds of\b")),
    conflicts=(("Debt & Credit Facilities", r"\bconvertible\b", "Financings"), ("Resource Estimates", r"\bdrilling planned\b", "Drill Results"), ("Production Results", r"\bno longer\b", "Production Results"), ("Drill Results", r"\bproceeds will fund\b", "Drill Results")),
    names=("Permit Gold", "Drills Resources", "Production Metals"),
    promotion=(r"\bpaid (?:advertisement|promotion)\b|\bsponsored content\b", "Paid Promotion"),
    vocabulary=("Drill Results", "Financings", "Resource Estimates", "Production Results", "Management Changes", "Permits & Approvals", "Debt & Credit Facilities"),
    default="Corporate Updates",
)


def admitted(found: Column, headline: Column, body: Column, rules: list[tuple[str, bool, str]]) -> Column:
    """struct (admit, reason): whether what a reader found earns its tag. Rules (reason, admit, pattern) in order; the first whose
    pattern the headline and lead hold decides; no find and no rule both refuse."""
    text = F.concat_ws("\n", headline, F.substring(body, 1, LEAD))
    chosen = F.coalesce(F.when(~found, F.struct(F.lit(False).alias("admit"), F.lit("nothing found").alias("reason"))), *[F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(ok).alias("admit"), F.lit(why).alias("reason"))) for why, ok, p in rules])
    return F.coalesce(chosen, F.struct(F.lit(False).alias("admit"), F.lit("no rule").alias("reason")))


#: Suffixes of exchanges.
EXCHANGES = {"TSXV": ".V", "TSX-V": ".V", "TSX": ".TO", "CSE": ".CN", "NYSE": ".US", "NASDAQ": ".US", "ASX": ".AX"}


def tickers_in(text: Column) -> Column:
    """Tickers with the suffix of their exchange, in the order of the text: "(TSXV: ABC)" is ABC.V."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:TSX-V|TSXV|TSX|CSE|NYSE|NASDAQ|ASX)\s?:\s?[A-Z][A-Z0-9.]{0,6})\b"), F.lit(1))
    suffix = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.trim(F.split_part(x, F.lit(":"), F.lit(2))), F.try_element_at(suffix, F.trim(F.split_part(x, F.lit(":"), F.lit(1)))))))
