"""Deals read over several sentences: typed tokens, a small chart grammar with slots for each sentence, and folding of what they say.

A token is a piece of text of one type (a sum of money, a count, a kind of security, a step, a part). The grammar puts
neighbouring tokens of a sentence together, bottom up in a chart: what a phrase says are slots, and two pieces join only if
they don't contradict each other. The phrases that read most become statements. Statements of a text are folded into deals: one that
contradicts all deals so far begins a new one, one that names a part of a deal adds it. Texts are read one by one in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.measures import MARKS, MONEY, SCALES, WRITTEN_OUT

KINDS = {"flow-through shares": "flow-through", "flow-through units": "flow-through", "common shares": "shares", "shares": "shares", "share": "shares", "units": "units", "unit": "units", "convertible debentures": "notes", "debentures": "notes", "notes": "notes", "note": "notes", "warrants": "warrants", "warrant": "warrants"}
STEPS = {"announce": "announced", "arrange": "announced", "propose": "announced", "close": "closed", "complete": "closed", "upsize": "upsized", "increase": "upsized", "cancel": "cancelled", "terminate": "cancelled"}
PARTS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "final": 0}
_STEP = "|".join(f"{s[:-1] if s.endswith('e') else s}(?:e|es|ed|s|ing|led)?" for s in STEPS)
_KIND = "|".join(sorted(KINDS, key=len, reverse=True))
TOKENS = re.compile(
    rf"(?P<END>[.!?](?=\s|$)|\n\s*\n)|(?P<MONEY>{re.sub(r'[(](?![?])', '(?:', MONEY)})|(?P<COUNT>\d[\d,]*(?:\.\d+)?(?: million)?(?=\s+(?:{_KIND})\b))|(?P<KIND>\b(?i:{_KIND})\b)"
    rf"|(?P<PART>\b(?i:{'|'.join(PARTS)})\s+(?:tranche|closing)\b)|(?P<STEP>\b(?i:{_STEP})\b)|(?P<TOTAL>\b(?i:proceeds|aggregate|total)\b)|(?P<AT>\b(?:at|price)\b)|(?P<PER>\bper\b)"
)
_AMOUNT = re.compile(MONEY)
#: How phrases are put together. A phrase says all that its pieces say; SLOTS gives what a token's value is called in a phrase.
GRAMMAR = {
    "PRICE": [("AT", "MONEY", "PER", "KIND"), ("MONEY", "PER", "KIND"), ("AT", "MONEY"), ("AT", "PRICE")],
    "SIZE": [("COUNT", "KIND")],
    "SUM": [("TOTAL", "MONEY"), ("TOTAL", "SUM"), ("MONEY",)],
    "DEAL": [
        ("SIZE", "PRICE"), ("SUM", "SIZE"), ("SIZE", "SUM"), ("PRICE", "SUM"), ("SUM", "PRICE"), ("SIZE",), ("SUM",), ("PRICE",), ("STEP", "DEAL"), ("PART", "DEAL"), ("DEAL", "PART"), ("DEAL", "SUM"), ("DEAL", "PRICE"), ("STEP", "PART"), ("STEP", "KIND"), ("DEAL", "STEP"), ("STEP",),
    ],
}
SLOTS = {("PRICE", "MONEY"): "price", ("SUM", "MONEY"): "total", ("SIZE", "COUNT"): "count"}
#: Tokens of the longest phrase: a sentence of any length is read in time in proportion to it.
LONGEST = 12
DEAL = "deal int, step string, kind string, count double, price double, currency string, total double, derived boolean, parts array<struct<part: int, total: double>>, span_start int, span_end int"


def _value(kind: str, text: str):
    if kind == "MONEY":
        mark, number, word = _AMOUNT.match(text).groups()
        figure, scale = float(re.sub("[, ]", "", number)), SCALES.get((word or "").lower(), 1.0)
        return figure * (1.0 if figure >= WRITTEN_OUT and scale >= 1e6 else scale), MARKS[re.sub(r"\s", "", mark)]
    if kind == "COUNT":
        return float(text.removesuffix(" million").replace(",", "")) * (1e6 if text.endswith(" million") else 1)
    if kind == "KIND":
        return KINDS[text.lower()]
    if kind == "PART":
        return PARTS[text.split()[0].lower()]
    if kind == "STEP":
        return next(s for stem, s in STEPS.items() if text.lower().startswith(stem[:-1]))
    return None


def sentences(text: str) -> Iterator[list[tuple]]:
    """Tokens (type, value, start, end) of each sentence."""
    held = []
    for m in TOKENS.finditer(text):
        if m.lastgroup == "END":
            yield held
            held = []
        else:
            held.append((m.lastgroup, _value(m.lastgroup, m.group()), m.start(), m.end()))
    yield held


def joined(a: dict | None, b: dict | None) -> dict | None:
    """What two pieces say together; None if they contradict each other."""
    if a is None or b is None or any(k in a and a[k] != v for k, v in b.items()):
        return None
    return {**a, **b}


def _said(category: str, token: tuple) -> dict:
    kind, value = token[:2]
    if kind == "MONEY":
        slot = SLOTS.get((category, kind), "total")
        return {slot: value[0]} | ({"currency": value[1]} if value[1] else {})
    return {SLOTS.get((category, kind), kind.lower()): value} if value is not None else {}


def chart(tokens: list[tuple]) -> dict[tuple[int, int], dict[str, dict]]:
    """For each stretch of tokens the phrases it can be, with what they say: of two readings that which says more, the first of equals."""
    found: dict[tuple[int, int], dict[str, dict]] = {}

    def pieces(category: str, symbols: tuple, i: int, j: int) -> Iterator[dict]:
        head, rest = symbols[0], symbols[1:]
        for k in range(i + 1, j + 1 - len(rest)) if rest else (j,):
            if head in GRAMMAR:
                first = found.get((i, k), {}).get(head)
            else:
                first = _said(category, tokens[i]) if k == i + 1 and tokens[i][0] == head else None
            if first is not None:
                for more in pieces(category, rest, k, j) if rest else ({},):
                    both = joined(first, more)
                    if both is not None:
                        yield both

    for size in range(1, min(len(tokens), LONGEST) + 1):
        for i in range(len(tokens) - size + 1):
            here = found.setdefault((i, i + size), {})
            for category, ways in GRAMMAR.items():
                for symbols in ways:
                    for said in pieces(category, symbols, i, i + size):
                        if len(said) > len(here.get(category, {})):
                            here[category] = said
    return found


@lru_cache(maxsize=1 << 14)
def _ways(shape: tuple) -> list[tuple[dict, int, int]]:
    """(slots, first token, token after the last): phrases of a sentence that don't overlap and say most together, the fewest of equals."""
    tokens = [(kind, value, i, i + 1) for i, (kind, value) in enumerate(shape)]
    found = chart(tokens)
    best: list[tuple[int, int, tuple]] = [(0, 0, ())]
    for j in range(1, len(tokens) + 1):
        choice = best[j - 1]
        for i in range(max(0, j - LONGEST), j):
            said = found.get((i, j), {}).get("DEAL")
            if said:
                n, few, ways = best[i]
                choice = max(choice, (n + len(said), few - 1, (*ways, (i, j))), key=lambda c: c[:2])
        best.append(choice)
    return [(found[i, j]["DEAL"], i, j) for i, j in best[-1][2]]


def statements(tokens: list[tuple]) -> list[tuple[dict, int, int]]:
    """(slots, start, end) of a sentence's phrases. How they are put together depends on the types of the tokens and on which values are
    equal, not on the values; sentences that agree in these are put together once in a task."""
    names: dict = {}
    values: dict = {}

    def name(kind: str, value):
        if value is None:
            return None
        short = names.setdefault((kind, value), (kind, len(names)))
        values[short] = value
        return short

    shape = tuple((kind, (name("figure", value[0]), name("currency", value[1])) if kind == "MONEY" else name(kind, value)) for kind, value, _, _ in tokens)
    return [({slot: values[short] for slot, short in said.items()}, tokens[i][2], tokens[j - 1][3]) for said, i, j in _ways(shape)]


@dataclass
class Deal:
    slots: dict
    start: int
    end: int
    parts: list[tuple[int, float | None]] = field(default_factory=list)

    def agrees(self, said: dict) -> bool:
        """No other step, kind, count, price, currency or total than this deal's."""
        return joined(self.slots, {k: v for k, v in said.items() if k != "part"}) is not None and self._adds_up({**self.slots, **said})

    @staticmethod
    def _adds_up(slots: dict) -> bool:
        if not {"count", "price", "total"} <= slots.keys():
            return True
        return abs(slots["count"] * slots["price"] - slots["total"]) <= 0.01 * slots["total"]

    def add(self, said: dict, start: int, end: int) -> None:
        self.start, self.end = min(self.start, start), max(self.end, end)
        if "part" in said:
            self.parts.append((said["part"], said.get("total")))
            said = {k: v for k, v in said.items() if k not in ("part", "total", "count")}
        self.slots |= said


def deals_of(text: str) -> list[Deal]:
    """Deals of a text in its order. A statement joins the last deal that it agrees with; steps alone join or wait for a figure."""
    deals: list[Deal] = []
    for tokens in sentences(text):
        for said, start, end in statements(tokens):
            whole = {k: v for k, v in said.items() if k not in ("total", "count") or "part" not in said}
            fits = next((d for d in reversed(deals) if d.agrees(whole)), None)
            if fits is None:
                deals.append(fits := Deal({}, start, end))
            fits.add(said, start, end)
    return [d for d in deals if {"count", "price", "total"} & d.slots.keys() or d.parts]


def deals_in(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, deal from 1, step, kind, count, price, currency, total, derived, parts, span_start, span_end) of each deal.

    A total that isn't said is count times price, and derived. Parts are (number, total), 0 for the final one. Null texts have no deals;
    repeated rows and null ids stay as they come.
    """
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    id_kind = rows.schema["id"].dataType.simpleString()
    part = pa.struct([("part", pa.int32()), ("total", pa.float64())])
    kinds = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(part), pa.int32(), pa.int32()]
    names = ["id", "deal", "step", "kind", "count", "price", "currency", "total", "derived", "parts", "span_start", "span_end"]

    def record(number: int, d: Deal) -> tuple:
        s = d.slots
        derived = "total" not in s and {"count", "price"} <= s.keys()
        total = round(s["count"] * s["price"], 2) if derived else s.get("total")
        return (number, s.get("step"), s.get("kind"), s.get("count"), s.get("price"), s.get("currency"), total, derived, [{"part": p, "total": t} for p, t in d.parts], d.start, d.end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for number, d in enumerate(deals_of(text), 1):
                    place.append(k)
                    found.append(record(number, d))
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    # one file may be one task: texts are dealt before they are read
    return rows.repartition("id", "t").mapInArrow(run, f"id {id_kind}, {DEAL}").withColumnRenamed("id", id_col)
