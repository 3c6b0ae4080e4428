"""Parameterised reads. A listing states which parameters it takes and what each one does; a request is checked against it and
becomes one lazy plan: filters on rows, grouping, filters on groups, an order, a page, and the total of all that matched.

A parameter is either about rows (applied before the listing groups them, so it reaches the scan) or about groups (applied
afterwards, on attributes that only the whole group has). Unknown parameters and values outside a vocabulary raise BadRequest;
page and limit are clamped. An empty value counts as not given.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import listings as L
from tessera.operators import predicates as P
from tessera.operators.aggregates import facets

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


class BadRequest(ValueError):
    """A parameter or value that the listing doesn't take."""


@dataclass(frozen=True)
class Context:
    """What a request may refer to beside the rows: the day it is asked on, named key sets, and listings of all companies."""

    today: dt.date
    universes: Mapping[str, DataFrame] = field(default_factory=dict)
    listings: DataFrame | None = None


@dataclass(frozen=True)
class Param:
    """parse: text -> value, or BadRequest. apply: (rows, value, context) -> rows. groups: applied after grouping."""

    parse: Callable[[str], Any]
    apply: Callable[[DataFrame, Any, Context], DataFrame]
    groups: bool = False
    default: str = ""


@dataclass(frozen=True)
class Sort:
    """A total order. ranked: rows that fail a check are listed after all others."""

    order: tuple[Column, ...]
    ranked: bool = False


@dataclass(frozen=True)
class Listing:
    """rows -> page. ``grouped`` turns rows into the listing's items, ``checks`` annotate them, ``include`` gives the rows that
    belong to a page's keys by name, ``dims`` are the columns of its facets."""

    key: str
    params: Mapping[str, Param]
    sorts: Mapping[str, Sort]
    date: str | None = None
    date_of_groups: bool = False
    grouped: Callable[[DataFrame], DataFrame] = lambda rows: rows
    checks: Mapping[str, Column] = field(default_factory=dict)
    include: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    dims: Mapping[str, Column] = field(default_factory=dict)
    limit: int = 50
    most: int = 200


def _whole(name: str, text: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise BadRequest(f"{name}: {text!r} is no whole number") from None


def _day(name: str, text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise BadRequest(f"{name}: {text!r} is no day") from None


def _words(allowed: tuple[str, ...] | None) -> Callable[[str], list[str]]:
    """Parts between commas, spelt as in the vocabulary; any case is taken."""
    spelt = {a.lower(): a for a in allowed or ()}

    def parse(text: str) -> list[str]:
        parts = [p.strip() for p in text.split(",") if p.strip()]
        unknown = [p for p in parts if allowed is not None and p.lower() not in spelt]
        if unknown:
            raise BadRequest(f"{', '.join(unknown)}: not among {', '.join(allowed)}")
        return [spelt.get(p.lower(), p) for p in parts]

    return parse


def one_of(column: str, allowed: tuple[str, ...] | None = None, groups: bool = False, default: str = "") -> Param:
    return Param(_words(allowed), lambda rows, got, _: rows.where(F.col(column).isin(got)), groups, default)


def any_of(tokens: str, allowed: tuple[str, ...] | None = None, groups: bool = False) -> Param:
    """Rows whose array of tokens holds any of the values asked for."""
    return Param(_words(allowed), lambda rows, got, _: rows.where(P.any_token(F.col(tokens), got)), groups)


def family(column: str, families: Mapping[str, tuple[str, ...]], groups: bool = False) -> Param:
    """Values by the name of their family; each family lists the spellings that are stored."""
    return Param(_words(tuple(families)), lambda rows, got, _: rows.where(F.col(column).isin([s for g in got for s in families[g]])), groups)


def at_least(column: str, groups: bool = False, default: str = "") -> Param:
    def parse(text: str) -> float:
        try:
            return float(text)
        except ValueError:
            raise BadRequest(f"{text!r} is no number") from None

    return Param(parse, lambda rows, got, _: rows.where(F.col(column) >= got), groups, default)


def switch(condition: Column, groups: bool = False, default: str = "") -> Param:
    """Only rows that fulfil the condition, where switched on."""

    def parse(text: str) -> bool:
        if text.lower() not in TRUE + FALSE:
            raise BadRequest(f"{text!r} is neither yes nor no")
        return text.lower() in TRUE

    return Param(parse, lambda rows, got, _: rows.where(F.coalesce(condition, F.lit(False))) if got else rows, groups, default)


def holds(column: str, groups: bool = False) -> Param:
    """Rows whose text holds the value in any case; wildcards of LIKE are taken out of it, an empty rest asks for nothing."""
    parse = lambda text: text.replace("%", "").replace("_", " ").strip().lower()
    return Param(parse, lambda rows, got, _: rows.where(F.contains(F.lower(F.col(column)), F.lit(got))) if got else rows, groups)


def company(ticker: str, additional: str) -> Param:
    """Rows of a symbol, cross-filed ones too; of a symbol that is listed on both sides of the border only those of its side."""

    def parse(text: str) -> str:
        asked = text.upper()
        return asked[:-3] + ".US" if asked.endswith("-US") else asked

    def apply(rows: DataFrame, asked: str, context: Context) -> DataFrame:
        found = L.of_company(rows, ticker, additional, asked, False)
        all_listings = rows if context.listings is None else context.listings
        clash = L.clashes(all_listings.select(F.col(ticker)), ticker).where(F.col("bare") == L.bare(F.lit(asked)))
        clash = clash.agg((F.count("*") > 0).alias("_clash"))  # one row
        us = F.upper(F.col(ticker)).endswith(".US")
        return found.crossJoin(F.broadcast(clash)).where(~F.col("_clash") | (us if asked.endswith(".US") else ~us)).drop("_clash")

    return Param(parse, apply)


def universe(on: str) -> Param:
    """Rows of a named key set; a name that isn't known and a set without keys let all rows pass."""

    def apply(rows: DataFrame, name: str, context: Context) -> DataFrame:
        keys = context.universes.get(name)
        return rows if keys is None else P.semi_or_open(rows, keys, [on])

    return Param(str.strip, apply)


def scope(conditions: Mapping[str, Callable[[dt.date], Column]], default: str, groups: bool = False) -> Param:
    """A named part of the rows, stated relative to the day of the request."""

    def parse(text: str) -> str:
        if text not in conditions:
            raise BadRequest(f"{text}: not among {', '.join(conditions)}")
        return text

    return Param(parse, lambda rows, got, context: rows.where(F.coalesce(conditions[got](context.today), F.lit(False))), groups, default)


@dataclass(frozen=True)
class Answer:
    """matching: all items asked for, annotated. items: those of the page, with ``total``. All are lazy."""

    listing: Listing
    matching: DataFrame
    items: DataFrame
    page: int
    limit: int

    def facets(self) -> DataFrame:
        """(facet, value, n) over everything that matched, not over the page."""
        return facets(self.matching, dict(self.listing.dims))

    def included(self, name: str) -> DataFrame:
        """Rows that belong to the page's items. They stay rows, so an item may have any number of them."""
        if name not in self.listing.include:
            raise BadRequest(f"include: {name} not among {', '.join(self.listing.include)}")
        return self.listing.include[name](self.items.select(self.listing.key))


def _dated(rows: DataFrame, column: str, given: dict[str, str], context: Context) -> DataFrame:
    """since and until are days, both included; days shortens since and never widens it."""
    since = _day("since", given["since"]) if "since" in given else None
    until = _day("until", given["until"]) if "until" in given else None
    if "days" in given:
        days = _whole("days", given["days"])
        if days < 1:
            raise BadRequest("days: at least 1")
        try:
            recent = context.today - dt.timedelta(days=days)
        except OverflowError:
            recent = dt.date.min
        since = recent if since is None else max(since, recent)
    if since is not None and until is not None and since > until:
        raise BadRequest("since is after until")
    if since is not None:
        rows = rows.where(F.col(column) >= F.lit(since.isoformat()).cast("timestamp_ntz"))
    if until is not None and until < dt.date.max:
        rows = rows.where(F.col(column) < F.lit((until + dt.timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return rows


def ask(listing: Listing, rows: DataFrame, request: Mapping[str, str], context: Context) -> Answer:
    given = {name: str(text).strip() for name, text in request.items() if str(text).strip()}
    frame = {"sort", "page", "limit", "offset"} | ({"since", "until", "days"} if listing.date else set())
    unknown = sorted(set(given) - frame - set(listing.params))
    if unknown:
        raise BadRequest(f"unknown: {', '.join(unknown)}")
    sort = given.get("sort", next(iter(listing.sorts)))
    if sort not in listing.sorts:
        raise BadRequest(f"sort: {sort} not among {', '.join(listing.sorts)}")
    limit = min(max(_whole("limit", given.get("limit", str(listing.limit))), 1), listing.most)
    page = max(_whole("page", given.get("page", "1")), 1)
    skipped = max(_whole("offset", given["offset"]), 0) if "offset" in given else (page - 1) * limit
    wanted = {n: p.parse(given.get(n, p.default)) for n, p in listing.params.items() if given.get(n, p.default)}

    def filtered(df: DataFrame, groups: bool) -> DataFrame:
        if listing.date and listing.date_of_groups == groups:
            df = _dated(df, listing.date, given, context)
        for name, value in wanted.items():
            if listing.params[name].groups == groups:
                df = listing.params[name].apply(df, value, context)
        return df

    matching = filtered(listing.grouped(filtered(rows, False)), True)
    matching = matching.withColumn("check", P.broken_rules(dict(listing.checks)) if listing.checks else F.array().cast("array<string>"))
    chosen = listing.sorts[sort]
    matching = matching.withColumn("unranked", (F.size("check") > 0) if chosen.ranked else F.lit(False))
    ordered = matching.orderBy(*([F.col("unranked")] if chosen.ranked else []), *chosen.order)
    total = matching.agg(F.count("*").alias("total"))
    items = ordered.offset(skipped).limit(limit).crossJoin(F.broadcast(total))
    return Answer(listing, matching, items, page, limit)


def one(listing: Listing, rows: DataFrame, key: Any) -> DataFrame:
    """The item of a key, grouped and checked as in the listing; no row where there is none."""
    found = listing.grouped(rows.where(F.col(listing.key) == F.lit(key)))
    return found.withColumn("check", P.broken_rules(dict(listing.checks)) if listing.checks else F.array().cast("array<string>"))
