"""Companies by ticker: bare symbols, listings that clash, cross-filed rows, names with previous tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.releases import registrable
from tessera.functions.text import stop_word_language


def bare(ticker: Column) -> Column:
    return F.upper(F.split_part(ticker, F.lit("."), F.lit(1)))


def clashes(listings: DataFrame, ticker: str) -> DataFrame:
    """bare: symbols that are listed both in the US and elsewhere."""
    us = F.upper(F.col(ticker)).endswith(".US")
    return listings.groupBy(bare(F.col(ticker)).alias("bare")).agg(F.bool_or(us).alias("us"), F.bool_or(~us).alias("other")).where("us and other").select("bare")


def of_company(rows: DataFrame, ticker: str, additional: str, asked: str, clash: bool) -> DataFrame:
    """Rows of the symbol asked for, under any suffix or cross-filed; of a clashing symbol only its side of the border."""
    want = asked.upper()
    want = want[:-3] + ".US" if want.endswith("-US") else want
    stem = want.split(".")[0]
    own = (F.upper(F.col(ticker)) == want) | F.upper(F.col(ticker)).startswith(f"{stem}.")
    crossed = F.exists(additional, lambda t: (F.upper(t) == want) | F.upper(t).startswith(f"{stem}."))
    found = rows.where(own | F.coalesce(crossed, F.lit(False)))
    us = F.upper(F.col(ticker)).endswith(".US")
    return found.where(us if want.endswith(".US") else ~us) if clash else found


def named(rows: DataFrame, ticker: str, companies: DataFrame) -> DataFrame:
    """rows with ``name``: that of the company whose ticker it is, or was, where no company has it now.

    companies: ticker, name, previous_tickers. The dimension is joined by hash; Spark broadcasts it where its size allows.
    """
    now = companies.select(F.col("ticker").alias("t"), "name", F.lit(0).alias("age"))
    before = companies.select(F.explode("previous_tickers").alias("t"), "name", F.lit(1).alias("age"))
    best = now.union(before).groupBy("t").agg(F.min_by("name", F.struct("age", "name")).alias("name"))
    return rows.join(best, F.col(ticker) == F.col("t"), "left").drop("t")


def deal_class(kind: Column, text: Column, kinds: list[tuple[str, str]], phrases: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """Class of a deal: by a token of its kind, else by a phrase of the text, in order; else the default."""
    tokens = F.split(F.upper(F.regexp_replace(F.coalesce(kind, F.lit("")), "[,/]", "+")), r"\+")
    low = F.lower(text)
    by_kind = [F.when(F.array_contains(tokens, token), name) for name, token in kinds]
    by_phrase = [F.when(F.exists(F.array(*[F.lit(p) for p in some]), lambda p: F.contains(low, p)), name) for name, some in phrases]
    return F.coalesce(*by_kind, *by_phrase, F.lit(default))


def substantive(headline: Column, body: Column, least: int = 350) -> Column:
    """Why a body isn't news of its own (null if it is): empty, little beside the headline, or a teaser's end."""
    rest = F.trim(F.replace(F.trim(body), F.trim(headline), F.lit("")))
    return F.when(F.coalesce(F.trim(body), F.lit("")) == "", "empty").when(F.length(rest) < least, "short").when(body.rlike(r"(?i)\.\.\.\s*(?:read\s+more)?\s*$"), "teaser")


def page_gate(host: Column, path: Column, headline: Column, body: Column, own: tuple[str, ...], languages: tuple[str, ...], generic: str, least: int = 350) -> Column:
    """Why a page isn't taken, null if it is. In order: its site isn't one of ``own`` ('external'), its path is a list or a front page
    by the pattern ``generic`` ('generic'), its stop words are of another language ('language'), its body says too little ('empty',
    'short', 'teaser'). A page without a host is external; a text without stop words is of no language and passes that rule."""
    site = registrable(host)
    spoken = stop_word_language(body)
    return (
        F.when(~F.coalesce(site.isin(*own), F.lit(False)), "external")
        .when(F.coalesce(path, F.lit("")).rlike(generic), "generic")
        .when(~F.coalesce(spoken.isin(*languages), F.lit(True)), "language")
        .otherwise(substantive(F.coalesce(headline, F.lit("")), body, least))
    )
