"""Dates, titles, projects, addresses and markup of releases."""

from __future__ import annotations

import difflib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.headlines import GENERAL, NOTICES, STOPS, headline_tokens, is_notice, markers, name_key, steps_differ
from tessera.functions.measures import let, spans
from tessera.functions.values import lenient_date

MONTH_DAY = r"(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}"
#: What stands before a date that a text only mentions; words of titles that stay small; tags and attributes that a
#: page may keep, tags whose content goes too, and address schemes; suffixes of two labels.
MENTIONED = r"(?i)(?:dated|announced (?:on|in)|as of|until|before|since|release of|effective)\s*$"
SMALL = "a an and as at by for from in of on or the to with".split()
TAGS = "a b blockquote br div em h1 h2 h3 h4 h5 h6 hr i img li ol p pre span strong sub sup table tbody td th thead tr u ul".split()
ATTRIBUTES = {"*": ("class", "id", "title", "lang"), "a": ("href", "name"), "img": ("src", "alt", "width", "height"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
GONE = ("script", "style", "noscript", "template", "svg", "iframe", "object", "form")
SCHEMES = ("http", "https", "mailto", "tel")
TWO_LABELS = ("co.uk", "com.au", "co.nz", "co.za", "com.mx", "com.br")


def dateline(body: Column, upload: Column, back: int = 400) -> Column:
    """struct (day, how): the first date that a place or a dash introduces as the release's own, at most ``back`` days before the
    upload; else the first date of the opening that isn't just mentioned; else the upload."""
    head = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "<[^>]+>", " "), r"\s+", " ")), 1, 2500)

    def read(text: Column) -> Column:
        def judged(x: Column, day: Column) -> Column:
            before = F.substring(text, F.greatest(F.lit(1), x.start - 39), F.least(F.lit(40), x.start))
            after = F.substring(text, x.end + 1, F.lit(4))
            right = day.between(F.date_sub(upload, back), upload) & ~before.rlike(MENTIONED)
            own = before.rlike(r"[,\-–—/]\s*$|\)\s*$") & after.rlike(r"^\s*[\-–—/(]|^\s*--")
            return F.struct(F.when(right, day).alias("day"), (right & own).alias("own"), (x.start < 600).alias("opening"))

        def chosen(found: Column) -> Column:
            own = F.get(F.filter(found, lambda x: x.own), F.lit(0)).day
            opening = F.get(F.filter(found, lambda x: x.day.isNotNull() & x.opening), F.lit(0)).day
            return let(F.struct(own.alias("own"), opening.alias("opening")), told)

        def told(x: Column) -> Column:
            how = F.when(x.own.isNotNull(), "dateline").when(x.opening.isNotNull(), "opening").otherwise("upload")
            return F.struct(F.coalesce(x.own, x.opening, upload).alias("day"), how.alias("how"))

        return let(F.transform(spans(text, MONTH_DAY), lambda x: let(lenient_date(x.found), lambda day: judged(x, day))), chosen)

    return let(head, read)


def shouting(x: Column) -> Column:
    letters = F.regexp_replace(x, "[^A-Za-z]", "")
    return (F.length(letters) >= 8) & (F.length(F.regexp_replace(letters, "[^A-Z]", "")) * 10 >= F.length(letters) * 8)


def smart_title(x: Column, acronyms: tuple[str, ...]) -> Column:
    """A headline in capitals in title case: small words stay small inside, acronyms and words with digits stay as they are."""

    def cased(w: Column, i: Column) -> Column:
        low = F.lower(w)
        plain = F.upper(F.regexp_replace(w, "[^A-Za-z]", ""))
        return F.when(w.rlike("[0-9]") | plain.isin(*acronyms), w).when((i > 0) & low.isin(*SMALL), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low))))

    return F.when(shouting(x), F.array_join(F.transform(F.split(x, r"\s+"), cased), " ")).otherwise(x)


def title_from_body(body: Column) -> Column:
    """The first line of a body that can be a title: three words or more, no notice, no sentence's end."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    fine = F.filter(lines, lambda x: (F.size(F.split(x, r"\s+")) >= 3) & (F.length(x) <= 250) & ~x.rlike(r"(?i)^(?:for immediate release|not for distribution|page \d|news release)") & ~x.rlike(r"[.!?]$"))
    return F.get(fine, F.lit(0))


def without_intro(headline: Column) -> Column:
    """A headline that a dateline was glued to, cut before it; whole where less than 12 characters would stay."""
    cut = F.rtrim(F.regexp_replace(headline, rf"\s+[A-Z][A-Za-z. ]+,\s+[A-Za-z. ]+\s*[,\-–—/]+\s*(?:{MONTH_DAY}).*$", ""), F.lit(" -–—"))
    return let(cut, lambda c: F.when(F.length(c) >= 12, c).otherwise(headline))


PROJECT = r"\b((?:[A-Z][\w'-]+ ){1,4})(?:Project|Property|Mine|Deposit)\b"


def projects(text: Column) -> Column:
    """Names before Project, Property, Mine or Deposit, in the order of the text, as often as they stand."""
    found = F.regexp_extract_all(text, F.lit(PROJECT), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"^(?:The|Its|Our|At|In|On) ", ""))), lambda x: x != "")


def primary_project(text: Column) -> Column:
    """The project a text names most, the first of equals."""

    def most(all_found: Column) -> Column:
        counted = F.transform(F.array_distinct(all_found), lambda p, i: F.struct(F.size(F.filter(all_found, lambda x: x == p)).alias("n"), (-i).alias("place"), p.alias("name")))
        return F.array_max(counted)["name"]

    return let(projects(text), most)


def same_project(a: Column, b: Column) -> Column:
    """Equal keys, or one that leads the other."""
    x, y = (F.regexp_replace(name_key(n), r"\b(?:project|property|mine|deposit)\b", "") for n in (a, b))
    return let(F.struct(F.trim(x).alias("x"), F.trim(y).alias("y")), lambda k: (k.x != "") & (k.y != "") & (F.startswith(k.x, k.y) | F.startswith(k.y, k.x)))


def hidden_address(code: Column) -> Column:
    """The address in a hex string whose first byte is XORed on all others; null if it isn't one."""

    def found(hidden: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.floor(F.length(hidden) / 2).cast("int")), lambda i: F.conv(F.substring(hidden, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
        plain = let(pairs, lambda p: F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda c: F.char(c.bitwiseXOR(F.get(p, F.lit(0))))), ""))
        return let(F.when(hidden.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), plain), lambda a: F.when(a.rlike(r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$"), a))

    return let(code, found)  # evaluated once, not for each pair of letters


def registrable(host: Column) -> Column:
    """The part of a host that is registered: two labels, three under suffixes of two."""
    parts = F.split(host, r"\.")
    two, three = (F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".") for n in (2, 3))
    return F.when(F.size(parts) <= 2, host).when(two.isin(*TWO_LABELS), three).otherwise(two)


def cleaned_html(html: Column) -> Column:
    """A page without widgets (share bars, related links, forms), with lazy images as images."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe|form)\b.*?</\1\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, r'(?is)<(div|ul|section|nav|aside|footer|header)\b[^>]*class="[^"]*\b(?:share|social|related|sidebar|cookie|newsletter)[^"]*"[^>]*>(?:(?!<\1\b).)*?</\1\s*>', "")
    return F.regexp_replace(x, r'(?i)(<img\b[^>]*?)\bsrc="data:[^"]*"([^>]*?)\bdata-src="([^"]*)"', '$1src="$3"$2')


class _Allowed(HTMLParser):
    """Keeps the tags and attributes of an allow-list; content of GONE goes, other tags leave their content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        if tag in GONE:
            self.inside += 1
        elif not self.inside and tag in TAGS:
            named = [(k, v or "") for k, v in attrs if k in ATTRIBUTES["*"] or k in ATTRIBUTES.get(tag, ())]
            fine = [(k, v) for k, v in named if k not in ("href", "src") or self.safe(v)]
            self.out.append("<" + tag + "".join(f' {k}="{escape(v)}"' for k, v in fine) + ">")

    def handle_endtag(self, tag):
        if tag in GONE:
            self.inside = max(0, self.inside - 1)
        elif not self.inside and tag in TAGS and tag not in ("br", "hr", "img"):
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(escape(data, quote=False))

    @staticmethod
    def safe(url: str) -> bool:
        scheme, colon, _ = "".join(url.split()).lower().partition(":")
        return not colon or "/" in scheme or scheme in SCHEMES


@F.pandas_udf(T.StringType())
def sanitized(html: pd.Series) -> pd.Series:
    """Markup of the allow-list only; null stays null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        parser = _Allowed()
        parser.feed(text)
        parser.close()
        return "".join(parser.out)

    return html.map(one)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two strings in matching blocks, longest first (0..1)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over words (arrays of strings); 0 where a side has fewer than forty."""
    enough = lambda w: w is not None and len(w) >= 40
    return pd.Series([difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() if enough(x) and enough(y) else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


def ratio_from(least: float):
    """sequence_ratio where it is ``least`` or more, else 0. Letters that two strings share bound their ratio, so most pairs are told
    by counting letters."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.fillna(""), b.fillna("")
        codes, names = pd.factorize(pd.concat([x, y], ignore_index=True))
        letters = np.zeros((len(names), 128), dtype=np.int32)  # other letters fall on these, which only raises the bound
        for row, name in enumerate(names):
            letters[row] = np.bincount(np.fromiter((ord(c) % 128 for c in name), np.int64, len(name)), minlength=128)
        i, j = codes[: len(x)], codes[len(x) :]
        bound = 2.0 * np.minimum(letters[i], letters[j]).sum(axis=1) / np.maximum(1, letters[i].sum(axis=1) + letters[j].sum(axis=1))
        bound[(letters[i].sum(axis=1) + letters[j].sum(axis=1)) == 0] = 1.0
        alike = [difflib.SequenceMatcher(None, s, t, autojunk=False).ratio() if most >= least else 0.0 for s, t, most in zip(x, y, bound, strict=True)]
        return pd.Series([r if r >= least else 0.0 for r in alike], dtype=float)

    return ratio


#: Share of matching blocks from which on headlines are alike, letters from which on a beginning tells, words of their own that a headline
#: needs to be told by.
ALIKE, LONG_BEGINNING, TELLING = 0.9, 40, 3


def headline_facts(h: Column) -> Column:
    """struct (words, notice): what headline_grade needs to know of one headline: its words, and whether a notice stands before it."""
    return F.struct(headline_tokens(h).alias("words"), F.coalesce(is_notice(F.split_part(h, F.lit(":"), F.lit(1))), F.lit(False)).alias("notice"))


def facts_grade(a: Column, b: Column, ratio: Column) -> Column:
    """headline_grade of two headlines by their headline_facts, which are made once for a headline that meets many."""
    general = F.array(*[F.lit(w) for w in sorted({*STOPS, *GENERAL, *NOTICES})])

    def graded(t: Column) -> Column:
        least = F.least(F.size(t.a), F.size(t.b))
        begins_a, begins_b = F.slice(t.a, 1, least), F.slice(t.b, 1, least)
        parted = (least == 0) | (markers(begins_a) != markers(begins_b)) | steps_differ(t.a, t.b) | t.corrected
        goes_on = (begins_a == begins_b) & (F.length(F.array_join(begins_a, " ")) >= LONG_BEGINNING)
        telling = F.size(F.array_except(F.when(F.size(t.a) <= F.size(t.b), t.a).otherwise(t.b), general)) >= TELLING
        return F.when(~parted & telling & (goes_on | (ratio >= ALIKE) | (t.a == t.b)), 2).when(~parted & (t.a == t.b), 1).otherwise(0)

    return let(F.struct(a.words.alias("a"), b.words.alias("b"), (a.notice | b.notice).alias("corrected")), graded)


def headline_grade(a: Column, b: Column, ratio: Column) -> Column:
    """2 for the same headline, 1 for the same but too general to go by, 0 for different ones. ratio: sequence_ratio of the two, or
    ratio_from(ALIKE), reckoned on candidate pairs only.

    Headlines are alike if their words are equal, if the longer goes on where the shorter ends after LONG_BEGINNING letters, or if
    their ratio says so. Markers that both have room for, steps of a deal and a notice of correction part them. Those
    with fewer than TELLING words of their own are alike only if equal, and then general.
    """
    return let(F.struct(headline_facts(a).alias("a"), headline_facts(b).alias("b")), lambda t: facts_grade(t.a, t.b, ratio))


def scored(text: Column, rules: list[tuple[str, int, str, bool]]) -> Column:
    """struct (score, reasons): points of the rules (reason, points, pattern, stop) that match, in order; a rule that stops is the last
    that counts."""
    hits = F.array(*[F.struct(text.rlike(f"(?i){p}").alias("hit"), F.lit(n).alias("points"), F.lit(why).alias("why"), F.lit(stop).alias("stop")) for why, n, p, stop in rules])

    def counted(found: Column) -> Column:
        some = F.filter(found, lambda x: x.hit)
        stops = F.filter(F.transform(some, lambda x, i: F.when(x.stop, i)), lambda i: i.isNotNull())
        kept = F.slice(some, F.lit(1), F.when(F.size(stops) > 0, F.get(stops, F.lit(0)) + 1).otherwise(F.size(some)))
        return F.struct(F.aggregate(kept, F.lit(0), lambda n, x: n + x.points).alias("score"), F.array_join(F.transform(kept, lambda x: x.why), ",").alias("reasons"))

    return let(hits, counted)
