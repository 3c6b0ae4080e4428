"""Headlines, names, sentences and labels as expressions."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.measures import let

#: Words that tell two periods or parts apart, besides months and figures; what is said before a headline; beginnings of the
#: words for a deal's steps, and their endings; words without content; words that many headlines share.
ORDINAL = "first|second|third|(?:four|fif|six|seven|eigh|nin|ten|eleven|twelf)th|half|quarter|final|initial|fy"
MONTH_NAMES = {m.lower() for names in (calendar.month_name, calendar.month_abbr) for m in names if m} | {"sept"}
NOTICES = "amended amendment clarification corrected correction news press release repeat replacement restated retransmission revised update updated".split()
STEPS = "amend announc arrang cancel clos complet definitive extend final increas initial interview launch offer postpon pric propos receiv result resum revis sign terminat tranche updat upsiz video".split()
STEP_ENDINGS = "(?:e|es|ed|ing|s|d)?"
STOPS = "the a an of and to in on at for with its is as by from inc corp ltd limited company news release press".split()
GENERAL = "annual corporate letter listing monthly note progress quarterly report shareholders update updates weekly".split()
#: Suffixes and generic words of company names; names of wires; character entities that headlines hold.
SUFFIXES = "inc incorporated corp corporation ltd limited llc plc co company the sa se ag nl pty lp ltda sac cv de".split()
GENERIC = "gold silver copper royalties royalty metals metal mining mines resources minerals capital energy streaming holdings group ventures exploration uranium lithium nickel zinc precious critical global international".split()
WIRES = ("GlobeNewswire", "Newsfile", "PR Newswire", "Business Wire", "CNW", "ACCESSWIRE")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
#: Brackets that hold nothing but capitals, figures and what parts them, and a code after the name of its exchange.
BRACKETED = r"[\(\[](?=[^)\]]*[A-Z])[A-Z0-9 .:;,|/&-]+[\)\]]"
LISTED = r"\b[A-Z]{2,}(?:[ -][A-Z]+)*\s?:\s?[A-Z0-9][A-Z0-9.]{0,6}\b"


def unescaped(x: Column) -> Column:
    """The entities of ENTITIES as characters; the ampersand last, so that nothing is decoded twice."""
    for entity, char in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def folded(x: Column) -> Column:
    """Lower case, accents off."""
    return F.lower(F.translate(x, *ACCENTS))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def is_notice(x: Column) -> Column:
    """Whether some words, but not more than three, are all said before headlines."""
    return let(_words(x), lambda w: (F.size(w) > 0) & (F.size(w) <= 3) & (F.size(F.array_except(w, F.array(*[F.lit(n) for n in NOTICES]))) == 0))


def headline_tokens(x: Column) -> Column:
    """Words of a headline without a notice before it, brackets of codes, codes of exchanges and the mark of a possessive.

    What stands in a bracket counts if it isn't a code; a notice in brackets does, as it tells a copy from its original.
    """

    def without_notice(h: Column) -> Column:
        begins = F.regexp_extract(h, r"^([^:–—-]{1,40})(?::|\s[–—-]|[–—])", 1)
        return F.when(is_notice(begins), F.substring(h, F.length(begins) + 1, F.length(h))).otherwise(h)

    def without_codes(h: Column) -> Column:
        kept = F.regexp_replace(h, r"(?i)[\(\[](" + "|".join(NOTICES) + r")[\)\]]", " $1 ")
        return F.regexp_replace(F.regexp_replace(kept, BRACKETED, " "), LISTED, " ")

    plain = F.regexp_replace(unescaped(F.coalesce(x, F.lit(""))), "’", "'")
    return _words(F.regexp_replace(without_codes(let(plain, without_notice)), r"(?i)(?<=[a-z0-9])'s\b", "s"))


def is_marker(word: Column) -> Column:
    return word.rlike(f"[0-9]|^(?:{ORDINAL})$") | word.isin(*sorted(MONTH_NAMES))


def markers(tokens: Column) -> Column:
    """Words that tell periods and parts apart: ordinals, months, anything with a digit."""
    return F.filter(tokens, is_marker)


def content_agreement(a: Column, b: Column) -> Column:
    """Share of the shorter headline's content words that the other has too; 0 without any."""
    words = lambda t: F.array_distinct(F.filter(t, lambda w: (F.length(w) > 2) & ~w.isin(*STOPS)))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def step_words(tokens: Column) -> Column:
    """Words of a deal's step by their beginnings, so that "closes" and "closing" are one."""
    pattern = f"^({'|'.join(STEPS)}){STEP_ENDINGS}$"
    return F.array_distinct(F.filter(F.transform(tokens, lambda w: F.regexp_extract(w, pattern, 1)), lambda w: w != ""))


def steps_differ(a: Column, b: Column) -> Column:
    """Whether two token arrays tell of different steps."""
    return let(F.struct(step_words(a).alias("x"), step_words(b).alias("y")), lambda s: F.size(F.array_union(s.x, s.y)) != F.size(F.array_intersect(s.x, s.y)))


def source_kind(source: Column) -> Column:
    """exchange, site or wire; ranks 2, 1 and 0 say which copy to keep, lowest first."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s.isin("tmx", "cse"), "exchange").when(s.startswith("company_ir") | s.endswith("_own_site"), "site").otherwise("wire")


def source_rank(source: Column) -> Column:
    kind = source_kind(source)
    return F.when(kind == "wire", 0).when(kind == "site", 1).otherwise(2)


def without_wire(x: Column) -> Column:
    """A headline without the names of wires at its end, as long as 12 characters stay."""
    tail = r"(?i)\s+[-–—|]\s+(?:" + "|".join(WIRES) + r")\s*$"
    for _ in range(3):
        x = let(x, lambda h: let(F.rtrim(F.regexp_replace(h, tail, "")), lambda cut: F.when(F.length(cut) >= 12, cut).otherwise(h)))
    return x


def name_key(x: Column) -> Column:
    """Words of a party's name, folded, without company suffixes."""
    words = F.filter(F.split(folded(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*SUFFIXES))
    return F.array_join(words, " ")


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are of one company: equal keys, or one leads the other with two words or one that isn't generic."""

    def judged(x: Column, y: Column) -> Column:
        short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
        telling = short.contains(" ") | ((F.length(short) >= 5) & ~short.isin(*GENERIC))
        return (short != "") & ((x == y) | (long.startswith(F.concat(short, F.lit(" "))) & telling))

    return let(F.struct(name_key(a).alias("x"), name_key(b).alias("y")), lambda k: judged(k.x, k.y))


def one_change(a: Column, b: Column) -> Column:
    """Exactly one character swapped for another, inserted or deleted."""
    return (a != b) & (F.levenshtein(a, b, 1) == 1)


def covers(a: Column, b: Column) -> Column:
    """Whether all words of one name stand in the other, words of five letters with one change too; two empty names agree."""

    def within(x: Column, y: Column) -> Column:
        return F.forall(x, lambda w: F.exists(y, lambda v: (w == v) | ((F.length(w) >= 5) & (F.length(v) >= 5) & one_change(w, v))))

    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.trim(n)), r"\s+"), lambda w: (F.length(w) > 2) | w.rlike("^[0-9]+$"))) for n in (a, b))
    empty = (F.size(x) == 0).cast("int") + (F.size(y) == 0).cast("int")
    return F.when(empty == 2, True).when(empty == 1, False).otherwise(within(x, y) | within(y, x))


def sentences(x: Column) -> Column:
    """array<struct<sentence, start, end>>: sentences with their places from 0; a sentence ends at . ! or ? before a blank, or at a
    line's end."""
    from tessera.functions.measures import spans

    return spans(x, r"[^\s.!?][^\n]*?(?:[.!?]+(?=\s|$)|(?=\n|$))")


def without_boilerplate(x: Column, pattern: str) -> Column:
    """The text before the first line that begins as ``pattern`` says."""
    at = F.regexp_instr(x, F.lit(rf"(?im)^(?:{pattern})"), 0)
    return F.when(at > 0, F.rtrim(F.substring(x, F.lit(1), at - 1), F.lit(" \n"))).otherwise(x)


def unwrapped(x: Column) -> Column:
    """Lines joined that a page width broke: hyphens at line ends close up, single line ends become blanks."""
    x = F.regexp_replace(x, r"(?<=[a-z])-\n(?=[a-z])", "")
    return F.regexp_replace(F.regexp_replace(x, r"(?<!\n)\n(?!\n)", " "), " {2,}", " ")


def headline_problem(x: Column) -> Column:
    """Why a headline won't do, null if it will."""
    t = F.trim(F.coalesce(x, F.lit("")))
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return (
        F.when(t == "", "empty").when(F.length(t) < 12, "short").when(F.length(t) > 250, "long").when(~t.rlike("[A-Za-z]{3}"), "no words")
        .when((F.length(letters) > 20) & (letters == F.upper(letters)), "capitals").when(t.rlike(r"(?i)^(for immediate release|not for distribution|page \d+)"), "notice").when(t.rlike(r"[,;:]$|\b(?:and|of|the|to)$"), "cut off")
    )


def quantity_label(v: Column, unit: str | None = None) -> Column:
    """1234567 lb as 1.235M lb, 1234 as 1,234, 12.50 as 12.5."""
    tail = f" {unit}" if unit else ""
    a = F.abs(v)
    # %.3f and %.1f of C round half to even on the binary value, which a decimal of the double's full digits reproduces
    short = lambda x, n: F.regexp_replace(F.format_string(f"%.{n}f", x), r"\.?0+$", "")
    text = F.when(a >= 1e6, F.concat(short(a / 1e6, 3), F.lit("M" + tail))).when(a >= 100, F.concat(F.format_number(a, 0), F.lit(tail))).otherwise(F.concat(short(a, 1), F.lit(tail)))
    return F.when(v < 0, F.concat(F.lit("-"), text)).otherwise(text)
