"""String expressions: slugs, normalisers, HTML text, language by stop words, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent words that tell four languages apart.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "von"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "for"],
    "es": ["el", "los", "y", "que", "en", "una", "por", "con"],
    "fr": ["le", "les", "et", "des", "une", "est", "pour", "dans"],
}


def slug(x: Column, most: int = 80) -> Column:
    flat = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(flat, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("release"))


def headline_key(x: Column) -> Column:
    """Letters and digits of a headline without a leading notice, lower case, 120 characters."""
    bare = F.regexp_replace(F.lower(x), "^(update|correction|press release)[ :-]+", "")
    return F.substring(F.regexp_replace(bare, "[^a-z0-9]+", ""), 1, 120)


def words(x: Column) -> Column:
    """Lower-case ASCII words in order."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def words_text(x: Column) -> Column:
    """The same words as one string, with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def html_text(x: Column) -> Column:
    """Text of a page: scripts, styles and comments out, tags to blanks, blanks joined."""
    bare = F.regexp_replace(x, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \t\r\n]+", " "))


def stop_word_language(x: Column) -> Column:
    """Language with the most stop words, ties to the first in order; null without any."""
    tokens = F.split(F.lower(x), "[^a-zà-ÿ]+")

    def known(some: list[str]):
        return lambda w: w.isin(some)

    best = F.array(*[F.struct(F.size(F.filter(tokens, known(s))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, s) in enumerate(sorted(STOP_WORDS.items()))])
    top = F.array_max(best)
    return F.when(top.n > 0, top.lang)


def salted_id(x: Column, salt: Column) -> Column:
    """Sixteen hex digits of a hash under a changing salt."""
    return F.substring(F.sha2(F.concat(salt, F.lit(":"), x), 256), 1, 16)


def with_tag(tags: Column, tag: str, vocabulary: list[str], default: str) -> Column:
    """tags and one more, in the vocabulary's order; the default goes. Tags outside the vocabulary are dropped."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    return F.array_intersect(known, F.array_append(F.filter(tags, lambda t: t != default), F.lit(tag)))


def without_tag(tags: Column, tag: str, vocabulary: list[str], default: str) -> Column:
    """tags without one, in the vocabulary's order; the default where none is left."""
    left = F.array_intersect(F.array(*[F.lit(t) for t in vocabulary]), F.filter(tags, lambda t: t != tag))
    return F.when(F.size(left) > 0, left).otherwise(F.array(F.lit(default)))


def small_json(raw: Column, items: int, letters: int) -> Column:
    """A JSON list of (label, amount) kept small: ``items`` at most, labels cut, amounts that aren't finite numbers null."""
    parsed = F.slice(F.from_json(raw, "array<struct<label: string, amount: string>>"), 1, items)
    number = lambda x: F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), x.try_cast("double"))
    return F.transform(parsed, lambda x: F.struct(F.substring(x.label, 1, letters).alias("label"), number(x.amount).alias("amount")))


def fenced_json(said: Column) -> Column:
    """The JSON object in an answer: inside a code fence, else from the first brace to the last; null if it doesn't parse."""
    fence = F.nullif(F.regexp_extract(said, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(said, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fence, bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def best_window(words: Column, asked: Column) -> Column:
    """struct (words, place): the run of as many words as ``asked`` that shares most of them, the first of equals; place from 0."""

    def windows(x: Column) -> Column:
        n = F.size(x.asked)
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x.words) - n)), lambda i: F.struct(F.size(F.array_intersect(F.slice(x.words, i + 1, n), x.asked)).alias("shared"), (-i).alias("at")))
        top = F.array_max(runs)
        return F.struct(F.slice(x.words, 1 - top["at"], n).alias("words"), (-top["at"]).alias("place"))

    return F.get(F.transform(F.array(F.struct(words.alias("words"), asked.alias("asked"))), windows), F.lit(0))
