"""Quality rules, line first: each line is judged, failing lines go, then documents that lost too much text are rejected.

Only SQL functions: one pass over the rows, no shuffle. Arrays that several expressions read are bound once by
``_let``, since Catalyst would otherwise evaluate them again inside each lambda.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, free_name

SYMBOLS = "#*$%&|<>"
#: Line rules. A line of MANY words or more needs a sentence mark; symbols or exclamation marks may reach 3 in 10 words.
#: A longer line than LONG words is a paragraph: one phrase of boilerplate in it is no reason to drop it whole.
MANY, FEW, LONG = 5, 6, 30
SENTENCE = "[.!?;:…。！？；：।॥؟؛۔။།።]"
SEPARATORS = "|>»›•"
NAVIGATION = r"(?i)\b(home|menu|log ?in|sign ?up|sign ?in|next page|previous page|read more|skip to content|back to top|site ?map|subscribe)\b"
BOILERPLATE = r"(?i)all rights reserved|licensed under|terms of (service|use)|privacy policy|use of cookies|javascript (is|must be)|copyright \(c\)|©|click here|lorem ipsum"
#: Base rules: least words, and most words (in 100) that lie in repeated windows. Most words (in 100) that lines may take along.
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def line_fails(line: Column) -> Column:
    """Name of the first rule that a line breaks (punctuation, navigation, boilerplate), null if none."""

    def judged(n: Column) -> Column:
        few_marks = (n >= MANY) & ~line.rlike(SENTENCE)
        marked = line.rlike(f"[{SYMBOLS}!{SEPARATORS}]")  # most lines need no counts
        noisy = marked & ((_count(line, SYMBOLS) * 10 > n * 3) | ((n >= MANY) & (_count(line, "!") * 10 > n * 3)))
        bars = marked & _let(_count(line, SEPARATORS), lambda k: (k >= 3) & (k * 4 >= n))
        menu = bars | ((n <= FEW) & line.rlike(NAVIGATION))
        return F.when(n == 0, None).when(few_marks | noisy, "punctuation").when(menu, "navigation").when((n <= LONG) & line.rlike(BOILERPLATE), "boilerplate")

    return _let(_n_words(line), judged)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Most texts have no window twice, which their hashes show. Otherwise windows with their places are sorted by (hash, words,
    place), those whose neighbour holds the same words are kept, and what each place covers is added up."""

    def gram(i: Column) -> Column:
        three = [F.get(words, i + k) for k in range(3)]
        return F.struct(F.xxhash64(*three).alias("h"), *[w.alias(f"w{k}") for k, w in enumerate(three)], i.alias("i"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a.h == b.h) & (a.w0 == b.w0) & (a.w1 == b.w1) & (a.w2 == b.w2), F.lit(False))

    def repeated(grams: Column) -> Column:
        return F.filter(grams, lambda g, k: same(g, F.get(grams, k + 1)) | same(g, F.when(k > 0, F.get(grams, k - 1))))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def counted(hashes: Column) -> Column:
        grams = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), gram))
        places = _let(grams, lambda g: _let(F.array_sort(F.transform(repeated(g), lambda x: x.i)), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(places)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)]))
    return F.when(F.size(words) >= 3, _let(hashes, counted)).otherwise(0)


def apply_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the cleaned text and the measures of the whole original text.

    Added or replaced: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words (long), base_failed,
    kept (boolean); a caller with columns of these names renames them before. ``text_col`` loses its failing lines. A null text has no words: all measures 0, base_failed, not kept,
    text null. Repeated rows and null ids are judged like any others; other columns pass through. Empty in, empty out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def measures(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), _repeat_words(words).alias("n_repeat_words"))

    def line_measures(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(WORD))
        failed = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).isNotNull().alias("fails")))

        def split(judged: Column) -> Column:
            lost = F.aggregate(F.filter(judged, lambda j: j.fails), F.lit(0), lambda n, j: n + _n_words(j.line))
            kept = F.array_join(F.transform(F.filter(judged, lambda j: ~j.fails), lambda j: j.line), "\n")
            return F.struct(lost.alias("n_lost_words"), kept.alias("cleaned"))

        dup = _let(full, lambda f: F.size(f) - F.size(F.array_distinct(f)))
        return F.struct(dup.alias("n_dup_lines"), _let(failed, split).alias("split"))

    words = F.array_remove(F.split(text, SPACE), "")
    w, l = free_name(docs, "w"), free_name(docs, "l")
    found = docs.withColumns({
        w: _let(words, measures),
        l: _let(F.split(text, "\n"), line_measures),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
    })
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = found.withColumns({
        "n_words": F.col(w)["n_words"].cast("long"),
        "n_repeat_words": F.col(w)["n_repeat_words"].cast("long"),
        "n_dup_lines": F.col(l)["n_dup_lines"].cast("long"),
        "n_lost_words": F.col(l)["split"]["n_lost_words"].cast("long"),
        text_col: F.when(F.col(text_col).isNotNull(), F.col(l)["split"]["cleaned"]),
    })
    found = found.withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MOST_LOST * F.col("n_words"))).drop(w, l)


_NAV_SQL, _BOILER_SQL = NAVIGATION.replace("'", "''"), BOILERPLATE.replace("'", "''")
ORACLE = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
counted AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS n,
    length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
    length(line) - length(translate(line, '!', '')) AS bangs,
    length(line) - length(translate(line, '{SEPARATORS}', '')) AS bars FROM lines),
judged AS (SELECT doc_id, line, n, n > 0 AND ((n >= {MANY} AND NOT regexp_matches(line, '{SENTENCE}')) OR symbols * 10 > n * 3 OR (n >= {MANY} AND bangs * 10 > n * 3)
    OR (bars >= 3 AND bars * 4 >= n) OR (n <= {FEW} AND regexp_matches(line, '{_NAV_SQL}')) OR (n <= {LONG} AND regexp_matches(line, '{_BOILER_SQL}'))) AS fails FROM counted),
per_line AS (SELECT doc_id, count(line) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY doc_id),
measured AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS n_lost_words
    FROM words w JOIN per_line p ON w.doc_id = p.doc_id LEFT JOIN repeats r ON w.doc_id = r.doc_id)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * n_lost_words <= {MOST_LOST} * n_words AS kept
FROM measured
"""
