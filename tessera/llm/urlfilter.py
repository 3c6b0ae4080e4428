"""URL filters: pattern rules indexed by their rarest literal token, so that a URL runs only the few rules its tokens fetch.

A rule is a pattern with an action. Patterns:

    host/path     that host and its subdomains, paths that begin with path
    *text, /text  text anywhere after ``://``, letters of any case
    *             inside: any run of characters
    ^             one character that can't be part of a name (neither letter nor digit nor ``_ . % -``), or the end
    |             at the end: the URL ends here

A literal token is a run of ASCII letters and digits that has a fixed end on both sides in the pattern, so that every URL the
rule fits holds it as a whole token. How many URLs hold each token of the rules is counted over all URLs; a rule is filed
under its rarest. A rule without a whole token is filed under the empty token, which every URL has.

Only SQL functions. The index is an array of buckets, found by the hash of a token: one scalar that goes to all tasks, so URLs
are judged in one pass without a shuffle. The index is that large only while there are at most INDEXED rules; more are joined
by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Rules up to which the index is one value for all tasks.
INDEXED = 20_000
#: Rules by site: they decide before patterns do.
SITES = [("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK)]
#: Patterns for URLs that no site rule fits: gambling and adult sites, spam shops, pages without prose, trackers.
PATTERNS = [
    ("*casino*", BLOCK), ("*poker*", BLOCK), ("*jackpot*", BLOCK), ("*^bet^", BLOCK), ("*^slots^", BLOCK), ("*porn*", BLOCK), ("*^xxx^", BLOCK), ("*^adult^", BLOCK),
    ("*viagra*", BLOCK), ("*^payday-loan*", BLOCK), ("*^cheap-pills*", BLOCK), ("*^replica-watches*", BLOCK), ("/wp-login.php", BLOCK), ("/login^", BLOCK), ("/signup^", BLOCK),
    ("/cart^", BLOCK), ("/checkout^", BLOCK), ("/ads/", BLOCK), ("*^doubleclick^", BLOCK), ("*^adserver^", BLOCK), ("*^tracking-pixel^", BLOCK), ("*.exe|", BLOCK), ("*.zip|", BLOCK),
    ("*^poker-history^", ALLOW),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns that aren't bound to a host.
ANYWHERE = r"^[*/]"
_RULE = "tier:int,pattern:string,action:string"


def lowered(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, _UPPER, _LOWER)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``, the host in lower case; empty for null and URLs without it."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.concat(lowered(host), F.substring(after, F.length(host) + 1, F.length(after)))


def host_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^([^/?#]*)", 1)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def regex_of(pattern: Column) -> Column:
    """The pattern as a regular expression on what follows ``://``."""
    escaped = F.regexp_replace(pattern, r"([\\.+?(){}\[\]$|])", r"\\$1")
    ended = F.regexp_replace(escaped, r"\\\|$", r"\\z")
    inner = F.replace(F.replace(ended, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:[^A-Za-z0-9_.%-]|\z)"))
    anywhere = F.concat(F.lit("(?is)"), F.regexp_replace(inner, r"^(\.\*)+", ""))
    return F.when(pattern.rlike(ANYWHERE), anywhere).otherwise(F.concat(F.lit(r"(?s)^(?:[^/?#]*\.)?"), inner))


def tokens_of(pattern: Column) -> Column:
    """Literal tokens with a fixed end on both sides, in lower case. A site begins at a dot or at the URL's beginning."""
    bounded = F.when(pattern.rlike(ANYWHERE), pattern).otherwise(F.concat(F.lit("."), pattern))
    return F.array_distinct(F.regexp_extract_all(lowered(bounded), F.lit(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1)))


def url_tokens(rest: Column) -> Column:
    """All tokens of a URL, and the empty one."""
    return F.array_union(F.regexp_extract_all(lowered(rest), F.lit("([a-z0-9]+)"), F.lit(1)), F.array(F.lit("")))


def rule_table(spark: SparkSession, sites: list[tuple[str, str]] | None = None, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """(tier, pattern, action): sites are of tier 0, patterns of tier 1."""
    rows = [(0, *r) for r in (SITES if sites is None else sites)] + [(1, *r) for r in (PATTERNS if patterns is None else patterns)]
    columns = [F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(p).alias("pattern"), F.lit(a).alias("action")) for t, p, a in rows])] if rows else [F.array().cast(f"array<struct<{_RULE}>>")]
    return spark.range(1).select(F.inline(*columns))


def filed(urls: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """rules with their regular expression and the token they are filed under: the one that fewest rows of ``urls`` (rest) hold.

    Where rules are few their tokens are broadcast and only these are counted; else tokens are counted before the join.
    """
    rules = rules.where(F.col("pattern").isNotNull() & (F.col("pattern") != "")).groupBy("pattern").agg(F.min(F.struct("tier", "action")).alias("first")).select("first.tier", "pattern", "first.action")
    rules = rules.withColumn("regex", regex_of(F.col("pattern")))
    offered = rules.select("pattern", F.explode(tokens_of(F.col("pattern"))).alias("token"))
    held = urls.select(F.explode(url_tokens(F.col("rest"))).alias("token"))
    asked = offered.select("token").distinct()
    if few:
        held = held.join(F.broadcast(asked), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    rarest = offered.join(counts, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return rules.join(rarest, "pattern", "left").withColumn("token", F.coalesce("rarest.token", F.lit(""))).drop("rarest")


def _bucket(token: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(size)).cast("int")


def _rank(tier: Column, pattern: Column, action: Column) -> Column:
    """Sites first, then the longest pattern, then the smallest: the least of these wins."""
    return F.struct(tier.alias("tier"), (-F.length(pattern)).alias("shortness"), pattern.alias("pattern"), action.alias("action"))


def _by_index(found: DataFrame, index: DataFrame, n_rules: int) -> DataFrame:
    """found with ``winner``, the rank of the rule that decides."""
    size = max(1, 2 * n_rules)
    entries = index.select(_bucket(F.col("token"), size).alias("bucket"), F.struct("token", "regex", _rank(F.col("tier"), F.col("pattern"), F.col("action")).alias("rank")).alias("rule"))
    buckets = found.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(entries.groupBy("bucket").agg(F.collect_list("rule").alias("rules")), "bucket", "left")
    kept = F.coalesce("rules", F.array().cast(entries.groupBy().agg(F.collect_list("rule").alias("r")).schema["r"].dataType))
    table = buckets.select("bucket", kept.alias("rules")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "rules"))), lambda b: b.rules).alias("index"))
    found = found.withColumn("index", table.scalar())

    def candidates(token: Column) -> Column:
        return F.filter(F.get("index", _bucket(token, size)), lambda r: r.token == token)

    fetched = F.flatten(F.transform(url_tokens(F.col("rest")), candidates))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.col("rest"), r.regex))
    return found.withColumn("winner", F.array_min(F.transform(fits, lambda r: r.rank))).drop("index")


def _by_join(found: DataFrame, index: DataFrame) -> DataFrame:
    """The same by a join on tokens: each different URL once. Adaptive plans split a token or a URL that many rows have."""
    urls = found.select("rest").distinct().withColumn("token", F.explode(url_tokens(F.col("rest"))))
    fits = urls.join(index, "token").where(F.regexp_like(F.col("rest"), F.col("regex")))
    winners = fits.groupBy("rest").agg(F.min(_rank(F.col("tier"), F.col("pattern"), F.col("action"))).alias("winner"))
    return found.join(winners, "rest", "left")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = ALLOW, indexed: int = INDEXED) -> DataFrame:
    """``pages`` with host, path, rule, pattern and verdict.

    rules: (tier int, pattern string, action string). Of the rules that fit, those of the lowest tier count, of these the longest
    pattern, of equally long ones the smallest. rule is the winner's pattern where it is of tier 0, pattern where it is of
    another, else null; verdict is its action, ``otherwise`` where no rule fits. Null URLs and those without ``://`` have an
    empty host and path, and hardly a rule fits them. A pattern given twice counts once, with its lowest tier and there its
    smallest action; null and empty patterns are left out. URLs are of any length and judged row by row; repeated rows and null
    ids stay. Columns named like the five results are replaced, all others pass through. Empty in, empty out.
    """
    names = [f"column {i}" for i in range(len(pages.columns))]
    url = names[pages.columns.index(url_col)]
    found = pages.toDF(*names).withColumn("rest", rest_of(F.col(f"`{url}`")))
    n_rules = rules.limit(indexed + 1).count()
    index = filed(found.select("rest"), rules, n_rules <= indexed)
    found = _by_index(found, index, n_rules) if n_rules <= indexed else _by_join(found, index)
    site = F.col("winner.tier") == 0
    results = {
        "host": host_of(F.col("rest")),
        "path": path_of(F.col("rest")),
        "rule": F.when(site, F.col("winner.pattern")),
        "pattern": F.when(~site, F.col("winner.pattern")),
        "verdict": F.coalesce("winner.action", F.lit(otherwise)),
    }
    kept = [F.col(f"`{n}`").alias(c) for n, c in zip(names, pages.columns, strict=True) if c.lower() not in results]
    return found.select(*kept, *[value.alias(name) for name, value in results.items()])


def _sql_regex(pattern: str) -> str:
    ends = pattern.endswith("|")
    kinds = {"*": ".*", "^": r"([^A-Za-z0-9_.%-]|\z)"} | {c: "\\" + c for c in "\\.+?(){}[]$|"}
    return "(?is)" + "".join(kinds.get(c, c) for c in pattern[: -1 if ends else None]) + (r"\z" if ends else "")


def _oracle() -> str:
    """DuckDB SQL that tries every rule on every URL."""
    sites = ", ".join(f"('{p}', '{a}')" for p, a in SITES)
    patterns = ", ".join(f"('{p}', '{_sql_regex(p)}', '{a}')" for p, a in PATTERNS)
    return f"""
WITH parsed AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
urls AS (SELECT page_id, host, path, host || substr(rest, length(host) + 1) AS rest FROM cut),
sites(site, action) AS (VALUES {sites}),
patterns(pattern, regex, action) AS (VALUES {patterns}),
by_site AS (SELECT DISTINCT ON (page_id) page_id, site, action FROM urls, sites
    WHERE (host = split_part(site, '/', 1) OR ends_with(host, '.' || split_part(site, '/', 1))) AND starts_with(path, substr(site, strpos(site, '/')))
    ORDER BY page_id, length(site) DESC, site),
by_pattern AS (SELECT DISTINCT ON (page_id) page_id, pattern, action FROM urls, patterns WHERE regexp_matches(rest, regex) ORDER BY page_id, length(pattern) DESC, pattern)
SELECT u.page_id, host, path, s.site AS rule, CASE WHEN s.site IS NULL THEN p.pattern END AS pattern, coalesce(s.action, p.action, '{ALLOW}') AS verdict
FROM urls u LEFT JOIN by_site s ON u.page_id = s.page_id LEFT JOIN by_pattern p ON u.page_id = p.page_id"""


ORACLE = _oracle()
