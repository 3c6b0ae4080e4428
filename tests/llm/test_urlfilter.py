import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import urlfilter

SITES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("b.c/", "block"), ("a.b.c/", "allow")]
PATTERNS = [("*casino*", "block"), ("/login^", "block"), ("*.zip|", "block"), ("/a|b", "block"), ("*^Deep*end^", "allow"), ("*casino-history*", "allow"), ("(x)+", "block")]
URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "HTTP://Example.ORG/es/x", "http://a.example.org/es", "http://example.org/en/10", "http://example.org/en/2",
    "http://notexample.org/es/", "http://xorg/", "http://x.a.b.c/y", "http://b.c/", "http://b.c?q=/", "http://u.net/Casino#x", "http://u.net/casino-history", "http://u.net/login", "http://u.net/login?x",
    "http://u.net/loginx", "http://u.net/x.zip", "http://u.net/x.zip?y", "http://u.net/x.ZIP", "http://u.net/q?u=/a|b", "http://u.net/a", "http://u.net/deep/very/END/", "http://u.net/deep.end",
    "http://u.net/x\n", "http://u.net/x.zip\n", "http://ü.org/", "http://ÄÖ.org/es", "http://(x)+/", "http://(x)+", "x://y://org/", "http://org\n/", "http://u.net/" + "a/" * 20000 + "casino", "http://\u212aasino.org", "http://u.net/\u212acasino",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    rest = lower + rest[len(host) :]
    fits = []
    for pattern, action in SITES:
        at, _, under = pattern.partition("/")
        if (lower == at or lower.endswith("." + at)) and path.startswith("/" + under):
            fits.append((0, -len(pattern), pattern, action))
    for pattern, action in PATTERNS:
        body = pattern[:-1] if pattern.endswith("|") else pattern
        regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body) + (r"\Z" if body != pattern else "")
        if pattern[0] in "*/" and re.search(regex, rest, re.I | re.S | re.A) or pattern[0] not in "*/" and re.match(r"(?:[^/?#]*\.)?" + regex, rest):
            fits.append((1, -len(pattern), pattern, action))
    tier, _, pattern, action = min(fits, default=(None, 0, None, "allow"))
    return lower, path, pattern if tier == 0 else None, pattern if tier == 1 else None, action


@pytest.mark.parametrize("indexed", [100, 2])
def test_rules_against_brute_force(spark, indexed):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[8]), (8, URLS[8])], "page_id long, url string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, SITES, PATTERNS), indexed=indexed).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.pattern, r.verdict) == expected(r.url), r.url[:100]


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.org/x",)] * 3 + [("b.example.net/es/",)] * 2, "rest string")
    filed = urlfilter.filed(urls, urlfilter.rule_table(spark, [("example.org/es/", "block"), ("example.org/e", "block")], [("*es*", "allow"), ("*^x^example^", "allow")]), True)
    assert {r.pattern: r.token for r in filed.collect()} == {"example.org/es/": "es", "example.org/e": "org", "*es*": "", "*^x^example^": "x"}
    assert {r.pattern: r.token for r in urlfilter.filed(urls, urlfilter.rule_table(spark, [("example.org/es/", "block")], []), False).collect()} == {"example.org/es/": "es"}


def test_edge_tables(spark):
    rules = urlfilter.rule_table(spark, [("org/", "allow"), ("org/", "block")], [("org/", "block"), ("", "block")])
    pages = spark.createDataFrame([("http://org/", "h", "r", 7, "w")], "url string, HOST string, rest string, `column 0` int, winner string")
    got = urlfilter.judge(pages, rules)
    assert got.columns == ["url", "rest", "column 0", "winner", "host", "path", "rule", "pattern", "verdict"]
    assert tuple(got.head()) == ("http://org/", "r", 7, "w", "org", "/", "org/", None, "allow")
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert urlfilter.judge(pages, urlfilter.rule_table(spark, [], []), otherwise="block").head().verdict == "block"


def test_plan_is_native_and_shuffles_no_url(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urlfilter.judge(pages, urlfilter.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
