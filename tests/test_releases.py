"""Matches and markup that SQL can't say, against plain Python."""

import difflib
import re

from pyspark.sql import functions as F

from tessera.functions import headlines as H
from tessera.functions import releases as R
from tessera.plans import catalogue
from tessera.sources.tables import table

SF = "/root/testdata/sf0.001"


def tokens(h):
    return [w for w in re.sub("[^a-z0-9]+", " ", h.lower()).split() if w]


def notice(h):
    w = tokens(h.split(":")[0])
    return 0 < len(w) <= 3 and set(w) <= set(H.NOTICES)


def steps(t):
    return {m[1] for w in t if (m := re.match(f"({'|'.join(H.STEPS)}){H.STEP_ENDINGS}$", w))}


def grade(a, b):
    if notice(a) or notice(b):
        return 0
    ta, tb = tokens(a), tokens(b)
    k = min(len(ta), len(tb))
    marked = lambda t: [w for w in t[:k] if re.search(f"[0-9]|^({H.ORDINAL})$", w) or w in H.MONTH_NAMES]
    if not k or marked(ta) != marked(tb) or steps(ta) != steps(tb):
        return 0
    own = {w for w in min(ta, tb, key=len) if w not in {*H.STOPS, *H.GENERAL, *H.NOTICES}}
    goes_on = ta[:k] == tb[:k] and len(" ".join(ta[:k])) >= R.LONG_BEGINNING
    if len(own) >= R.TELLING and (goes_on or ta == tb or difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio() >= R.ALIKE):
        return 2
    return int(ta == tb)


HEADLINES = [
    "Acme closes first tranche of placement", "Acme closes second tranche of placement", "Acme announces a placement of units", "Acme closes a placement of units", "Acme drills 12 m at Aurora in the northern belt of the range",
    "Acme drills 12 m at Aurora in the northern belt of the range, and more", "Acme drills 15 m at Aurora in the northern belt of the range", "Corporate update of the company", "Corporate update of the company.", "Short one", "Twelve chars", "twelve chars!",
    "", "Correction: Acme drills 12 m at Aurora in the northern belt of the range", "A letter to the holders of Acme shares", "A letter to the holders of Acme share",
]


def test_headline_grades(spark):
    pairs = spark.createDataFrame([(a, b) for a in HEADLINES for b in HEADLINES], "a string, b string")
    rated = pairs.withColumn("ratio", R.sequence_ratio(F.lower("a"), F.lower("b")))
    got = rated.select("a", "b", R.headline_grade(F.col("a"), F.col("b"), F.col("ratio")).alias("g")).collect()
    assert {(r.a, r.b): r.g for r in got} == {(a, b): grade(a, b) for a in HEADLINES for b in HEADLINES}
    assert {0, 1, 2} == {r.g for r in got}


def test_headline_grades_of_the_table(spark):
    names = {r.p_partkey: f"Acme Mining of the North {r.p_name} program at its {r.p_type} property" for r in table(spark, SF, "part").collect()}
    for r in catalogue.QUERIES["tx_headline_grade"](spark, SF).collect():
        assert r.grade == grade(names[r.p_partkey], names[r.other])


def test_same_bodies(spark):
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w][:300]
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    first, want = {}, {}
    for i in sorted(docs):
        r = docs[i]
        w = words(r.text or "")
        if len(w) < 40:
            continue
        key = (r.source, r.lang, tuple(w[:3]))
        if key in first:
            ratio = difflib.SequenceMatcher(None, words(docs[first[key]].text), w, autojunk=False).ratio()
            if ratio >= 0.8:
                want[i] = (first[key], ratio)
        else:
            first[key] = i
    got = {r.doc_id: (r.first_id, r.ratio) for r in catalogue.QUERIES["tx_same_body"](spark, SF).collect()}
    assert got == want


def test_sanitised_markup(spark):
    cases = {
        "<p>a &lt; b</p>": "<p>a &lt; b</p>", '<a href="JaVa\nScript:x" class="c" onclick="y">t</a>': '<a class="c">t</a>', "<script>x</script>ok<style>p{}</style>": "ok", "<b>un<i>closed": "<b>un<i>closed",
        '<img src="data:x" alt="&quot;q"><br/>': '<img alt="&quot;q"><br>', '<custom><p title="x">in</p></custom>': '<p title="x">in</p>', "": "", "<svg><p>gone</p></svg>left": "left", '<a href="/x?a=1&amp;b=2">r</a>': '<a href="/x?a=1&amp;b=2">r</a>',
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate([*cases, None])], "i int, h string")
    got = [r.s for r in rows.orderBy("i").select(R.sanitized("h").alias("s")).collect()]
    assert got == [*cases.values(), None]


def test_dates_and_addresses_on_edge_rows(spark):
    rows = spark.createDataFrame([(None,), ("",), ("no date",), ("February 30, 2024 - x",)], "b string").select(R.dateline(F.col("b"), F.lit("2024-03-01").cast("date")).alias("x"))
    assert {(str(r.x.day), r.x.how) for r in rows.collect()} == {("2024-03-01", "upload")}
    codes = spark.createDataFrame([(None,), ("",), ("0",), ("zz",), ("0700",)], "c string").select(R.hidden_address(F.col("c")).alias("a"))
    assert {r.a for r in codes.collect()} == {None}
    assert spark.range(1).select(R.primary_project(F.lit("nothing here")).alias("p")).head().p is None
