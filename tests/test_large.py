"""What larger tables need of single steps: figures beyond a million, rules read once, sizes of tasks."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import grids as G
from tessera.functions import readers as R
from tessera.functions.shingles import hash_sets, set_key
from tessera.operators import folds as O
from tessera.operators import matching as M
from tessera.plans import catalogue, releases


def test_labels_from_a_million_on_are_those_of_the_sql(spark, tmp_path):
    keys = [1, 2, 3, 98_999, 998_999, 999_000, 999_001, 999_002, 1_000_001, 1_199_999, 1_200_000]
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = duckdb.sql(catalogue.ORACLE_SQL["tx_labels"]).fetchall()
    got = catalogue.QUERIES["tx_labels"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and (1_000_001, None, "1001,001 oz") in want


def test_rules_read_a_text_once():
    said = str(R.traced(F.col("h"), F.col("b"), R.DOCUMENTS))
    assert said.count("[{};]") == 1 and said.count("[A-Z]{20}") == 1
    assert str(R.categorize(F.col("h"), F.col("b"), R.MINING)).count("intersected") == 1


def parsed(html):
    parser = G._Markup()
    parser.feed(html)
    parser.close()
    return [G.filled(rows) for rows in parser.done if any(rows)]


def test_tags_of_one_layout_are_read_once():
    page = "<p>n</p><table><tr><th rowspan=2>a<th colspan='2'>b<br>c</tr><tr><td>{}</td><td> x  {} </td></table>"
    G._layout.cache_clear()
    for k in range(50):
        assert G.markup_grids(page.format(k, k + 1)) == parsed(page.format(k, k + 1))
    assert G._layout.cache_info().misses == 1


def test_layouts_against_the_full_parser():
    dice = random.Random(5)
    parts = ["<table>", "<tr>", "<td>", "<TD colspan=2>", "<th rowspan = 2>", "<td rowspan='0'>", "</td>", "</tr>", "</table>", "<br>", "<br/>", "<b class=x>", "<td colspan>", "a", " 1 ", "x > y", "&amp;", "<", "<!-- <td> -->", "<script>", "</script>", '<i t="p>q">', "\n", "<p>", "</p>", "<td rowspan=\"3\" colspan=2>"]
    weights = [4 if "t" in p or p.strip().isalnum() else 1 for p in parts]
    for _ in range(3000):
        html = "<table><tr>" + "".join(dice.choices(parts, weights, k=dice.randrange(20)))
        assert G.markup_grids(html) == parsed(html), html


def test_tasks_of_chains_dont_grow_with_the_table(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id % 50 as k", "id % 97 as v", "id")
    monkeypatch.setattr(O, "TASK_ROWS", 100)
    chained = O.near_chains(rows, ["k"], "v", "id", 2)
    assert chained.rdd.getNumPartitions() == 20
    counted = chained.groupBy("k", "chain").agg(F.count("*").alias("n"), F.count_distinct("v").alias("m"))
    assert counted._jdf.queryExecution().sparkPlan().toString().count("Window") and counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(O, "TASK_ROWS", 10_000)
    assert O.near_chains(rows, ["k"], "v", "id", 2).rdd.getNumPartitions() == 8
    assert sorted(counted.collect()) == sorted(O.near_chains(rows, ["k"], "v", "id", 2).groupBy("k", "chain").agg(F.count("*"), F.count_distinct("v")).collect())


def test_hashes_tell_sets_of_shingles_apart():
    texts = ["a b c d", "d c b a", "a b c d a b c d", "a b", "", None, "b c d", "a b c", "x a b c d"] + [f"a b c w{i}" for i in range(600)]
    sets = [h.tolist() for h in hash_sets(pa.array(texts), 3)]
    of = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} if t else set()
    names = {}
    for text, hashes in zip(texts, sets, strict=True):
        assert hashes == sorted(set(hashes)) and len(hashes) == len(of(text))
        for shingle in of(text):
            names.setdefault(shingle, set()).add(next(iter(hash_sets(pa.array([" ".join(shingle)]), 3)))[0])
    assert all(len(h) == 1 for h in names.values()) and len(set.union(*names.values())) == len(names)
    assert [h.tolist() for h in hash_sets(pa.array(texts).slice(2, 5), 3)] == sets[2:7]
    keys = [set_key(h) for h in hash_sets(pa.array(texts[:9]), 3)]
    assert keys[3:6] == [None] * 3 and len(set(keys)) == 7


def test_headlines_that_meet_often_are_graded_once(spark, monkeypatch):
    import pandas as pd

    said = ["Acme drills 12 m at Aurora in the northern belt of the range", "Acme drills 12 m at Aurora in the northern belt of the range, and more", "Corporate update of the company", "corporate update of the company.", "Acme closes a placement of units", "Correction: Acme closes a placement of units", "", None]
    rows = spark.createDataFrame([(b, n, 1000 * n + 10 * i + (b or 0), h) for b in (1, 2, None) for n in (1, 2, 3, 5, None) if n for i, h in enumerate(said)] + [(1, None, 7, said[0])], "brand int, at int, id int, h string")
    left, right = rows.alias("x"), rows.alias("y")
    pairs = left.join(right, F.expr("x.brand = y.brand and x.at + 1 = y.at")).select("x.id", F.expr("y.id as other"), F.expr("x.h as a"), F.expr("y.h as b"))
    rated = pairs.withColumn("ratio", releases.R.sequence_ratio(F.lower("a"), F.lower("b")))
    whole = rated.select("id", "other", releases.R.headline_grade(F.col("a"), F.col("b"), F.col("ratio")).alias("grade"))
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 2 * 2 * len(said) ** 2 and {0, 1, 2} == {r[2] for r in want}
    graded = spark.sparkContext.accumulator(0)
    bounded = releases.R.ratio_from(releases.R.ALIKE).func

    def counted(least):
        def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
            graded.add(len(a))
            return bounded(a, b)

        return F.pandas_udf(ratio, "double")

    monkeypatch.setattr(releases.R, "ratio_from", counted)
    for most in (releases.BROADCAST_ROWS, 0):
        monkeypatch.setattr(releases, "BROADCAST_ROWS", most)
        got = releases.graded_pairs(rows, ["brand"], "at", "id", "h")
        assert sorted(map(tuple, got.collect())) == want
    assert graded.value == 2 * len(said) ** 2


def test_copies_at_other_brands_grade_no_more_headlines(spark, tmp_path, monkeypatch):
    import pandas as pd

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 40")
    copies = spark.range(40).crossJoin(part).withColumns({"p_partkey": F.col("p_partkey") + 1000 * F.col("id"), "p_brand": F.concat("p_brand", F.lit("/"), "id"), "p_size": F.lit(1) + F.col("p_partkey") % 2}).drop("id")
    copies.write.parquet(f"{tmp_path}/part.parquet")
    graded = spark.sparkContext.accumulator(0)

    def counted(least):
        def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
            graded.add(len(a))
            return pd.Series([0.0] * len(a))

        return F.pandas_udf(ratio, "double")

    monkeypatch.setattr(releases.R, "ratio_from", counted)
    pairs = catalogue.QUERIES["tx_headline_grade"](spark, str(tmp_path)).count()
    assert pairs > 20 * graded.value > 0


def near_copies(clusters, copies, words=200):
    """Documents of clusters of near copies: (doc_id, text)."""
    dice, rows = random.Random(8), []
    for c in range(clusters):
        base = [f"w{dice.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            said = list(base)
            for at in dice.sample(range(words), dice.randrange(3)):
                said[at] = f"v{dice.randrange(10**6)}"
            rows.append((len(rows), " ".join(said)))
    return rows


def similar(rows, length=5, percent=80):
    sets, names = {}, {}
    for k, text in sorted(rows):
        words = text.split()
        own = frozenset(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
        if own and names.setdefault(own, k) == k:
            sets[k] = own
    counts = [(a, b, len(x & y), len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b]
    return [c for c in counts if c[2] * 100 >= percent * c[3]]


def test_texts_of_near_copies_travel_once_for_a_cell(spark, monkeypatch):
    rows = near_copies(6, 30)
    want = similar(rows)
    classes = M.shingle_classes(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), 5)
    met = M._met(M._prefixes(classes, 5, 80), 80)
    sizes = classes.select("rep", F.substring_index("key", "-", -1).cast("bigint").alias("n"))
    pairs, places = M._places(met, sizes)
    documents = classes.count()
    assert len(want) > 3 * documents and {c[:2] for c in want} <= {(r.a, r.b) for r in pairs.collect()}
    assert documents <= places.count() < 2 * documents
    most = []
    for block, many in ((1 << 21, 1 << 18), (500, 1 << 18), (1, 1 << 18), (1 << 21, 50)):
        monkeypatch.setattr(M, "CELL_SHINGLES", block)
        monkeypatch.setattr(M, "CELL_PAIRS", many)
        pairs, places = M._places(met, sizes)
        held = {(r.cell, r.rep) for r in places.collect()}
        dealt = pairs.collect()
        assert all((r.cell, r.a) in held and (r.cell, r.b) in held for r in dealt) and len({(r.a, r.b) for r in dealt}) == len(dealt)
        most.append(max(Counter(r.cell for r in dealt).values()))
        assert sorted(map(tuple, M.jaccard_pairs(classes, 5, 80).collect())) == sorted(want)
    assert most[0] > 200 and most[3] < 100  # one large cluster is no single task


def test_no_text_is_shuffled_for_classes_and_pairs_of_any_side(spark, monkeypatch):
    rows = near_copies(4, 12) + [(1000 + k, t) for k, t in near_copies(4, 12)] + [(3000, ""), (3001, None), (None, "a b c d e f"), (3002, "a b c d e f"), (3002, "a b c d e f"), (3003, "a b c d e g f")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(8)
    want = sorted(similar([r for r in rows if r[0] is not None and r[1]]))
    found = []
    for most in (M.BROADCAST_ROWS, 40, 0):  # few copies; few of either; many of both
        monkeypatch.setattr(M, "BROADCAST_ROWS", most)
        classes = M.shingle_classes(docs, "id", F.col("text"), 5)
        plan = classes._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        found.append(sorted({r.rep for r in classes.collect()}))
        assert sorted(map(tuple, M.jaccard_pairs(classes, 5, 80).collect())) == want
        strings = classes.select(F.col("rep").cast("string").alias("rep"), "text", "key")
        assert {tuple(sorted((int(r.a), int(r.b)))) for r in M.jaccard_pairs(strings, 5, 80).collect()} == {c[:2] for c in want}
    assert found[0] == found[1] == found[2] and 3002 in found[0] and 3000 not in found[0]


def test_texts_travel_packed(spark):
    import zlib

    said = ["a b c", "é ü", "", "x " * 5000]
    rows = spark.createDataFrame(list(enumerate(said)), "rep long, text string")
    small = {r.rep: bytes(r.text) for r in M._packed(rows).collect()}
    assert [zlib.decompress(small[k]).decode() for k in range(len(said))] == said and len(small[3]) < 500
