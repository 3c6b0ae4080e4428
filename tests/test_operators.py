"""Operators on small fixtures with known answers: ties, nulls, edges of windows, repeats."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import values as V
from tessera.operators import chains, facts, matching, sync, windows
from tessera.operators import predicates as P
from tessera.sources import tables
from tessera.streaming import events as E


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_nearest_match_ties_and_edges(spark):
    left = spark.createDataFrame([("a", 100, 1), ("a", 200, 2), ("b", 50, 3)], "k string, at long, id long")
    right = spark.createDataFrame([("a", 90, 10), ("a", 110, 11), ("a", 110, 9), ("a", 170, 12), ("b", 81, 13)], "k string, at long, id long")
    got = rows(matching.nearest_match(left, right, "k", "at", "id", 30, 30), "left_id", "right_id", "gap")
    assert got == [(1, 10, 10), (2, 12, 30)]


def test_band_pairs_edges(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 21, 3), ("b", 10, 4), ("a", 10, 5)], "k string, at long, id long")
    assert rows(matching.band_pairs(df, "k", "at", 10, "id"), "id_a", "id_b") == [(1, 2), (1, 5), (2, 5)]


def test_lifecycle_gap_terminal_and_reopening(spark):
    data = [("x", 0, 1, "open"), ("x", 10, 2, "closed"), ("x", 13, 3, "closed"), ("x", 14, 4, "open"), ("x", 115, 5, "open"), ("y", 1, 6, "open")]
    df = spark.createDataFrame([(*r, 1.0) for r in data], "k string, at long, id long, stage string, amount double")
    got = chains.lifecycle(df, ["k"], "at", "id", "stage", "amount", ["closed"], 100, 5)
    assert rows(got, "id", "chain", "closed", "latest", "chain_items") == [(1, 1, False, False, 3), (2, 1, True, False, 3), (3, 1, True, True, 3), (4, 2, False, True, 1), (5, 3, False, True, 1), (6, 1, False, True, 1)]


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")

    def totals(df):
        return df.groupBy("k").agg(F.count("*").alias("n"))

    assert rows(sync.changed_keys(old, new, ["k"]), "k") == [(1,), (3,), (4,)]
    assert rows(sync.refreshed(totals(old), old, new, ["k"], totals), "k", "n") == rows(totals(new), "k", "n")
    diff = sync.multiset_diff(old, new)
    assert rows(diff, "k", "kept", "inserted", "deleted") == [(1, 1, 0, 1), (2, 1, 0, 0), (3, 0, 0, 1), (4, 0, 1, 0)]


def test_fill_and_changes(spark):
    df = spark.createDataFrame([("a", 1, 5, None), ("a", 2, None, "x"), ("a", 3, None, None)], "k string, t int, p int, q string")
    assert rows(windows.fill_forward(df, "k", ["t"], ["p", "q"]), "t", "p", "q", F.array_join("filled_from", "+")) == [(1, 5, None, ""), (2, 5, "x", "p"), (3, 5, "x", "p+q")]
    same = spark.createDataFrame([("a", t, v) for t, v in enumerate([None, None, 1, 1, None])], "k string, t int, v int")
    assert rows(windows.changes(same, "k", ["t"], "v"), "t", "step") == [(0, 1), (2, 2), (4, 3)]


def test_versions_of_facts(spark):
    versions = spark.createDataFrame([("r", "1", "active"), ("r", "2", "candidate")], "extractor string, version string, status string")
    moved = facts.activate(versions, "r", "2")
    assert rows(moved, "version", "status") == [("1", "retired"), ("2", "active")]
    with pytest.raises(ValueError):
        facts.activate(versions, "r", "9")
    records = spark.createDataFrame([("r", "1", "e1", 0, "size", 2.0), ("r", "2", "e1", 0, "size", 3.0)], "extractor string, version string, event_id string, ordinal int, field string, value_num double")
    assert rows(facts.active(records, moved), "value_num") == [(3.0,)]
    again = facts.replaced(records, records.where("version = '2'").withColumn("value_num", F.lit(4.0)), ["extractor", "version", "event_id"])
    assert rows(again, "version", "value_num") == [("1", 2.0), ("2", 4.0)]


def test_values(spark):
    df = spark.createDataFrame([("1,234.5",), (".95",), ("5,46",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(V.parsed_number(F.col("x"))).collect()] == [1234.5, 0.95, None, None, None]
    nums = spark.createDataFrame([(1234.0,), (-0.0456789,), (0.0,), (None,)], "x double")
    assert [r[0] for r in nums.select(V.significant(F.col("x"), 3)).collect()] == [1230.0, -0.0457, 0.0, None]
    days = spark.createDataFrame([("2024-02-29",), ("March 5, 2024",), ("5 March 2024",), ("?",)], "x string")
    assert [str(r[0]) for r in days.select(V.lenient_date(F.col("x"))).collect()] == ["2024-02-29", "2024-03-05", "2024-03-05", "None"]
    text = spark.createDataFrame([("  -- Éa B! ",), ("!!",)], "x string")
    assert [r[0] for r in text.select(X.slug(F.col("x"))).collect()] == ["a-b", "release"]


def test_files_and_upsert(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_id": "1", "confidence": 0.5}\n{"event_id": "2", "confidence": 7}\n{broken\n{"event_id": null}\n')
    valid, bad = tables.envelopes(spark, str(tmp_path / "a.json"))
    assert rows(valid, "event_id") == [("1",)] and bad.count() == 3
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><guid>g</guid><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>U</title><pubDate>soon</pubDate></item></channel></rss>")
    items = tables.rss_items(spark, str(tmp_path / "f.xml"))
    assert rows(items, "title", F.date_format("published_at", "yyyy-MM-dd HH")) == [("T", "2024-03-05 10"), ("U", None)]
    old = spark.createDataFrame([(1, "approved", "x"), (2, "approved", "y")], "k int, status string, v string")
    new = spark.createDataFrame([(2, "pending", "z"), (3, "pending", "w")], "k int, status string, v string")
    assert rows(tables.upsert(old, new, ["k"], ["status"]), "k", "status", "v") == [(1, "approved", "x"), (2, "approved", "z"), (3, "pending", "w")]


def test_merging_sink(spark, tmp_path):
    sink = E.merging_sink(lambda n: str(tmp_path / f"v{n}"), ["k"], F.col("rank"), ["status"])
    sink(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, rank int, status string"), 0)
    sink(spark.createDataFrame([(1, 9, "c"), (2, 1, "d")], "k int, rank int, status string"), 1)
    assert rows(spark.read.parquet(str(tmp_path / "v1")), "k", "rank", "status") == [(1, 9, "b"), (2, 1, "d")]


def test_merging_sink_whatever_the_batches(spark, tmp_path):
    """The best row of a key stays if worse ones come later, in any order of the batches, and old versions go."""
    batches = [[(1, 5, "a"), (2, 1, "x")], [(1, 2, "b"), (3, 4, "y")], [(1, 9, "c"), (3, 3, "z")], [(1, 7, "d"), (2, 0, "w")]]
    for run, order in enumerate([(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)]):
        sink = E.merging_sink(lambda n, run=run: str(tmp_path / f"{run}-v{n}"), ["k"], F.col("rank"), [])
        for number, i in enumerate(order):
            sink(spark.createDataFrame(batches[i], "k int, rank int, v string"), number)
        sink(spark.createDataFrame(batches[order[-1]], "k int, rank int, v string"), 3)  # run again
        assert rows(spark.read.parquet(str(tmp_path / f"{run}-v3")), "k", "rank", "v") == [(1, 9, "c"), (2, 1, "x"), (3, 4, "y")]
        assert not (tmp_path / f"{run}-v1").exists() and (tmp_path / f"{run}-v2").exists()


def test_jaccard_pairs_over_all_sources(spark):
    import random

    from tessera.functions import text as X
    from tessera.operators import matching
    from tessera.plans import catalogue

    rng, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 60))]
        near = [*words[:-1], "other"]
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join(words)), (4 * i + 2, " ".join(near)), (4 * i + 3, " ".join(words[: rng.randint(1, len(words))]))]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (999, None)], "doc_id long, text string")
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    own = {i: rep[s] for i, s in sets.items() if s}
    reps = sorted(set(own.values()))
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])}
    words = X.words(docs.text)
    got = [(r.a, r.b, r.shared, r.together) for r in matching.jaccard_pairs(matching.shingle_classes(docs, "doc_id", words, 5), 5, 80).collect()]
    assert len(want) > 20 and len(got) == len(want) and set(got) == want
    assert {(r.doc_id, r.rep) for r in matching.shingle_members(docs, "doc_id", words, 5).collect()} == set(own.items())
    sources = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    assert any(sources[r.a] != sources[r.b] for r in catalogue.QUERIES["tx_jaccard_all"](spark, "/root/testdata/sf0.01").collect())


def test_months_of_all_orders(spark, tmp_path):
    """Every order counts, and months without orders are there with zero."""
    from tessera.plans import catalogue

    days = ["2023-11-30", "2023-12-01", "2023-12-31", "2024-03-01"]
    rows = spark.createDataFrame([(i, i, day) for i, day in enumerate(days)], "o_orderkey long, o_custkey long, o_orderdate string")
    rows.selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate as timestamp_ntz) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(catalogue.QUERIES["ag_gapfill_month_all"](spark, str(tmp_path)).collect(), key=lambda r: r.bucket)
    assert [r.n for r in got] == [1, 2, 0, 0, 1]
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert sum(r.n for r in catalogue.QUERIES["ag_gapfill_month_all"](spark, "/root/testdata/sf0.01").collect()) == orders


def test_slices_and_row_numbers(spark):
    import random

    random.seed(5)
    values = [random.choice([None, float("nan"), 1.5, 2.0, -3.0]) if i % 3 else random.uniform(-9, 9) for i in range(400)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    for parts in (1, 2, 7, 60):
        seen = P.sliced(rows, "v", parts).groupBy("_slice").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_slice").collect()
        assert len(seen) <= parts
        spans = [(r.a, r.b) for r in seen if r.a is not None]
        assert all(low[1] < high[0] for low, high in zip(spans, spans[1:]) if high[0] == high[0])
    numbered = P.row_numbers(rows, "v", F.col("id")).orderBy("place").collect()
    key = lambda r: (r.v is not None, r.v is not None and r.v != r.v, 0 if r.v is None or r.v != r.v else r.v, r.id)
    assert [r.place for r in numbered] == list(range(1, 401)) and [r.id for r in numbered] == [r.id for r in sorted(numbered, key=key)]
    placed = {(r.v if r.v is None or r.v == r.v else "nan"): r.place for r in P.ranks(rows, "v").collect()}
    assert placed["nan"] == 1 and placed[None] == 1 + sum(v is not None for v in values)
    assert placed[2.0] == 1 + sum(v is not None and (v != v or v > 2.0) for v in values)
    assert P.ranks(rows.limit(0), "v").collect() == [] and P.row_numbers(rows.limit(0), "v").collect() == []
