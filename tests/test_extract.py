"""Readers need no second pass over their texts, and places hold in odd texts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions.extractors import READERS, extracted
from tessera.functions.measures import first_money, money, spans
from tessera.functions.releases import hidden_address
from tessera.functions.values import lenient_date, significant
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rd_debt", "rd_mine_dev", "rd_drill_results", "rd_royalty_terms"])
def test_no_text_is_joined_or_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_kept_columns_come_along(spark):
    rows = spark.createDataFrame([(1, "It signs a C$1.5 million term loan at 7% due 2026-01-02. ok"), (2, None)], "id int, body string")
    got = extracted(rows, READERS["debt"], "id", "body", keep=("body",)).collect()
    assert [(r.field, r.value_num, r.value_text, r.unit) for r in got] == [("stage", None, "signs", None), ("amount", 1.5e6, "C$1.5 million", "CAD"), ("instrument", None, "term loan", None), ("rate", 7.0, "7", None), ("matures", None, "2026-01-02", None)]
    assert all(r.body[r.span_start : r.span_end] == r.value_text for r in got)


def test_places_in_texts_with_the_mark(spark):
    texts = ["ab1cd22", "\x0012\x00 7\x00", "none", "", "\x00", "9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), r"\d+").alias("s")).collect()
    import re

    assert [[(x.found, x.start, x.end) for x in r.s] for r in rows] == [[(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", r.t)] for r in rows]


def test_first_amounts_are_those_of_the_list(spark):
    texts = ["US$1.5 million", "paid C$ 2, 000 and A$3", "2,000,000 million", "$2,000,000 million", "none", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(first_money(F.col("t")).alias("a"), F.get(money(F.col("t")), F.lit(0)).alias("b")).collect()
    assert [(r.a.value, r.a.currency) for r in rows] == [(r.b.value, r.b.currency) if r.b else (None, None) for r in rows]


def test_dates_of_each_outline(spark):
    texts = ["2026-01-02", "2026/01/02", "May 3, 2026", "3 may 2026", "01/02/2026", "1/2/2026", "2026-13-02", "x", "", "2026-01-02 ", "+12026-01-02"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    formats = ["yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy"]
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)).cast("date") for f in formats])
    got = rows.select("t", F.date_format(lenient_date(F.col("t")), "yyyy-MM-dd").alias("a"), F.date_format(plain, "yyyy-MM-dd").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.a for r in got][:5] == [str(d) for d in (dt.date(2026, 1, 2), dt.date(2026, 1, 2), dt.date(2026, 5, 3), dt.date(2026, 5, 3), dt.date(2026, 1, 2))]


def test_a_hidden_code_is_read_once(spark):
    import time

    key = 7
    code = lambda t: f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in t)
    long = "a" * 1500 + "@mail.example.com"
    rows = spark.createDataFrame([(long,), ("no address",)], "t string")
    hidden = F.concat(F.lit("07"), F.array_join(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.lpad(F.hex(F.ascii(F.substring("t", i, F.lit(1))).bitwiseXOR(F.lit(key))), 2, "0")), ""))
    assert [r.c.lower() for r in rows.select(hidden.alias("c")).collect()] == [code(long), code("no address")]
    begun = time.monotonic()
    assert [r.a for r in rows.select(hidden_address(F.lower(hidden)).alias("a")).collect()] == [long, None]
    assert time.monotonic() - begun < 4


def test_figures_on_a_half_go_up(spark):
    halves = [m * 10**k + 10**k // 2 for k in range(1, 8) for m in range(100, 1000, 7)]
    rows = spark.createDataFrame([(float(c),) for c in halves], "c double").select("c", significant(F.col("c"), 3).alias("s")).collect()
    assert [r.s for r in rows] == [float((c // 10 ** (len(str(c)) - 3) + 1) * 10 ** (len(str(c)) - 3)) for c in halves]


def test_deals_of_one_shape_are_put_together_once():
    from tessera.functions import deals

    deals._ways.cache_clear()
    said = [(n, t) for n, t in zip((5, 70, 900), (20, 50, 7), strict=True)]
    got = [deals.deals_of(f"Acme closed {n} units at a price of $0.{t} per unit. It cancels {n + 1} notes.") for n, t in said]
    assert [[d.slots for d in ds] for ds in got] == [[{"step": "closed", "count": float(n), "kind": "units", "price": float(f"0.{t}")}, {"step": "cancelled", "count": n + 1.0, "kind": "notes"}] for n, t in said]
    assert deals._ways.cache_info().misses == 3  # two shapes and the sentence without tokens


def test_equal_values_still_part_from_unequal_ones():
    from tessera.functions.deals import deals_of

    one, two = deals_of("Acme sells 5 units. It sells 5 units for $9."), deals_of("Acme sells 5 units. It sells 6 units for $9.")
    assert len(one) == 1 and len(two) == 2


def test_bounded_ratios_grade_alike(spark):
    from tessera.functions import releases as R

    said = ["Acme drills 12 m", "acme drills 12 n", "", None, "été Ā", "Acme closes a placement", "Acme closes a placements", "b" * 40, "b" * 39 + "c"]
    pairs = spark.createDataFrame([(a, b) for a in said for b in said], "a string, b string")
    for r in pairs.select(R.sequence_ratio("a", "b").alias("x"), R.ratio_from(0.9)("a", "b").alias("y")).collect():
        assert r.y == (r.x if r.x >= 0.9 else 0.0)


def test_copies_of_headlines_make_no_pairs(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    copies = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 10**6))
    copies.write.parquet(f"{tmp_path}/part.parquet")
    once, twice = (sorted(map(tuple, catalogue.QUERIES["tx_headline_grade"](spark, d).collect())) for d in (SF, str(tmp_path)))
    assert once == twice
    members = catalogue.QUERIES["tx_headline_members"](spark, str(tmp_path)).collect()
    stands = {r.p_partkey: r.representative for r in members}
    assert len(stands) == copies.count() and all(stands[k + 10**6] == stands[k] for k in list(stands) if k < 10**6)


def test_places_in_long_texts(spark):
    import re

    text = "ab1cd22 " * 900
    (row,) = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), r"\d+").alias("s")).collect()
    assert [(x.found, x.start, x.end) for x in row.s] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", text)]
