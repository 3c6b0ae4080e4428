"""Expressions and small operators on edge rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import extractors as E
from tessera.functions import headlines as H
from tessera.functions import measures as M
from tessera.functions.readers import Reader, Rule, read
from tessera.operators import predicates as P
from tessera.plans.lists import page
from tessera.sources import tables as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head().x


def test_spans_are_true_places(spark):
    for text in ("a1 b22 a1", "1", "", "no digit", "12 12"):
        found = one(spark, M.spans(F.col("t"), r"\d+"), t=text)
        assert [text[x.start : x.end] for x in found] == [x.found for x in found]
    assert [(x.start, x.end) for x in one(spark, M.spans(F.col("t"), r"\d+"), t="12 12")] == [(0, 2), (3, 5)]
    assert one(spark, M.spans(F.col("t"), r"\d+"), t=None) is None


def test_money(spark):
    found = one(spark, M.money(F.col("t")), t="US$1,250.5 million, C$3, 500,000 and £7 k, USD 12; $2,000,000 million. Nothing: 5 million")
    assert [(x.value, x.currency) for x in found] == [(1250.5e6, "USD"), (3_500_000.0, "CAD"), (7000.0, "GBP"), (12.0, "USD"), (2_000_000.0, None)]


def test_readers_on_edge_texts(spark):
    texts = [(1, None), (2, ""), (3, "Hole A-1 intersected 5 m of 2.5 g/t gold. Hole A-1 intersected 5 m of 2.5 g/t gold from 12 m."), (None, "Hole B-2 returned 1,5 metres of 3 % Cu"), (3, "x " * 50_000 + "Hole C-9 cut 7 m of 1 g/t Au")]
    rows = spark.createDataFrame(texts, "id long, body string")
    facts = E.extracted(rows, E.READERS["drill_results"], "id", "body").collect()
    held = {(r.id, r.ordinal, r.field): r for r in facts}
    assert held[3, 0, "hole"].value_text in ("A-1", "C-9") and held[3, 1, "from"].value_num == 12.0
    assert held[None, 0, "length"].value_num is None and held[None, 0, "grade"].value_num == 3.0
    assert E.extracted(rows.limit(0), E.READERS["management"], "id", "body").collect() == []


def test_equal_finds_have_their_own_places(spark):
    rows = spark.createDataFrame([(1, "5 kg and 5 kg")], "id long, t string")
    facts = read(rows, [Reader("r", "1", "T", (Rule("mass", r"(\d+) kg", "kg"),))], "id", "t").collect()
    assert [(r.ordinal, r.span_start, r.span_end, r.value_num) for r in facts] == [(0, 0, 4, 5.0), (1, 9, 13, 5.0)]


def test_names_and_headlines(spark):
    assert one(spark, H.same_name(F.col("a"), F.col("b")), a="Gold Inc.", b="Gold Ridge Ltd") is False
    assert one(spark, H.same_name(F.col("a"), F.col("b")), a="Élan Corp", b="ELAN") is True
    assert one(spark, H.covers(F.col("a"), F.col("b")), a="", b="") is True and one(spark, H.covers(F.col("a"), F.col("b")), a="", b="gate") is False
    assert one(spark, H.headline_tokens(F.col("a")), a=None) == []


def test_hidden_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (None, "b")], "k int, s string")
    hide = lambda *e: sorted(rows.count() - len(P.hidden(rows, spark.createDataFrame(list(e), "k int, s string")).collect()) for _ in [0])[0]
    assert hide((None, "a")) == 2 and hide((3, None)) == 1 and hide((1, "b")) == 0 and hide((1, "a"), (None, "b")) == 2
    assert P.hidden(rows, spark.createDataFrame([], "k int, s string")).count() == 4 and P.hidden(rows, spark.createDataFrame([(None, None)], "k int, s string")).count() == 0


def test_ranks(spark):
    rows = spark.createDataFrame([(v,) for v in (5, 3, 5, 1, 3, 3)], "v int")
    assert {r.v: r.place for r in P.ranks(rows, "v").collect()} == {5: 1, 3: 3, 1: 6}


def test_pages_are_clamped(spark):
    rows = spark.range(500)
    assert page(rows, ["id"], 0, 0).count() == 1 and page(rows, ["id"], -3, 10_000).count() == 200 and page(rows, ["id"], 99).count() == 0


def test_unknown_sources_and_broken_envelopes(spark, tmp_path):
    with pytest.raises(KeyError, match="rss"):
        T.read_source(spark, "nothing", str(tmp_path))
    (tmp_path / "x.json").write_text('{"event_id": "1", "confidence": 0.5}\nnot json\n{"event_id": null}\n{"event_id": "2", "confidence": 7}\n')
    fine, aside = T.envelopes(spark, str(tmp_path))
    assert [r.event_id for r in fine.collect()] == ["1"] and aside.count() == 3
