"""Requests: checks of parameters, dates, pages, flagged rows, groups, the border, on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import requests as R

TODAY = dt.date(2024, 3, 1)
CONTEXT = R.Context(TODAY)


@pytest.fixture(scope="module")
def rows(spark):
    day = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    data = [
        (1, "AB.V", None, day(2, 28), 5.0, "Gold%Rush", ["a", "b"]),
        (2, "AB.US", ["XY.TO"], day(2, 29, 23), 9.0, "silver", ["b"]),
        (3, "XY.TO", None, day(3, 1), None, None, None),
        (4, "XY.TO", ["AB.V"], day(1, 1), 2.0, "", []),
        (5, None, None, None, 100.0, "GOLD", ["c"]),
        (6, "ABC.V", None, day(2, 28), 5.0, "tin", ["a"]),
    ]
    return spark.createDataFrame(data, "id int, ticker string, additional array<string>, at timestamp_ntz, size double, text string, tags array<string>")


@pytest.fixture(scope="module")
def listing():
    return R.Listing(
        key="id",
        date="at",
        params={"ticker": R.company("ticker", "additional"), "tag": R.any_of("tags", ("a", "b", "c")), "person": R.holds("text"), "least": R.at_least("size"), "big": R.switch(F.col("size") > 4), "universe": R.universe("ticker"), "metal": R.family("text", {"au": ("GOLD", "Gold%Rush"), "ag": ("silver",)})},
        sorts={"id": R.Sort((F.col("id"),)), "size": R.Sort((F.desc_nulls_last("size"), F.col("id")), True)},
        checks={"huge": F.col("size") > 50, "empty": F.col("text") == ""},
        include={"self": lambda keys: keys.withColumn("twice", F.col("id") * 2)},
        dims={"ticker": F.col("ticker")},
        most=4,
    )


def ids(listing, rows, context=CONTEXT, **request):
    return [r.id for r in R.ask(listing, rows, request, context).items.collect()]


@pytest.mark.parametrize("request_", [{"nothing": "1"}, {"sort": "name"}, {"page": "x"}, {"limit": "1.5"}, {"since": "2024-02-30"}, {"days": "0"}, {"since": "2024-03-02", "until": "2024-03-01"}, {"tag": "a,z"}, {"least": "much"}, {"big": "maybe"}, {"metal": "pt"}])
def test_bad_requests(listing, rows, request_):
    with pytest.raises(R.BadRequest):
        R.ask(listing, rows, request_, CONTEXT)


def test_dates_are_whole_days_and_days_only_shortens(listing, rows):
    assert ids(listing, rows, until="2024-02-29", since="2024-02-28") == [1, 2, 6]
    assert ids(listing, rows, since="2024-01-01", days="1") == [2, 3]
    assert ids(listing, rows, since="2024-03-01", days="400") == [3]
    assert ids(listing, rows, days="99999999") == [1, 2, 3, 4]  # a row without a date isn't in any range
    assert ids(listing, rows, until="9999-12-31") == [1, 2, 3, 4, 5, 6][:4]


def test_pages_and_limits(listing, rows):
    assert ids(listing, rows, limit="100") == [1, 2, 3, 4] and ids(listing, rows, limit="-3") == [1]
    assert ids(listing, rows, limit="4", page="2") == [5, 6] and ids(listing, rows, page="-9", limit="2") == [1, 2]
    assert ids(listing, rows, limit="2", offset="3") == [4, 5] and ids(listing, rows, page="50") == []
    answer = R.ask(listing, rows, {"limit": "2", "tag": " "}, CONTEXT)
    assert [r.total for r in answer.items.collect()] == [6, 6]
    assert R.ask(listing, rows.limit(0), {}, CONTEXT).items.collect() == [] and R.ask(listing, rows.limit(0), {}, CONTEXT).facets().collect() == []


def test_flagged_rows_leave_rankings_only(listing, rows):
    got = R.ask(listing, rows, {"sort": "size", "limit": "4"}, CONTEXT).items.collect()
    assert [(r.id, r.unranked, r.check) for r in got] == [(2, False, []), (1, False, []), (6, False, []), (3, False, [])]
    assert ids(listing, rows, sort="size", offset="4") == [5, 4]
    assert [(r.id, r.unranked, r.check) for r in R.ask(listing, rows, {"offset": "3", "limit": "2"}, CONTEXT).items.collect()] == [(4, False, ["empty"]), (5, False, ["huge"])]


def test_filters(listing, rows):
    assert ids(listing, rows, tag="A,c") == [1, 5, 6]
    assert ids(listing, rows, person="%gold_") == [1, 5] and ids(listing, rows, person="%_%") == [1, 2, 3, 4]
    assert ids(listing, rows, least="5") == [1, 2, 5, 6] and ids(listing, rows, big="no") == [1, 2, 3, 4] and ids(listing, rows, big="on") == [1, 2, 5, 6]
    assert ids(listing, rows, metal="AU,ag") == [1, 2, 5]


def test_companies_and_border(listing, rows, spark):
    assert ids(listing, rows, ticker="AB.V") == [1, 4] and ids(listing, rows, ticker="ab-us") == [2] and ids(listing, rows, ticker="XY.TO") == [2, 3, 4]
    quiet = R.Context(TODAY, {}, spark.createDataFrame([("AB.V",)], "ticker string"))
    assert ids(listing, rows, quiet, ticker="AB") == [1, 2, 4]  # one side only among the listings: no clash


def test_universes(listing, rows, spark):
    keys = spark.createDataFrame([("AB.V",), ("AB.V",), (None,)], "ticker string")
    context = R.Context(TODAY, {"some": keys, "none": keys.limit(0)})
    assert ids(listing, rows, context, universe="some") == [1]
    assert ids(listing, rows, context, universe="none") == [1, 2, 3, 4] and ids(listing, rows, context, universe="unheard") == [1, 2, 3, 4]


def test_included_rows_facets_and_single_items(listing, rows):
    answer = R.ask(listing, rows, {"limit": "2", "page": "2"}, CONTEXT)
    assert sorted((r.id, r.twice) for r in answer.included("self").collect()) == [(3, 6), (4, 8)]
    assert {(r.facet, r.value): r.n for r in answer.facets().collect()} == {("ticker", "AB.V"): 1, ("ticker", "AB.US"): 1, ("ticker", "XY.TO"): 2, ("ticker", None): 1, ("ticker", "ABC.V"): 1}
    with pytest.raises(R.BadRequest):
        answer.included("others")
    assert [r.check for r in R.one(listing, rows, 5).collect()] == [["huge"]] and R.one(listing, rows, 77).collect() == []


def test_groups_are_made_before_their_filters(spark):
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 5), (None, "y", 7)], "id int, kind string, n int")
    grouped = lambda r: r.groupBy("id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    listing = R.Listing("id", {"kind": R.any_of("kinds", groups=True), "row": R.one_of("kind")}, {"id": R.Sort((F.asc_nulls_last("id"),))}, grouped=grouped)
    assert [(r.id, r.n) for r in R.ask(listing, rows, {"kind": "x"}, CONTEXT).items.collect()] == [(1, 3), (2, 5)]
    assert [(r.id, r.n) for r in R.ask(listing, rows, {"row": "x"}, CONTEXT).items.collect()] == [(1, 1), (2, 5)]
