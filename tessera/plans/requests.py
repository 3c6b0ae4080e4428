"""Parameterised reads over the driver's tables: trades by line, deals by state, users by what they did, turns by speaker, a
calendar of shipments, documents by source. Each query is one request, with its parameters as a caller gives them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import requests as R
from tessera.operators.predicates import open_state
from tessera.plans.portal import TICKER_SQL, tickers
from tessera.plans.registry import query
from tessera.sources.tables import micros, table

TODAY = dt.date(1999, 7, 1)
FAMILIES = {"bulk": ("ECONOMY", "LARGE"), "fine": ("SMALL", "PROMO"), "plain": ("MEDIUM", "STANDARD")}
MORE_SQL = "CASE WHEN c_custkey % 3 = 0 THEN ['C' || (c_custkey % 7) || '.V', 'ZZ.TO'] END"


def _best(rows):
    """An order with its dearest line among those asked for."""
    place = F.struct("l_extendedprice", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))
    best = F.max_by(F.struct("l_partkey", "l_linenumber", "l_extendedprice", "l_quantity"), place).alias("best")
    same = [F.first(c).alias(c) for c in ("ticker", "o_orderdate", "o_orderstatus", "o_totalprice")]
    items = rows.groupBy("o_orderkey").agg(best, F.count("*").alias("n_lines"), *same)
    return items.withColumns({"price": F.col("best.l_extendedprice"), "length": F.col("best.l_quantity"), "grade": F.col("best.l_extendedprice") / F.col("best.l_quantity")})


def _lines(d):
    return lambda keys: table(keys.sparkSession, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(keys, "o_orderkey", "left_semi")


def trades(d: str) -> R.Listing:
    newest = (F.desc("o_orderdate"), F.desc("o_orderkey"))
    return R.Listing(
        key="o_orderkey",
        date="o_orderdate",
        params={"ticker": R.company("ticker", "additional"), "type": R.family("p_type", FAMILIES), "status": R.one_of("o_orderstatus", ("O", "F", "P")), "universe": R.universe("ticker"), "price": R.at_least("price", groups=True)},
        sorts={"date": R.Sort(newest), "value": R.Sort((F.desc("price"), *newest), True), "grade": R.Sort((F.desc("grade"), *newest), True), "length": R.Sort((F.desc("length"), *newest), True)},
        grouped=_best,
        checks={"dear": F.col("price") > 95_000, "thin": F.col("length") < 2, "below": F.col("price") > F.col("o_totalprice")},
        include={"lines": _lines(d)},
        dims={"status": F.col("o_orderstatus"), "ticker": F.col("ticker"), "lines": F.col("n_lines")},
    )


def trade_rows(spark, d):
    customers = tickers(spark, d).select(F.col("c_custkey").alias("o_custkey"), "ticker", "additional")
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return lines.join(table(spark, d, "orders"), "o_orderkey").join(customers, "o_custkey").join(parts, "l_partkey")


def context(spark, d) -> R.Context:
    rich = tickers(spark, d).where("c_acctbal > 5000").select("ticker")
    return R.Context(TODAY, {"rich": rich, "none": rich.limit(0)}, tickers(spark, d))


def _shown(items):
    return items.select("o_orderkey", "ticker", micros(F.col("o_orderdate")).alias("ordered_at"), F.col("best.l_partkey").alias("best_part"), F.col("best.l_linenumber").alias("best_line"), "price", "length", "grade", "n_lines", F.array_join("check", "|").alias("checks"), "unranked", "total")


def _trades_sql(rows: str, order: str, page: str, groups: str = "true") -> str:
    return f"""
WITH comp AS (SELECT *, {TICKER_SQL} AS ticker, {MORE_SQL} AS additional FROM customer),
clash AS (SELECT upper(split_part(ticker, '.', 1)) AS bare FROM comp GROUP BY 1 HAVING bool_or(upper(ticker) LIKE '%.US') AND bool_or(upper(ticker) NOT LIKE '%.US')),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY o_orderkey) AS n_lines
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN comp ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE {rows}),
i AS (SELECT o_orderkey, ticker, o_orderdate, o_orderstatus, l_partkey AS best_part, l_linenumber AS best_line, l_extendedprice AS price, l_quantity AS length, l_extendedprice / l_quantity AS grade, n_lines,
 concat_ws('|', CASE WHEN l_extendedprice > 95000 THEN 'dear' END, CASE WHEN l_quantity < 2 THEN 'thin' END, CASE WHEN l_extendedprice > o_totalprice THEN 'below' END) AS checks FROM r WHERE rn = 1),
m AS (SELECT *, count(*) OVER () AS total FROM i WHERE {groups})
SELECT o_orderkey, ticker, epoch_us(o_orderdate) AS ordered_at, best_part, best_line, price, length, grade, n_lines, checks, {"checks <> ''" if "checks" in order else "false"} AS unranked, total
FROM m ORDER BY {order}, o_orderdate DESC, o_orderkey DESC {page}"""


RICH = "ticker IN (SELECT ticker FROM comp WHERE c_acctbal > 5000)"


@query("rq_trades_value", _trades_sql(f"p_type IN ('SMALL', 'PROMO', 'ECONOMY', 'LARGE') AND o_orderdate >= TIMESTAMP '1996-07-02' AND o_orderdate < TIMESTAMP '1999-01-01' AND {RICH}", "(checks <> ''), price DESC", "LIMIT 40 OFFSET 40"))
def rq_trades_value(spark, d):
    """Dearest first, flagged ones last; days shortens since; a universe of companies; page 2."""
    request = {"type": "fine,BULK", "since": "1995-06-01", "until": "1998-12-31", "days": "1094", "sort": "value", "universe": "rich", "page": "2", "limit": "40"}
    return _shown(R.ask(trades(d), trade_rows(spark, d), request, context(spark, d)).items)


C3 = "(upper(ticker) LIKE 'C3.%' OR list_contains(list_transform(coalesce(additional, []), lambda x: starts_with(x, 'C3.')), true))"


@query("rq_trades_company", _trades_sql(f"{C3} AND ('C3' NOT IN (SELECT bare FROM clash) OR upper(ticker) NOT LIKE '%.US')", "o_orderdate DESC", "LIMIT 200"))
def rq_trades_company(spark, d):
    """A company, cross-filed trades too, on its side of the border; the limit is clamped; a universe that isn't known lets all pass."""
    return _shown(R.ask(trades(d), trade_rows(spark, d), {"ticker": "C3.V", "limit": "9999", "universe": "unheard", "sort": "date"}, context(spark, d)).items)


@query("rq_trades_american", _trades_sql(f"{C3} AND ('C3' NOT IN (SELECT bare FROM clash) OR upper(ticker) LIKE '%.US')", "(checks <> ''), grade DESC", "LIMIT 50 OFFSET 7", "price >= 20000"))
def rq_trades_american(spark, d):
    """The other side of the border, by grade, cut by an attribute of the whole group, from an offset."""
    return _shown(R.ask(trades(d), trade_rows(spark, d), {"ticker": "c3-us", "sort": "grade", "price": "20000", "offset": "7"}, context(spark, d)).items)


@query("rq_trades_facets", f"""
WITH i AS (SELECT o_orderkey, any_value(o_orderstatus) AS s, any_value({TICKER_SQL}) AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN part ON l_partkey = p_partkey WHERE p_type IN ('MEDIUM', 'STANDARD') AND o_orderstatus IN ('O', 'P') GROUP BY 1)
SELECT 'status' AS facet, s AS value, count(*) AS n FROM i GROUP BY s UNION ALL SELECT 'ticker', t, count(*) FROM i GROUP BY t UNION ALL SELECT 'lines', CAST(n AS VARCHAR), count(*) FROM i GROUP BY n""")
def rq_trades_facets(spark, d):
    return R.ask(trades(d), trade_rows(spark, d), {"type": "plain", "status": "o,p"}, context(spark, d)).facets()


@query("rq_trades_lines", """
WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50)
SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p)""")
def rq_trades_lines(spark, d):
    """Rows that belong to the items of one page."""
    answer = R.ask(trades(d), trade_rows(spark, d), {"status": "F", "page": "3", "limit": "25"}, context(spark, d))
    return answer.included("lines").select("o_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("rq_trade_one", """
SELECT o_orderkey, count(*) AS n_lines, max(l_extendedprice) AS price, CASE WHEN max(l_extendedprice) > 95000 THEN 1 ELSE 0 END AS dear FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = 42 GROUP BY 1""")
def rq_trade_one(spark, d):
    found = R.one(trades(d), trade_rows(spark, d), 42)
    return found.select("o_orderkey", "n_lines", "price", F.array_contains("check", "dear").cast("int").alias("dear"))


def deals() -> R.Listing:
    newest = (F.desc("updated"), F.desc("o_orderkey"))
    return R.Listing(
        key="o_orderkey",
        date="o_orderdate",
        params={"status": R.one_of("o_orderstatus", ("O", "F", "P")), "state": R.one_of("state", ("open", "stale", "closed"), default="open,stale"), "kind": R.any_of("kinds", ("URGENT", "HIGH", "MEDIUM", "LOW", "SPECIFIED")), "currency": R.one_of("currency"), "raises_only": R.switch(F.col("o_totalprice") >= 250_000)},
        sorts={"updated": R.Sort(newest), "date": R.Sort((F.desc("o_orderdate"), F.desc("o_orderkey"))), "size": R.Sort((F.desc("o_totalprice"), *newest), True)},
        checks={"early": F.col("updated") < F.col("o_orderdate")},
        dims={"state": F.col("state"), "currency": F.col("currency")},
    )


def deal_rows(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("updated"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("currency"))
    home = table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "currency")
    state = open_state(F.col("o_orderstatus") == "O", F.col("updated"), F.lit(TODAY - dt.timedelta(days=60)).cast("timestamp_ntz"))
    rows = table(spark, d, "orders").join(last, "o_orderkey").join(home, "o_custkey")
    return rows.withColumns({"kinds": F.split("o_orderpriority", "[- ]"), "state": state})


DEALS_SQL = """
WITH i AS (SELECT *, CASE WHEN o_orderstatus = 'O' AND updated >= TIMESTAMP '1999-05-02' THEN 'open' WHEN o_orderstatus = 'O' THEN 'stale' ELSE 'closed' END AS state FROM orders
 JOIN (SELECT l_orderkey, max(l_shipdate) AS updated FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("rq_deals_size", f"""{DEALS_SQL}
SELECT o_orderkey, state, n_name AS currency, o_totalprice, updated < o_orderdate AS unranked, count(*) OVER () AS total FROM i
WHERE state IN ('open', 'stale') AND regexp_matches(o_orderpriority, 'URGENT|SPECIFIED') AND n_name IN ('NATION_1', 'NATION_7', 'NATION_12') AND o_totalprice >= 250000
ORDER BY unranked, o_totalprice DESC, updated DESC, o_orderkey DESC LIMIT 50""")
def rq_deals_size(spark, d):
    """Tokenised kinds, currencies, raises only, in the states shown by default; deals that were updated before they began aren't ranked."""
    request = {"kind": "urgent, specified", "currency": "NATION_1,NATION_7,NATION_12", "raises_only": "yes", "sort": "size"}
    return R.ask(deals(), deal_rows(spark, d), request, context(spark, d)).items.select("o_orderkey", "state", "currency", "o_totalprice", "unranked", "total")


@query("rq_deals_facets", f"""{DEALS_SQL}, f AS (SELECT * FROM i WHERE o_orderdate >= TIMESTAMP '1998-07-01')
SELECT 'state' AS facet, state AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'currency', n_name, count(*) FROM f GROUP BY 2""")
def rq_deals_facets(spark, d):
    return R.ask(deals(), deal_rows(spark, d), {"state": "open,stale,closed", "days": "365"}, context(spark, d)).facets()


def users() -> R.Listing:
    """Group first, filter on the group's attributes afterwards."""
    grouped = lambda rows: rows.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return R.Listing(
        key="user_id",
        date="last",
        date_of_groups=True,
        params={"kind": R.any_of("kinds", groups=True), "latest": R.one_of("latest", groups=True), "least": R.at_least("n", groups=True, default="2")},
        sorts={"last": R.Sort((F.desc("last"), F.col("user_id"))), "n": R.Sort((F.desc("n"), F.col("user_id")))},
        grouped=grouped,
        limit=500,
        most=500,
    )


@query("rq_users", """
WITH g AS (SELECT user_id, max(ts) AS last, count(*) AS n, list_sort(list_distinct(list(event_type))) AS kinds, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1)
SELECT user_id, epoch_us(last) AS last_at, n, array_to_string(kinds, '|') AS kinds, count(*) OVER () AS total FROM g
WHERE list_contains(kinds, 'purchase') AND latest IN ('click', 'view') AND n >= 2 AND last >= TIMESTAMP '2024-01-30' ORDER BY n DESC, user_id LIMIT 500""")
def rq_users(spark, d):
    answer = R.ask(users(), table(spark, d, "events"), {"kind": "purchase", "latest": "click,view", "days": "1", "sort": "n"}, R.Context(dt.date(2024, 1, 31)))
    return answer.items.select("user_id", micros(F.col("last")).alias("last_at"), "n", F.array_join("kinds", "|").alias("kinds"), "total")


@query("rq_turns", """
SELECT conv_id, turn, role, count(*) OVER () AS total FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'the') AND turn >= 1 ORDER BY conv_id DESC, turn DESC, role LIMIT 200""")
def rq_turns(spark, d):
    """Substring of a text, wildcards taken out of it, by role."""
    listing = R.Listing("conv_id", {"role": R.one_of("role", ("user", "assistant", "system")), "person": R.holds("text"), "turn": R.at_least("turn")}, {"new": R.Sort((F.desc("conv_id"), F.desc("turn"), F.col("role")))})
    return R.ask(listing, table(spark, d, "conversations"), {"role": "User,assistant", "person": "%ThE%", "turn": "1", "limit": "1000"}, R.Context(TODAY)).items.select("conv_id", "turn", "role", "total")


def calendar() -> R.Listing:
    day = lambda today: F.lit(today).cast("timestamp_ntz")
    parts = {"upcoming": lambda today: F.col("at") >= day(today), "tba": lambda today: F.col("at").isNull(), "recent": lambda today: (F.col("at") < day(today)) & (F.col("at") >= day(today - dt.timedelta(days=30)))}
    tie = (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return R.Listing(
        key="l_orderkey",
        params={"scope": R.scope(parts, "upcoming"), "kind": R.one_of("l_returnflag", ("A", "N", "R")), "confirmed": R.switch(F.col("l_linestatus") == "F")},
        sorts={"soonest": R.Sort((F.asc_nulls_last("at"), *tie)), "latest": R.Sort((F.desc_nulls_last("at"), *tie))},
    )


def _calendar_sql(condition: str, order: str) -> str:
    return f"""
WITH i AS (SELECT *, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_shipdate END AS planned FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(planned) AS planned_at, count(*) OVER () AS total FROM i WHERE {condition} ORDER BY {order}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50"""


def _dates(spark, d, request):
    rows = table(spark, d, "lineitem").withColumn("at", F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_shipdate")))
    items = R.ask(calendar(), rows, request, R.Context(TODAY)).items
    return items.select("l_orderkey", "l_linenumber", "l_partkey", micros(F.col("at")).alias("planned_at"), "total")


@query("rq_calendar_upcoming", _calendar_sql("planned >= TIMESTAMP '1999-07-01' AND l_returnflag IN ('A', 'R') AND l_linestatus = 'F'", "planned"))
def rq_calendar_upcoming(spark, d):
    return _dates(spark, d, {"kind": "a,r", "confirmed": "1"})


@query("rq_calendar_recent", _calendar_sql("planned >= TIMESTAMP '1999-06-01' AND planned < TIMESTAMP '1999-07-01'", "planned DESC"))
def rq_calendar_recent(spark, d):
    return _dates(spark, d, {"scope": "recent", "sort": "latest"})


@query("rq_calendar_tba", _calendar_sql("planned IS NULL", "planned"))
def rq_calendar_tba(spark, d):
    return _dates(spark, d, {"scope": "tba"})


@query("rq_news", """
SELECT doc_id, source, lang, count(*) OVER () AS total FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang = 'en' ORDER BY doc_id DESC LIMIT 30 OFFSET 5""")
def rq_news(spark, d):
    listing = R.Listing("doc_id", {"category": R.one_of("source"), "lang": R.one_of("lang", ("de", "en", "es", "fr"))}, {"new": R.Sort((F.desc("doc_id"),))})
    rows = table(spark, d, "documents").select("doc_id", "source", "lang")
    return R.ask(listing, rows, {"category": "src1,src2,src3", "lang": "en", "limit": "30", "offset": "5"}, R.Context(TODAY)).items.select("doc_id", "source", "lang", "total")
