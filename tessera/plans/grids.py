"""Tables of releases, written from the lines of orders as markup with spans and as aligned text, and read back as figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import grids as G
from tessera.functions.deals import deals_in
from tessera.plans.registry import query
from tessera.sources.tables import table

FIELDS = {"quantity": r"interval > .*length|^length", "price": r"value", "tax": r"tax"}
_SQL = """
SELECT l_orderkey, count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax_points,
 string_agg(l_returnflag, '' ORDER BY l_returnflag, l_partkey, l_suppkey, l_linenumber) AS labels, '{unit}' AS unit FROM lineitem GROUP BY 1"""


def _lines(spark, d):
    lines = table(spark, d, "lineitem")
    price = F.format_number("l_extendedprice", 2)
    line = F.struct("l_returnflag", "l_partkey", "l_suppkey", "l_linenumber", F.format_number("l_quantity", 1).alias("q"), price.alias("p"), F.format_number(F.col("l_tax") * 100, 0).alias("t"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _totals(rows):
    flags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "label"))), lambda x: x.label), "")
    cents = F.sum(F.round(F.col("price") * 100).cast("bigint"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.sum("quantity").cast("bigint").alias("quantity"), cents.alias("cents"), F.sum(F.col("tax").cast("bigint")).alias("tax_points"), flags.alias("labels"), F.max(F.element_at("units", "quantity")).alias("unit"))


@query("rd_html_grids", _SQL.format(unit="m"))
def rd_html_grids(spark, d):
    """Two rows of headers, the upper one over several columns, and the first column's cells over all rows of a flag."""

    def row(line, k, lines):
        before = F.get(lines, F.when(k > 0, k - 1))["l_returnflag"]
        same = F.size(F.filter(lines, lambda x: x.l_returnflag == line.l_returnflag)).cast("string")
        flag = F.when(before.eqNullSafe(line.l_returnflag), "").otherwise(F.concat(F.lit("<td rowspan="), same, F.lit(">"), line.l_returnflag, F.lit("</td>")))
        return F.concat(F.lit("<tr>"), flag, F.lit("<td>"), line.l_linenumber.cast("string"), F.lit("<td>"), line.q, F.lit("<td>$"), line.p, F.lit("</td><td>("), line.t, F.lit(")</td></tr>"))

    head = "<p>Results</p><table><tr><th rowspan=2>Flag</th><th colspan=2>Interval</th><th colspan=2>Assay</th></tr><tr><th>Hole</th><th>Length (m)</th><th>Value ($)</th><th>Tax</th></tr>"
    html = F.concat(F.lit(head), F.array_join(F.transform("lines", lambda line, k: row(line, k, F.col("lines"))), ""), F.lit("</table>"))
    read = G.measured(G.html_tables(_lines(spark, d).select("l_orderkey", html.alias("html")), "l_orderkey", "html"), "l_orderkey", FIELDS)
    return _totals(read.withColumn("tax", -F.col("tax")))


@query("rd_text_grids", _SQL.format(unit="ft"))
def rd_text_grids(spark, d):
    """Aligned columns under a header of two lines, prose before and after."""

    def line(x):
        return F.concat(F.rpad(x.l_returnflag, 8, " "), F.lpad(x.l_linenumber.cast("string"), 4, " "), F.lpad(x.q, 14, " "), F.lpad(x.p, 16, " "), F.lpad(x.t, 9, " "))

    head = "The company reports.\n\n" + "Flag".ljust(8) + "Hole" + "Length (ft)".rjust(14) + "Value".rjust(16) + "Tax".rjust(9) + "\n" + " " * 8 + "No  " + "core".rjust(14) + "ore".rjust(16) + "due".rjust(9) + "\n"
    text = F.concat(F.lit(head), F.array_join(F.transform("lines", line), "\n"), F.lit("\n\nAll is well."))
    read = G.measured(G.text_tables(_lines(spark, d).select("l_orderkey", text.alias("text")), "l_orderkey", "text"), "l_orderkey", FIELDS)
    return _totals(read)


@query("rd_deal_statements", """
WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 5000 + 1000 AS n, o_custkey % 40 + 1 AS tenths, o_orderkey % 4 AS form, list_value('units', 'shares', 'notes')[o_custkey % 3 + 1] AS kind FROM orders)
SELECT o_orderkey, 1 AS deal, CASE WHEN form = 2 THEN 'closed' ELSE 'announced' END AS step, kind, n AS count, tenths AS price_tenths, CASE WHEN form = 1 THEN 'USD' END AS currency, n * tenths AS total_tenths, form = 0 AS derived, CASE WHEN form = 3 THEN 1 ELSE 0 END AS parts FROM t
UNION ALL SELECT o_orderkey, 2, 'upsized', 'warrants', 77, NULL, 'USD', 5000000, false, 0 FROM t WHERE form = 1""")
def rd_deal_statements(spark, d):
    """Deals told in one to four sentences, in four orders, some with parts or beside a second deal."""
    n = F.floor("o_totalprice") % 5000 + 1000
    tenths = F.col("o_custkey") % 40 + 1
    kind = F.element_at(F.array(*[F.lit(k) for k in ("units", "shares", "notes")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    one = F.substring(kind, F.lit(1), F.length(kind) - 1)
    size, price = F.format_number(n, 0), F.format_number(tenths / 10, 2)
    total = F.format_number(n * tenths / 10, 2)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    told = [
        say("Acme announces a private placement. It consists of ", size, " ", kind, " at a price of $", price, " per ", one, "."),
        say("Acme announces a sale for gross proceeds of US$", total, ". The ", size, " ", kind, " are priced at US$", price, " per ", one, ".\n\nIt upsizes an issue of 77 warrants to US$500,000."),
        say("With ", size, " ", kind, " sold at $", price, " per ", one, ", the deal closed. Total proceeds: $", total, "."),
        say("Acme announces ", size, " ", kind, ". They cost $", price, " per ", one, " for an aggregate of $", total, ". The first tranche will bring $400."),
    ]
    text = F.element_at(F.array(*told), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = deals_in(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    tenth = lambda c: F.round(F.col(c) * 10).cast("bigint")
    return found.select("o_orderkey", "deal", "step", "kind", F.col("count").cast("bigint").alias("count"), tenth("price").alias("price_tenths"), "currency", tenth("total").alias("total_tenths"), "derived", F.size("parts").alias("parts"))
