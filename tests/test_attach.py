"""Databases by name, and the gate of pages."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import listings as L
from tessera.sources.attach import attach, detach


def test_two_databases_in_one_statement(spark):
    one, two = tempfile.mkdtemp(prefix="spark-a'", dir="/tmp"), tempfile.mkdtemp(prefix="spark-(b)", dir="/tmp")
    spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, name string").write.parquet(f"{one}/Items.parquet")
    spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "id int, n int").write.parquet(f"{two}/items.parquet")
    spark.range(1).write.json(f"{two}/other.json")
    assert attach(spark, "left_a", one) == ["left_a.items"] and attach(spark, "right_b", two) == ["right_b.items"]
    joined = "SELECT l.name, sum(r.n) AS n FROM left_a.items l LEFT JOIN right_b.items r ON l.id = r.id GROUP BY 1"
    assert sorted(tuple(r) for r in spark.sql(joined).collect()) == [("x", 11), ("y", None), ("z", None)]
    spark.createDataFrame([(2, 9)], "id int, n int").write.mode("append").parquet(f"{two}/items.parquet")
    spark.range(3).write.parquet(f"{two}/later.parquet")
    assert attach(spark, "right_b", two) == ["right_b.items", "right_b.later"]
    assert sorted(tuple(r) for r in spark.sql(joined).collect()) == [("x", 11), ("y", 9), ("z", None)]
    with pytest.raises(ValueError):
        attach(spark, "left_a", two)
    for name in ("Left", "a b", "", "1a", "a;b"):
        with pytest.raises(ValueError):
            attach(spark, name, one)
    detach(spark, "left_a")
    detach(spark, "right_b")
    detach(spark, "right_b")
    assert not spark.catalog.databaseExists("left_a") and spark.read.parquet(f"{two}/items.parquet").count() == 4
    with pytest.raises(ValueError):
        detach(spark, "default")


def test_gate_of_pages(spark):
    english, german = "the gold of the mine is in the hill and " * 20, "der und die ist das nicht mit von " * 20
    pages = [
        ("external", "x.other.com", "/a", "t", english),
        ("external", None, "/a", "t", english),
        ("generic", "news.own.com", "/", "t", english),
        ("generic", "own.com", None, "t", english),
        ("language", "own.com", "/a", "t", german),
        ("empty", "own.com", "/a", "t", None),
        ("empty", "own.com", "/a", None, "  "),
        ("short", "own.com", "/a", english.strip(), english + " more"),
        ("teaser", "own.com", "/a", None, english + "... Read more "),
        (None, "own.com", "/a", None, english),
        (None, "a.b.own.com", "/a", "t", "12 34 " * 100),
    ]
    rows = spark.createDataFrame(pages, "want string, host string, path string, headline string, body string")
    reason = L.page_gate(F.col("host"), F.col("path"), F.col("headline"), F.col("body"), ("own.com",), ("en",), "^/?$")
    assert [r.reason for r in rows.select(reason.alias("reason"), "want").collect()] == [p[0] for p in pages]
