"""Learning samples are bounded by rows, whatever their ids."""

from pyspark.sql import functions as F

from tessera.llm import classifier, langid, toxicity
from tessera.llm.common import bounded_sample


def many(spark, n, one_id):
    """n different texts in two languages, all under one id or each under its own, and as many copies of a single row."""
    words = F.when(F.col("id") % 2 == 0, F.lit("the house and the garden of the town")).otherwise(F.lit("das haus und der garten mit der stadt"))
    rows = spark.range(n).select((F.lit(7) if one_id else F.col("id")).cast("long").alias("doc_id"), F.concat_ws(" ", words, F.conv(F.col("id").cast("string"), 10, 26)).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    copies = spark.range(n).select(F.lit(8).cast("long").alias("doc_id"), F.lit("the same row of text again").alias("text"), F.lit("en").alias("lang"))
    return rows.union(copies)


def test_samples_hold_a_bounded_number_of_different_rows(spark):
    for one_id in (True, False):
        kept = bounded_sample(many(spark, 20_000, one_id), "lang", 500, 3)
        counts = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
        assert set(counts) == {"en", "de"} and all(400 < c < 600 for c in counts.values()), counts
        assert kept.distinct().count() == kept.count()
    few = many(spark, 20, True)
    assert bounded_sample(few, "lang", 500, 3).count() == few.distinct().count()
    again = bounded_sample(many(spark, 2000, True).repartition(5), "lang", 100, 3).collect()
    assert sorted(again) == sorted(bounded_sample(many(spark, 2000, True), "lang", 100, 3).collect())
    assert bounded_sample(few.limit(0), "lang", 500, 3).count() == 0


def test_many_rows_of_one_id_give_a_language_model(spark):
    docs = many(spark, 50_000, True)
    for one in range(5):
        model = langid.fit(docs.withColumn("doc_id", F.lit(one)), sample=100)
        assert set(model.languages) == {"de", "en"}
    odd = spark.createDataFrame([(1, "und der garten"), (2, "and the garden")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()} == {1: "de", 2: "en"}


def test_many_rows_of_one_id_in_the_other_samples(spark):
    docs = many(spark, 20_000, True)
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (8, 0, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert classifier.fit(docs, labels, sample=200) is not None
    model = toxicity.fit(docs.withColumn("doc_id", F.when(F.col("lang") == "de", 7).otherwise(8).cast("long")), labels, sample=200)
    assert model is not None and any(t.startswith("stadt") or t.startswith("garten") for t in model.terms)
