"""Tags that readers earn: decisions, the tags that follow from them, and the state before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(tags: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next state of ``tags`` (event_id, status, before) under ``decisions`` (event_id, admit, categories): event_id, status, before,
    step.

    Admitted events without an active tag get one and remember their categories; active tags whose decision is no, or that have
    no decision, are dropped; the rest stays. A second pass with the same decisions changes nothing.
    """
    joined = tags.withColumn("had", F.lit(True)).join(decisions.withColumn("decided", F.lit(True)), "event_id", "full")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    admit = F.coalesce("admit", F.lit(False))
    step = F.when(admit & ~active, "added").when(active & ~admit, "dropped").otherwise("kept")
    kept = joined.withColumn("step", step).where((F.col("step") != "kept") | F.col("had"))
    status = F.when(F.col("step") == "added", "active").when(F.col("step") == "dropped", "dropped").otherwise(F.col("status"))
    return kept.select("event_id", status.alias("status"), F.when(F.col("step") == "added", F.col("categories")).otherwise(F.col("before")).alias("before"), "step")


def reasserted(events: DataFrame, tags: DataFrame, tag: str, default: str) -> DataFrame:
    """events (event_id, categories) with the tag on all active ones, and the categories of before on dropped ones."""
    joined = events.join(tags.select("event_id", "status", "before"), "event_id", "left")
    with_it = F.array_distinct(F.array_append(F.array_remove("categories", default), F.lit(tag)))
    return joined.select("event_id", F.when(F.col("status") == "active", with_it).when(F.col("status") == "dropped", F.col("before")).otherwise(F.col("categories")).alias("categories"))
