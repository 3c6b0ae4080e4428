"""Versioned facts: which version of an extractor readers see, and writes that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activate(versions: DataFrame, extractor: str, version: str) -> DataFrame:
    """``versions`` (extractor, version, status) with this version active and the one active before retired."""
    if versions.where((F.col("extractor") == extractor) & (F.col("version") == version) & (F.col("status") != "rejected")).isEmpty():
        raise ValueError(f"{extractor} {version} isn't there or is rejected")
    mine = F.col("extractor") == extractor
    status = F.when(mine & (F.col("version") == version), "active").when(mine & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return versions.withColumn("status", status)


def active(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """Facts of the active versions only."""
    return facts.join(versions.where("status = 'active'").select("extractor", "version"), ["extractor", "version"], "left_semi")


def replaced(store: DataFrame, batch: DataFrame, group: list[str]) -> DataFrame:
    """``store`` with each group of ``batch`` written anew; the same batch twice gives the same store."""
    return store.join(batch.select(*group).distinct(), group, "left_anti").unionByName(batch)


def pending(events: DataFrame, runs: DataFrame, extractor: str, version: str) -> DataFrame:
    """Events without a run of this version; a run without records counts (measured silence)."""
    done = runs.where((F.col("extractor") == extractor) & (F.col("version") == version)).select("event_id")
    return events.join(done, "event_id", "left_anti")


def rolled_back(versions: DataFrame, extractor: str) -> DataFrame:
    """The active version of an extractor becomes a candidate again and the one retired last (largest version) active."""
    mine = F.col("extractor") == extractor
    before = versions.where(mine & (F.col("status") == "retired")).agg(F.max("version").alias("_before"))
    joined = versions.crossJoin(F.broadcast(before))  # one row
    status = F.when(mine & (F.col("version") == F.col("_before")), "active").when(mine & (F.col("status") == "active") & F.col("_before").isNotNull(), "candidate").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_before")


def rejected(versions: DataFrame, extractor: str, version: str) -> DataFrame:
    """A candidate that must not be activated; the active version can't be rejected."""
    hit = (F.col("extractor") == extractor) & (F.col("version") == version) & (F.col("status") != "active")
    return versions.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))


def purged(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """Facts without those of rejected versions."""
    return facts.join(versions.where("status = 'rejected'").select("extractor", "version"), ["extractor", "version"], "left_anti")
