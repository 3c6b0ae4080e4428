"""Session defaults: adaptive plans, UTC, Kryo-free plain Spark. Nothing here depends on the size of the data."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the defaults; ``conf`` wins over them, ``master`` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless they find it by PYTHONPATH or (local mode) here."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    root = str(package.parent)
    known = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (context.master.startswith("local[") and os.getcwd() == root)
    if not known and context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="spark-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", root, package.name))
        _shipped.add(context.applicationId)
