"""Databases by name: the tables of a folder become tables of a database of the session, so that one SQL statement joins several."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

MARK = "attached from "


def attach(spark: SparkSession, name: str, folder: str) -> list[str]:
    """Every Parquet file or folder below ``folder`` (any file system that Spark reads) becomes table ``name``.<its name>; returns
    the tables. Nothing is copied: tables stay where they are and detach forgets them. A name that is taken by another folder's
    tables is refused; attaching the same folder again picks up new tables and new files."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"{name}: a database's name is lower-case letters, digits and underscores")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = fs.makeQualified(path).toString()
    known = _told(spark, name)
    if known is None:
        spark.sql(f"CREATE DATABASE {name} COMMENT '{_quoted(MARK + place)}'")
    elif known != MARK + place:
        raise ValueError(f"{name} is taken")
    tables = []
    for entry in fs.listStatus(path):
        kept = re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)\.parquet", entry.getPath().getName())
        if kept:
            table = f"{name}.{kept[1].lower()}"
            if spark.catalog.tableExists(table):
                spark.catalog.refreshTable(table)
            else:
                spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{_quoted(entry.getPath().toString())}'")
            tables.append(table)
    return sorted(tables)


def detach(spark: SparkSession, name: str) -> None:
    """Forget a database that attach made; its files stay. Others are refused."""
    known = _told(spark, name)
    if known is None:
        return
    if not known.startswith(MARK):
        raise ValueError(f"{name} wasn't attached")
    spark.sql(f"DROP DATABASE {name} CASCADE")  # its tables are external


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _told(spark: SparkSession, name: str) -> str | None:
    """The comment of a database, None where there is no such database."""
    if not spark.catalog.databaseExists(name):
        return None
    return {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE DATABASE {name}").collect()}.get("Comment", "")
