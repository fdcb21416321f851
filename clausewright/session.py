"""Session defaults and registration of tables for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "clausewright", **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; the number of partitions is left to AQE's coalescing."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views, so that every table can be queried in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
