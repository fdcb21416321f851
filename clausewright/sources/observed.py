"""Figures of a table, counted by the tasks that write it.

``DataFrame.observe`` stands directly before the write, whose tasks Spark counts once each, however often they are tried.
So a summary costs no second pass over its stage, and no stage is computed again for its counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clausewright.sources.staging import stage


def fingerprint(columns: list[str]) -> Column:
    """Sum of the rows' hashes: equal for equal rows in any order and partitioning. Maps, which have no hash, count by their entries."""
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))


def _hashed(df: DataFrame) -> list[Column]:
    named = ["`" + f.name.replace("`", "``") + "`" for f in df.schema]
    return [F.to_json(F.struct(n)) if "map<" in f.dataType.simpleString() else F.col(n) for n, f in zip(named, df.schema, strict=True)]


def figures_of(df: DataFrame, write: Callable[[DataFrame], object], *figures: Column, name: str | None = None) -> tuple[object, dict]:
    """What ``write`` returns for ``df``, and ``rows``, ``fingerprint`` and these figures (aliased aggregates) of what was written."""
    seen = Observation(name) if name else Observation()
    told = df.observe(seen, F.count(F.lit(1)).alias("rows"), fingerprint(_hashed(df)).alias("fingerprint"), *figures)
    out = write(told)
    got = seen.get
    total = int(got.get("fingerprint") or 0) % (1 << 64)
    return out, {"rows": 0} | got | {"fingerprint": f"{total:016x}"}


def observed(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, dict]:
    """``df`` staged, and its figures."""
    return figures_of(df, lambda told: stage(told, name), *figures)


def one_row(spark: SparkSession, figures: dict) -> DataFrame:
    """Whole numbers, by name, as a frame of one row."""
    return spark.createDataFrame([tuple(figures.values())], StructType([StructField(n, LongType()) for n in figures]))
