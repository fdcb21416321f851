"""Shared-folder tables (those of :mod:`clausewright.sources.staging`) and small session helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.sources.staging import drop_stage, leave_nothing, shared_dir, stage

__all__ = ["bounded", "drop_stage", "fold", "map_arrow", "quoted", "held_out", "leave_nothing", "shared_dir", "stage", "table"]


#: Bytes of the batches that tasks and their Python workers exchange. Buffers of the usual 64 MB stay with the threads of an executor that have held one.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded(spark: SparkSession) -> None:
    """Small batches for whole texts, unless the session names a size."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name for Spark, whatever it holds (dots as well)."""
    return "`" + name.replace("`", "``") + "`"


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo three; fold 1 is held out of training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col.cast("string").cast("binary")) % 3


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row belongs to fold 1; a row without an id does not."""
    return F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out")


def map_arrow(rows: DataFrame, run: Callable, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows.mapInArrow`` that gives ``(name, type)`` columns in this order, whatever the names on either side hold (dots, repeats)."""
    plain = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
    return plain.mapInArrow(run, ", ".join(f"c{k} {kind}" for k, (_, kind) in enumerate(columns))).toDF(*(name for name, _ in columns))
