"""Tables in the folder that driver and executors share, written to cut lineage.

Every table lands under the folder the session names in ``spark.checkpoint.dir``. A
session on one machine without that setting (tests, notebooks) uses a folder below its
SQL warehouse; on a cluster a missing setting is an error, as local folders are not shared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def leave_nothing(spark: SparkSession, path: str) -> None:
    """Have the files deleted when the session's JVM ends, if nobody has done so before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The files outlive executors, so later stages never recompute what is above.
    """
    path = f"{shared_dir(df.sparkSession)}/clausewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)  # in the session's compression: the native buffers of zstd stay with an executor's threads
    leave_nothing(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a frame returned by :func:`stage`."""
    path = getattr(df, "_staged_path", None)
    if path is None:
        return
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
