"""Incremental runs: new pages stream in, flags stream out, vectors are added once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clausewright import schemas
from clausewright.operators import lexicon
from clausewright.sources.artefacts import exists
from clausewright.sources.sinks import upsert_vectors


def clause_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses as JSON-lines files arrive in a folder."""
    return spark.readStream.schema(schemas.TABLES["clauses"]).json(folder)


def lexicon_stream(clauses: DataFrame) -> DataFrame:
    """Stateless, so it runs on a stream as it does on a table."""
    return lexicon.flags(clauses)


def vector_stream(clauses: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Append vectors of unseen clause ids, batch by batch; a repeated batch adds nothing."""
    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(path) if exists(spark, path) else None
        fresh = batch.selectExpr("clause_id as id", "text").dropDuplicates(["id"])
        upsert_vectors(fresh, stored, embed).write.mode("append").parquet(path)

    return clauses.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
