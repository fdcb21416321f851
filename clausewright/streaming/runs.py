"""The latest runs of every stage, kept as runs stream in.

State is keyed by stage and holds its latest runs alone, however many come. Runs older than the watermark are left out, as Spark drops
them before the state sees them; runs that come again (by id) count once while they are among those held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausewright.sources.artefacts import exists

_ROWS = "stage string, place int, run_id bigint, started_at timestamp"
_STATE = "run_ids array<bigint>, started array<bigint>"


def _held(most: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, started = state.get if state.exists else ([], [])
        held = dict(zip(map(int, ids), map(int, started), strict=True))
        for rows in batches:
            times = rows["started_at"].astype("datetime64[us]").astype("int64")
            for run, at in zip(rows["run_id"].tolist(), times.tolist(), strict=True):
                held[run] = max(at, held.get(run, at))
            held = dict(sorted(held.items(), key=lambda x: (-x[1], -x[0]))[:most])
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"stage": [key[0]] * len(held), "place": range(1, len(held) + 1), "run_id": list(held), "started_at": pd.to_datetime(list(held.values()), unit="us")})

    return update


def latest(runs: DataFrame, most: int = 3, late: str = "1 hour") -> DataFrame:
    """A stream of ``(stage, place, run_id, started_at)``: the whole of a stage's latest ``most`` runs whenever one of its runs came.
    ``runs``: a stream of (stage, run_id, started_at)."""
    known = runs.select("stage", "run_id", F.col("started_at").cast("timestamp").alias("started_at")).filter("stage is not null and run_id is not null and started_at is not null").withWatermark("started_at", late)
    return known.groupBy("stage").applyInPandasWithState(_held(most), _ROWS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)  # none is set; with it Spark drops late rows


def keep_latest(runs: DataFrame, path: str, checkpoint: str, most: int = 3, late: str = "1 hour") -> StreamingQuery:
    """Write every batch's rows to a folder, with the batch's number; a batch that is repeated after a failure replaces its rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return latest(runs, most, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`keep_latest` has by now: of every stage the rows of the last batch that had any."""
    if not exists(spark, path):
        return spark.createDataFrame([], _ROWS)
    rows = spark.read.schema(f"{_ROWS}, batch bigint").parquet(path)
    last = rows.groupBy("stage").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["stage", "batch"]).select("stage", "place", "run_id", "started_at")
