"""The latest runs on a stream: batches, repeats, late rows, a restart."""

import datetime

import pytest

from clausewright.streaming import runs

SCHEMA = "stage string, run_id bigint, started_at timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(late="1 hour"):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        runs.keep_latest(source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 3, late).awaitTermination()
        return sorted((r["stage"], r["place"], r["run_id"]) for r in runs.current(spark, str(tmp_path / "out")).collect())

    return write, run


def test_state_is_carried_over_batches_and_restarts(stream):
    write, run = stream
    write([("a", 1, at(1)), ("a", 2, at(2)), ("b", 3, at(2)), ("a", 4, at(3)), ("a", 5, at(3)), (None, 6, at(3)), ("b", None, at(3))])
    assert run() == [("a", 1, 5), ("a", 2, 4), ("a", 3, 2), ("b", 1, 3)]
    write([("a", 7, at(2)), ("a", 5, at(3)), ("c", 8, at(9))])  # an older one, a repeated one
    assert run() == [("a", 1, 5), ("a", 2, 4), ("a", 3, 7), ("b", 1, 3), ("c", 1, 8)]


def test_rows_behind_the_watermark_are_left_out(stream):
    write, run = stream
    write([("a", 1, at(500))])
    run("10 minutes")
    write([("a", 2, at(499)), ("b", 3, at(480))])  # within ten minutes, and long before
    assert run("10 minutes") == [("a", 1, 1), ("a", 2, 2)]


def test_nothing_has_come_yet(spark, tmp_path):
    assert runs.current(spark, str(tmp_path / "none")).collect() == []
