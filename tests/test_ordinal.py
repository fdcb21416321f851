"""Positions, caps and samples over a global order, and sets merged by id."""

import random

import pytest
from pyspark.sql import functions as F

from clausewright.operators import metrics, ordinal


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    values = [(k, rng.choice([None, "a", "b", "c"]), rng.randrange(40)) for k in range(997)]
    return values, spark.createDataFrame(values, "id int, k string, v int").repartition(7)


def test_positions_equal_a_sorted_list(rows):
    values, df = rows
    got = {r["id"]: r["ordinal"] for r in ordinal.with_ordinal(df, "k", F.desc("v"), "id").collect()}
    ordered = sorted(values, key=lambda r: (r[1] is not None, r[1] or "", -r[2], r[0]))
    assert got == {r[0]: n + 1 for n, r in enumerate(ordered)}


def test_ties_and_empty_tables(rows):
    _, df = rows
    assert sorted(r["ordinal"] for r in ordinal.with_ordinal(df.select(F.lit(1).alias("x"), "id"), "x").collect()) == list(range(1, 998))
    assert ordinal.with_ordinal(df.limit(0), "id").collect() == []
    assert ordinal.sample(df.limit(0), 5, 1, "id").collect() == []


@pytest.mark.parametrize("few", [1, 10_000])
def test_first_rows(rows, monkeypatch, few):
    monkeypatch.setattr(ordinal, "FEW", few)
    values, df = rows
    got = ordinal.first_rows(df, 50, "v", "id")
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in sorted(values, key=lambda r: (r[2], r[0]))[:50])


@pytest.mark.parametrize("size,seed", [(1, 0), (5, 1), (20, 42), (21, 7), (400, 3), (996, 9), (997, 5), (2000, 2)])
def test_samples_equal_pythons(rows, size, seed):
    values, df = rows
    got = [r["id"] for r in ordinal.sample(df, size, seed, "id").orderBy("place").collect()]
    population = sorted(r[0] for r in values)
    assert got == random.Random(seed).sample(population, min(size, len(population)))


def test_sets_merged_by_id(spark):
    rng = random.Random(8)
    names = [f"c{k}" for k in range(60)] + [None]
    sets = [[rng.choice(names) for _ in range(40)] for _ in range(4)]
    ids = lambda s: spark.createDataFrame([(i,) for i in s], "clause_id string")
    universe, truth, a, b = sets
    u, rest = set(universe), [set(s) - {None} for s in (truth, a, b)]
    got = {r["bits"]: r["clauses"] for r in metrics.set_sizes(ids(universe), t=ids(truth), a=ids(a), b=ids(b)).collect()}
    expected = {}
    for i in u:
        bits = sum((i in s) << k for k, s in enumerate(rest))
        expected[bits] = expected.get(bits, 0) + 1
    assert got == expected
    predicted = ids(a).withColumn("rung", F.lit("a")).unionByName(ids(b).withColumn("rung", F.lit("b")))
    cells = {r["rung"]: (r["predicted_positive"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.confusion(ids(universe), ids(truth), predicted).collect()}
    t = u & rest[0]
    assert cells == {n: (len(s & u), len(s & t), len(s & u - t), len(t - s), len(u - t - s)) for n, s in (("a", rest[1]), ("b", rest[2]))}
    assert metrics.confusion(ids([]), ids(truth), predicted).collect() == []
    zero = metrics.confusion(ids([]), ids([]), predicted.limit(0), ("a", "z")).collect()
    assert [(r["rung"], r["tn"], r["f1"]) for r in zero] == [("a", 0, 0.0), ("z", 0, 0.0)]


def test_no_join_on_ids(spark):
    ids = spark.range(10).select(F.col("id").cast("string").alias("clause_id"))
    plan = metrics.agreement(ids, ids, ids)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
