"""The stored index against plain search of everything."""

import math
import random

import numpy as np
import pytest

from clausewright.operators import vector_index


def clusters(n, dim=6, seed=1, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 4) for _ in range(dim)] for _ in range(12)]
    return [(k, [c + rng.gauss(0, spread) for c in centres[k % 12]]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        near = sorted(((math.dist(v, w), i) for i, w in rows if w is not None and len(w) == len(v) and all(c is not None and math.isfinite(c) for c in w)))[:k]
        out += [(q, i, n + 1) for n, (_, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, path, k):
    out, report = vector_index.search(spark.createDataFrame(rows, "query_id bigint, vector array<double>"), path, k)
    return sorted((r["query_id"], r["id"], r["rank"]) for r in out.collect()), report


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(vector_index, "RING_ROWS", 16)
    monkeypatch.setattr(vector_index, "QUERIES", 8)


def test_search_is_exact_and_reads_part(spark, tmp_path):
    rows, path = clusters(900), str(tmp_path / "index")
    vector_index.build(frame(spark, rows), path)
    queries = [(1000 + k, [c + 0.01 for c in rows[k * 7][1]]) for k in range(40)] + [(2000, [9.0] * 6), (2001, [0.0] * 6)]
    got, report = found(spark, queries, path, 5)
    assert got == brute(rows, queries, 5)
    assert report.rows == 900
    one, few = found(spark, queries[:1], path, 5)
    assert one == brute(rows, queries[:1], 5) and few.rows_read < 300 and few.rings_read < few.rings / 2


def test_ties_and_copies(spark, tmp_path):
    rows = [(k, [float(k % 3), 0.0]) for k in range(120)]
    vector_index.build(frame(spark, rows), str(tmp_path / "i"))
    queries = [(1, [0.0, 0.0]), (2, [1.5, 0.0]), (3, [2.0, 1.0])]
    assert found(spark, queries, str(tmp_path / "i"), 50)[0] == brute(rows, queries, 50)
    assert len(found(spark, queries, str(tmp_path / "i"), 500)[0]) == 3 * 120


def test_append_leaves_known_ids_alone(spark, tmp_path):
    rows, path = clusters(400), str(tmp_path / "i")
    vector_index.build(frame(spark, rows[:250]), path)
    far = [(500 + k, [50.0 + k] * 6) for k in range(5)]  # outside all rings
    assert vector_index.append(frame(spark, [(i, [0.0] * 6) for i, _ in rows[:100]] + rows[100:] + far + far[:1]), path) == 155
    assert vector_index.append(frame(spark, rows), path) == 0
    queries = [(1000 + k, rows[k][1]) for k in range(0, 400, 9)] + [(1, [52.0] * 6)]
    assert found(spark, queries, path, 7)[0] == brute(rows + far, queries, 7)


def test_odd_vectors(spark, tmp_path):
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6), (904, [])]
    rows, path = clusters(60) + odd, str(tmp_path / "i")
    vector_index.build(frame(spark, rows), path)
    assert spark.read.parquet(f"{path}/vectors").filter("cell = -1").count() == 5
    queries = [(k, rows[k][1]) for k in range(20)]
    got, _ = found(spark, [*queries, (99, None), (98, [1.0])], path, 3)
    assert got == brute(rows, queries, 3)
    with pytest.raises(FileExistsError):
        vector_index.build(frame(spark, rows), path)


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    vector_index.build(frame(spark, []), path)
    assert found(spark, [(1, [0.0, 1.0])], path, 3)[0] == []


def test_centres_are_bounded_and_near():
    x = np.array([v for _, v in clusters(300)])
    centres = vector_index.fit_centres(x, 12)
    assert len(centres) == 12 and vector_index._distances(x, centres).min(1).max() < 1.0
    assert len(vector_index.fit_centres(np.ones((5, 2)), 4)) == 1
