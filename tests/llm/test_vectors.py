import math
import random

import numpy as np

from clausewright.llm import vectors


def brute(rows, least):
    ok = lambda r: r[1] is not None and r[2] is not None and r[0] is not None and len(r[1]) and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])
    n, root = [0] * len(rows), [r[0] for r in rows]
    linked = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    linked.append((i, j))
    for _ in rows:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return sorted((str(r[0]), n[k], str(root[k])) for k, r in enumerate(rows))


def sample():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(8)]
    rows = []
    for k in range(160):
        c = rng.choice(centres)
        rows.append((k, [x + rng.gauss(0, rng.choice([0.05, 0.25, 0.5])) for x in c], rng.choice([0, 1, None])))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, [0.0] * 16, 0), (203, None, 0), (204, [1.0, None], 1), (205, [float("nan")] * 16, 1), (206, [float("inf")] * 16, 1), (207, [1.0] * 4, 1), (208, [2.0] * 4, 1), (209, [], 1), (210, [5.0] * 4, None), (0, rows[0][1], rows[0][2])]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rows = sample()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, v string, size int")
    got = vectors.near_duplicates(df, least=0.93).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 24)) * rng.uniform(0.01, 100, (200, 1))
    q, s, n, e = vectors.quantise(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = unit @ unit.T
    estimate = (q.astype(int) @ q.astype(int).T) * s[:, None] * s[None, :]
    assert (np.abs(exact - estimate) <= n[:, None] * e[None, :] + e[:, None] * n[None, :] + e[:, None] * e[None, :] + 1e-12).all()
    for least in (-0.2, 0.0, 0.3, 0.9):
        i, j = vectors.near_pairs(x, x, least, True)
        brute_i, brute_j = np.nonzero(np.triu(exact >= least, 1))
        assert set(zip(i, j, strict=True)) == set(zip(brute_i, brute_j, strict=True))


def test_very_large_and_small_components(spark):
    rows = [(k, [a * m for a in (1.0, 2.0, 0.5)], "x") for k, m in enumerate((1.0, 1e200, 1e-200, 5e-300, 1e308 / 4))] + [(9, [-1e200, 1.0, 0.0], "x")]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(4, 0)] * 5 + [(0, 9)]


def test_open_pairs_come_back_in_full(spark, monkeypatch):
    """Pairs about the threshold, which codes cannot decide, over several tiles."""
    monkeypatch.setattr(vectors, "TILE", 8)
    rng, rows = random.Random(9), []
    for k in range(60):
        angle = math.acos(0.93) * (k % 3) + rng.uniform(-1e-4, 1e-4)
        rows.append((k, [math.cos(angle), math.sin(angle), rng.uniform(-1e-3, 1e-3)], 0))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = vectors.near_duplicates(df, least=0.93).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute(rows, 0.93)


def test_tiles_of_one_row_and_none(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 1)
    rows = [(k, [1.0, 0.01 * k], 0) for k in range(7)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute(rows, 0.93)


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_several_vectors_of_one_id(spark):
    """Each is a vector of its own; what one of them links with says nothing of the others."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (5, [-1.0, 0.0], 0), (4, [-1.0, 0.01], 0), (4, [-1.0, 0.01], 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 4), (4, 2, 4), (5, 2, 4)]
