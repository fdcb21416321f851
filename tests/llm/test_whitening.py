import math
from fractions import Fraction

import numpy as np
import pytest

from clausewright.llm import whitening

TYPE = "vec_id bigint, embedding array<double>, label int, dim int, n string, id int, place int, whitened int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 2, "n", 3, 4, 5) for k, v in enumerate(vectors)], TYPE)


def plain(vectors):
    """n, sums, exact deviations and the covariance as fractions, an entry at a time."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    y = [[n * r[j] - sums[j] for j in range(dim)] for r in x]
    squares = [[sum(r[i] * r[j] for r in y) for j in range(dim)] for i in range(dim)]
    return n, sums, [sum(c * c for c in r) for r in y], squares


def sample(rows=300, dim=12, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(rows, dim)) @ rng.normal(size=(dim, dim)) * spread).tolist()


@pytest.mark.parametrize("spread", [0.01, 1.0, 1e9, 1e14])
def test_equals_exact_arithmetic(spark, monkeypatch, spread):
    monkeypatch.setattr(whitening, "ROWS", 64)
    vectors = sample(spread=spread)
    clipped = [[min(max(c, -whitening.MOST / 1024), whitening.MOST / 1024) for c in v] for v in vectors]
    n, sums, deviations, squares = plain(clipped)
    df = frame(spark, vectors).repartition(5)
    fits = whitening.fit(df)
    assert fits[12].n == n and fits[12].sums == sums
    known = whitening._sums(whitening._usable(df, "vec_id", "embedding"))
    assert whitening._squares(whitening._usable(df, "vec_id", "embedding"), known)[12].tolist() == squares
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 * n and {(r["vec_id"], int(r["deviation"])) for r in rows} == set(enumerate(deviations))
    covariance = np.array([[float(Fraction(v, n**3)) for v in row] for row in squares])
    values, basis = np.linalg.eigh(covariance)
    white = np.zeros((n, 8))
    for r in rows:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(values[::-1][r["component"] - 1] / np.trace(covariance), rel=1e-9)
        assert r["identity_error"] < 1e-6
    x = np.array([[float(Fraction(n * (math.floor(1024 * c) + 100000) - s, n)) for c, s in zip(v, sums, strict=True)] for v in clipped])
    expected = x @ basis[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.allclose(np.abs(white), np.abs(expected), atol=1e-6)
    signs = np.sign(white * expected)[np.abs(expected) > 1e-3]
    assert all(len(set(np.sign(white[:, k] * expected[:, k])[np.abs(expected[:, k]) > 1e-3])) == 1 for k in range(8)) and len(signs)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-6


def test_limbs_and_products_are_exact():
    rng = np.random.default_rng(1)
    for bound in (1, 1 << 19, 1 << 20, (1 << 20) + 1, (1 << 41) - 1, (1 << 62) - 1, 1 << 90):
        values = [int(v) for v in rng.integers(-(1 << 60), 1 << 60, 600)]
        y = np.array([bound, -bound, 0, *(v % (2 * bound + 1) - bound for v in values)], object).reshape(-1, 3)
        y = y if bound >> 62 else y.astype(np.int64)
        count = whitening.limb_count(bound)
        parts = whitening.limbs(y, count)
        assert all(np.abs(p).max() <= 1 << whitening.LIMB - 1 for p in parts)
        total = sum(p.astype(object).astype(int).astype(object) * (1 << whitening.LIMB * k) for k, p in enumerate(parts))
        assert (total == y.astype(object)).all()
        products = whitening.Products(3, count)
        products.add(y)
        products.add(y[:1])
        products.carry()
        rows = [*y.tolist(), y[0].tolist()]
        assert whitening.recombined(products.digits).tolist() == [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(3)] for i in range(3)]


def test_odd_rows(spark):
    good = sample(40, 3, 5)
    odd = [None, [], [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    df = frame(spark, good + odd)
    rows = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in rows} == set(range(40)) and len(rows) == 120 and {r["n"] for r in rows} == {40}
    assert {int(r["deviation"]) for r in rows} == set(plain(good)[2])


def test_lengths_are_fitted_apart(spark):
    a, b = sample(30, 3, 1), sample(50, 5, 2)
    rows = whitening.whiten(frame(spark, a + b)).collect()
    assert {(r["n"], r["vec_id"] < 30) for r in rows} == {(30, True), (50, False)} and len(rows) == 90 + 250


def test_no_variance(spark):
    assert whitening.whiten(frame(spark, [[1.0, 2.0]])).collect() == []
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 9)).collect() == []
    line = whitening.whiten(frame(spark, [[float(k), 2.0 * k, 7.0] for k in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []


def test_query(spark, tmp_path):
    from clausewright.llm.queries import queries

    vectors = np.float32(sample(120, 16, 3)).astype(float).tolist()
    spark.createDataFrame([(k, v, None) for k, v in enumerate(vectors)] + [(None, vectors[0], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries()["op13_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    n, _, deviations, _ = plain([*vectors, vectors[0]])
    rows = out.collect()
    assert len(rows) == 8 * n and sorted({(str(r["vec_id"]), r["deviation"]) for r in rows}) == sorted((str(k), d) for k, d in zip([*range(120), None], deviations, strict=True))
