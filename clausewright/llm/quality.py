"""Quality scores by Gaussian-kernel ridge regression on document statistics.

Random Fourier features approximate the kernel. Every partition sums its own
normal equations, the sums are added by row of the matrix, and the driver solves
a system of fixed size. Isotonic regression over score bins, counted on all
training rows, turns ridge scores into probabilities.

Defined results: null and empty texts have the statistics of an empty text and
are scored; very long texts are read whole; labels that are null, other than 0 or
1, or of unknown ids are not learned; an id labelled or listed several times
counts each time; without any label every score is 0.5 (nothing is rejected); tied
ridge scores share a score, and one of exactly the least is kept; an empty table
gives an empty table; other columns are ignored, and kept by :func:`keep`.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import fold, stage

#: Fourier features, kernel width (in standard deviations of a statistic), ridge penalty a row, score bins.
FEATURES, WIDTH, RIDGE, BINS = 192, 4.0, 1e-3, 1000
_SYMBOLS = np.frombuffer(b"#$%&*|<>{}[]\\^~_=+@/", np.uint8)
STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """STATISTICS numbers of a whole text, each of a few units at most."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, low, high = seen[65:91].sum(), seen[97:123].sum(), seen[128:].sum()
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    stops = seen[46] + seen[63] + seen[33]
    return [
        np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()), len(counts) / m**0.8, max(counts.values(), default=0) / m, again / m,
        upper / (upper + low + high + 1), (low + high) / n, seen[48:58].sum() / n * 10, np.sqrt(seen[_SYMBOLS].sum() / n), np.sqrt(seen[33] / n), np.sqrt(seen[124] / n),
        np.sqrt(stops / m), np.sqrt(seen[44] / m), len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))), np.log1p(m / max(1, stops)),
        sum(c for c in counts.values() if c > 1) / m,
    ]


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, x)`` of every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, x array<double>").withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.waves + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(x), self.knots, self.values)


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.lift(_rows(batch))
                total += z.T @ np.column_stack([z, batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total))], ["i", "sums"])

    return run


def _add(rows: pa.Table) -> pa.Table:
    sums = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(0)
    return pa.table({"i": rows.column("i").slice(0, 1), "sums": pa.array([sums])})


def fit(feats: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id") -> QualityModel:
    """Learn from every labelled row outside fold 1; only matrices of fixed size reach the driver."""
    rng = np.random.default_rng(10)
    waves, phase = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col) != 1)).select(id_col, F.col(label_col).cast("double").alias("y"))
    rows = feats.join(known, id_col).select("x", "y")
    moments = rows.agg(F.count("*"), *[f(F.col("x")[k]) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    flat = np.array([0.5, 0.5])
    if not moments[0]:
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), waves, phase, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), flat)
    mean, spread = np.array(moments[1::2], float), np.array(moments[2::2], float)
    model = QualityModel(mean, np.where(spread > 1e-9, spread, 1), waves, phase, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), flat)
    sums = rows.mapInArrow(_equations(model), "i int, sums array<double>").groupBy("i").applyInArrow(_add, "i int, sums array<double>").collect()
    system = np.array([r["sums"] for r in sorted(sums, key=lambda r: r["i"])])
    weights = np.linalg.solve(system[:, :-1] + RIDGE * moments[0] * np.eye(FEATURES + 1) * (np.arange(FEATURES + 1) < FEATURES)[:, None], system[:, -1])
    model = QualityModel(mean, model.spread, waves, phase, weights, np.array([0.0, 1.0]), flat)
    scored = rows.mapInArrow(_apply(model, ("y",), QualityModel.ridge), "score double, y double")
    bins = scored.groupBy(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("score"))) * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("score").alias("at")).orderBy("bin").collect()
    y, n, at = (np.array([b[k] for b in bins], float) for k in ("y", "n", "at"))
    return QualityModel(mean, model.spread, waves, phase, weights, at, np.clip(isotonic(y, n), 0, 1))


def _apply(model: QualityModel, carry: tuple[str, ...], how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = how(model, _rows(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(score), *(batch.column(batch.schema.get_field_index(c)) for c in carry)], ["score", *carry])

    return run


def score(feats: DataFrame, model: QualityModel, *, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, score)`` of every row of features."""
    id_type = feats.schema[id_col].dataType.simpleString()
    return feats.select(F.col(id_col).alias("id"), "x").mapInArrow(_apply(model, ("id",), QualityModel.score), f"score double, id {id_type}").select(F.col("id").alias(id_col), "score")


def scorer(model: QualityModel):
    """A column function from whole texts to scores."""

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics(t.as_py()) for t in texts])) if len(texts) else [], pa.float64())

    return quality_score


def keep(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more, all columns kept.

    Every text's statistics are taken once and written beside it; the model is
    learned from them and applied to them, so no text is joined or shuffled.
    """

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    x = f"x_{uuid.uuid4().hex}"
    held = stage(docs.withColumn(x, measured(text_col)), "quality-texts")
    model = fit(held.select(id_col, F.col(x).alias("x")), labels, label_col=label_col, id_col=id_col)

    @F.arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), STATISTICS)) if len(rows) else [], pa.float64())

    return held.filter(scored(x) >= least).drop(x)
