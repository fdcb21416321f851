"""Whitening of embeddings with exact covariances by digit-slice products.

Components c become whole numbers x = floor(1024 c) + 100000. With n vectors and sums S per dimension, the whole numbers
y = n x - S are centred without rounding. Each is split into signed limbs of LIMB bits; the
products of two slices of limbs over at most ROWS vectors stay under 2^53, so float64 BLAS gives them exactly. Products
of equal weight are added as integers with carries, tasks send digits that Spark adds up, and the driver
recombines them as big integers, one matrix of the dimensions' size. Only the quotient by n^3, the covariance, is rounded, once; its eigenvectors
whiten the vectors in a second pass, and the covariance of what comes out is measured in a third.

Defined results: null vectors, and those with null or non-finite components, are left out, as are vectors of no
dimensions; vectors of each length are fitted apart; |floor(1024 c)| beyond 2^52 is taken as 2^52; components are numbered by
falling variance (ties in the order of the decomposition), and those without variance within rounding are not returned, so one vector alone, or equal ones, give no
rows; repeated rows and ids count each; ids of any type, null as well, are kept; other columns are ignored; an empty table gives an empty table.
The driver holds a few values for each pair of dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import stage

#: Units of a component, and what is added.
SCALE, OFFSET = 1024, 100_000
#: Greatest size of a scaled component.
MOST = 1 << 52
#: Bits of a limb, and vectors in one product: 2 (LIMB - 1) + log2(ROWS) <= 52.
LIMB, ROWS = 21, 1 << 12
#: Digits beyond the products' own, for carries.
CARRY = 4
#: Products after which carries are moved.
_EVERY = 1 << 6
#: Components returned.
COMPONENTS = 8
_LOW = 1 << 32


class Fit(NamedTuple):
    """Of the vectors of one length: their number, sums of x, covariance's eigenvalues and vectors (columns), and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole(v: np.ndarray) -> np.ndarray:
    """x of components in double precision."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE), -MOST, MOST).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: list[int], bound: int) -> np.ndarray:
    """n x - S; as Python's integers if ``bound``, which none exceeds, needs more than 62 bits."""
    if bound >> 62:
        return x.astype(object) * n - np.array(sums, object)
    middle = [s // n for s in sums]  # n x alone may not fit
    return (x - np.array(middle, np.int64)) * n - np.array([s - m * n for s, m in zip(sums, middle, strict=True)], np.int64)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """Signed digits of LIMB bits as doubles, lowest first."""
    half, mask, out = 1 << LIMB - 1, (1 << LIMB) - 1, []
    for _ in range(count - 1):
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return [*out, y.astype(np.float64)]


def limb_count(bound: int) -> int:
    """Limbs that hold every whole number up to ``bound``; the last is a signed digit as well."""
    return max(1, -(-(bound.bit_length() + 2) // LIMB))


class Products:
    """Exact sums of y y' as digits of LIMB bits, lowest first."""

    def __init__(self, size: int, count: int):
        self.count, self.since = count, 0
        self.digits = np.zeros((2 * count - 1 + CARRY, size, size), np.int64)

    def add(self, y: np.ndarray) -> None:
        for start in range(0, len(y), ROWS):
            parts = limbs(y[start : start + ROWS], self.count)
            for a in range(self.count):
                for b in range(a, self.count):
                    product = (parts[a].T @ parts[b]).astype(np.int64)
                    self.digits[a + b] += product if a == b else product + product.T
            self.since += 1
            if self.since == _EVERY:
                self.carry()

    def carry(self) -> None:
        for k in range(len(self.digits) - 1):
            self.digits[k + 1] += self.digits[k] >> LIMB
            self.digits[k] &= (1 << LIMB) - 1
        self.since = 0


def recombined(digits: np.ndarray) -> np.ndarray:
    """Big integers of digits along the first axis."""
    total = np.zeros(digits.shape[1:], object)
    for k in range(len(digits) - 1, -1, -1):
        total = total * (1 << LIMB) + digits[k].astype(object)
    return total


def decomposed(n: int, sums: list[int], squares: np.ndarray) -> Fit:
    """Of the big integers ``squares``, the sums of y y', which are n^3 times the covariance."""
    size = len(sums)
    covariance = np.array([[int(v) / n**3 for v in row] for row in squares], np.float64).reshape(size, size)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    real = values > max(values[0], 0) * size * 4 * np.finfo(float).eps
    return Fit(n, sums, values[real], vectors[:, real], sum(int(squares[k, k]) for k in range(size)) / n**3)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, vectors)`` of each length in a batch, at most ROWS at once."""
    held = batch.column(column)
    size = held.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.nonzero(size == dim)[0]
        for start in range(0, len(at), ROWS):
            some = at[start : start + ROWS]
            yield some, held.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), dim)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & fine)


def _sums(src: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """For each length: number of vectors, sums of x, and a bound of |n x - S|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, v in _by_length(batch, 0):
                x = whole(v)
                high = x >> 32
                new = [len(x), high.sum(0), (x - (high << 32)).sum(0), x.min(0), x.max(0)]
                old = held.get(v.shape[1])
                held[v.shape[1]] = new if old is None else [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]
        for dim, (n, *rest) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), *map(pa.array, rest)], ["dim", "j", "n", "high", "low", "least", "most"])

    parts = src.select("v").mapInArrow(run, "dim int, j int, n bigint, high bigint, low bigint, least bigint, most bigint")
    rows = parts.groupBy("dim", "j").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "high"), (F.sum, "low"), (F.min, "least"), (F.max, "most")))).orderBy("dim", "j").collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in rows:
        n, sums, bound = out.get(r["dim"], (r["n"], [], 0))
        s = r["high"] * _LOW + r["low"]
        out[r["dim"]] = n, [*sums, s], max(bound, abs(n * r["least"] - s), abs(n * r["most"] - s))
    return out


def _squares(src: DataFrame, known: dict[int, tuple[int, list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the big integers sum(y y')."""
    count = {dim: limb_count(bound) for dim, (_, _, bound) in known.items()}
    digits = 2 * max(count.values()) - 1 + CARRY
    names = [f"d{k}" for k in range(digits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Products] = {}
        for batch in batches:
            for _, v in _by_length(batch, 0):
                dim = v.shape[1]
                held.setdefault(dim, Products(dim, count[dim])).add(centred(whole(v), *known[dim]))
        for dim, p in held.items():
            p.carry()
            i, j = np.triu_indices(dim)
            none = np.zeros(len(i), np.int64)
            columns = [p.digits[k][i, j] if k < len(p.digits) else none for k in range(digits)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, columns)], ["dim", "i", "j", *names])

    parts = src.select("v").mapInArrow(run, "dim int, i int, j int, " + ", ".join(f"{c} bigint" for c in names))
    rows = parts.groupBy("dim", "i", "j").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    dims, i, j = (rows.column(c).to_numpy() for c in ("dim", "i", "j"))
    each = recombined(np.stack([rows.column(c).to_numpy() for c in names]))
    out = {}
    for dim in known:
        own = dims == dim
        out[dim] = np.zeros((dim, dim), object)
        out[dim][i[own], j[own]] = out[dim][j[own], i[own]] = each[own]
    return out


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Fit]:
    """The fit of the vectors of each length."""
    src = _usable(vectors, id_col, vector_col)
    known = _sums(src)
    squares = _squares(src, known) if known else {}
    return {dim: decomposed(n, sums, squares[dim]) for dim, (n, sums, _) in known.items()}


def transform(vectors: DataFrame, fits: dict[int, Fit], *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id_col, dim, n, deviation, whitened)``: the exact sum of (n x - S)^2 as decimal text, and the first components' values."""
    src = _usable(vectors, id_col, vector_col)
    models = {dim: (f.n, f.sums, f.vectors[:, :components] / np.sqrt(f.values[:components])) for dim, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _by_length(batch, 1):
                dim = v.shape[1]
                if dim not in models:
                    continue
                n, sums, basis = models[dim]
                x = whole(v)
                bound = max(abs(int(x.max()) * n - min(sums)), abs(int(x.min()) * n - max(sums)))
                y = centred(x, n, sums, bound)
                exact = y if bound * bound * dim < 1 << 63 else y.astype(object)
                deviation = (exact * exact).sum(1)
                white = (y.astype(np.float64) / n) @ basis
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * basis.shape[1], pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), n)), pa.array([str(d) for d in deviation.tolist()]), lists], ["id", "dim", "n", "deviation", "whitened"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, dim int, n bigint, deviation string, whitened array<double>").withColumnRenamed("id", id_col)


def identity_errors(white: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(dim, identity_error)``: how far the covariance of :func:`transform`'s values is from the identity, at most."""
    at = lambda k: F.try_element_at("whitened", F.lit(k + 1))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    means = white.groupBy("dim").agg(*(F.avg(at(k)).alias(f"m{k}") for k in range(components)))
    # a row for each length
    off = white.join(F.broadcast(means), "dim")
    shift = lambda k: at(k) - F.col(f"m{k}")
    entries = off.groupBy("dim").agg(*(F.avg(shift(i) * shift(j)).alias(f"c{i}_{j}") for i, j in pairs))
    errors = [F.abs(F.col(f"c{i}_{j}") - int(i == j)) for i, j in pairs]
    return entries.select("dim", F.array_max(F.array(*errors)).alias("identity_error"))


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation (exact, decimal text), whitened, explained, identity_error."""
    fits = fit(vectors, id_col=id_col, vector_col=vector_col)
    white = stage(transform(vectors, fits, components=components, id_col=id_col, vector_col=vector_col), "whitened")
    shares = [(dim, k, float(e / f.trace)) for dim, f in fits.items() for k, e in enumerate(f.values[:components].tolist())]
    told = vectors.sparkSession.createDataFrame(shares, "dim int, place int, explained double")
    errors = identity_errors(white, components)
    each = white.select(id_col, "dim", "n", "deviation", F.posexplode("whitened").alias("place", "value"))
    return each.join(F.broadcast(told), ["dim", "place"]).join(F.broadcast(errors), "dim").select(id_col, (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), "explained", "identity_error")


def as_long(number: str | Column) -> Column:
    """Decimal text as long; null if it does not fit."""
    return (F.col(number) if isinstance(number, str) else number).try_cast("bigint")

